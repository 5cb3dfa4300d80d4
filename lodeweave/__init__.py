"""A PySpark-native analytics engine: every operator is a DataFrame -> DataFrame function."""
