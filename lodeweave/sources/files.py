"""File sources and sinks: every built-in format, always with a stated schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Options that make a format keep what was written.
FORMATS = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "escape": '"', "nullValue": "\\N", "multiLine": "true"},
    "xml": {"rowTag": "row", "rootTag": "rows"},
}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; one of our own where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodeweave-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/lodeweave/{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(kind).options(**FORMATS[kind])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    return spark.read.format(kind).options(**FORMATS[kind]).schema(schema).load(path)


def round_trip(df: DataFrame, kind: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write and read back in a format."""
    path = scratch(df.sparkSession, kind)
    write(df, path, kind, partition_by)
    return read(df.sparkSession, path, kind, df.schema).select(*df.columns)
