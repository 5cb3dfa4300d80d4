"""Joins of rows with a table of one row per key, where a few keys may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.storage import partitions


def spread_join(rows: DataFrame, found: DataFrame, keys: Sequence[str], copies: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` on ``keys``; a key of many rows meets in many tasks.

    ``found`` has one row per key, with how many ``rows`` have the key in the column
    ``copies`` (dropped here). A key with more than a quarter of an even task's share
    is hot: its rows get a salt, its row of ``found`` one copy per salt. The hot keys
    add up to all rows at most, so there are at most four per task of them, which is
    the bound on what is broadcast. Keys must not be null.
    """
    parts = partitions(rows.sparkSession)
    total = found.agg(F.sum(copies)).first()[0] or 0
    limit = max(1024, -(-total // (4 * parts)))
    salts = F.ceil(F.col(copies) / F.lit(limit)).cast("int")
    hot = found.where(F.col(copies) > limit).select(*keys, salts.alias("salts_"))
    salted = rows.join(F.broadcast(hot), list(keys), "left")
    salted = salted.withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts_")), F.lit(0)).cast("int")).drop("salts_")
    copied = found.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.when(F.col(copies) > limit, salts - 1).otherwise(0)))).drop(copies)
    return salted.join(copied, [*keys, "salt_"], how).drop("salt_")
