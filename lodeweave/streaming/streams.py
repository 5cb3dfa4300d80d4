"""Structured Streaming operators: windows, late data, deduplication, joins and keyed state.

Event times are cast to zoned timestamps, which watermarks need. ``settle`` runs a
stream over all input that is there and returns what it wrote, so a stream can be
compared with a batch answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave.sources.files import scratch


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder`` as a stream: one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a glob finds a single file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/{name}.parque[t]")


def events(spark: SparkSession, folder: str, delay: str | None = "1 hour") -> DataFrame:
    stream = file_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", delay) if delay else stream


def settle(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input; the sink is Parquet in the shared folder.

    In complete mode each batch replaces the result. In append mode, windows that
    the watermark has not passed stay open and are not in it.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)


def tumbling(stream: DataFrame, width: str, *keys: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, *keys: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def first_of_each(stream: DataFrame, *keys: str) -> DataFrame:
    """Watermarked deduplication: state for a key is dropped once the watermark has passed it."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str) -> DataFrame:
    """Rows of both streams with equal keys, the right one at most ``within`` after the left."""
    l, r = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
    return left.alias("l").join(right.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (r >= l) & (r < l + F.expr(f"INTERVAL {within}")))


def running_totals(stream: DataFrame, key: str) -> DataFrame:
    """Custom keyed state: each batch, every key seen in it with its count and sum so far."""

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            count += len(pdf)
            total += float(pdf["value"].sum())
        state.update((count, total))
        yield pd.DataFrame({key: [keys[0]], "n": [count], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def running_totals_in_rocksdb(stream: DataFrame, key: str) -> DataFrame:
    """``running_totals`` on the newer state interface; needs the RocksDB state store (see ``rocksdb``)."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Totals(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("held", "n long, total double")

        def handleInputRows(self, keys, rows, timers) -> Iterator[pd.DataFrame]:
            count, total = self.held.get() if self.held.exists() else (0, 0.0)
            for pdf in rows:
                count += len(pdf)
                total += float(pdf["value"].sum())
            self.held.update((count, total))
            yield pd.DataFrame({key: [keys[0]], "n": [count], "total": [total]})

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(Totals(), f"{key} long, n long, total double", "append", "none")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside is kept in RocksDB: larger than memory, with incremental checkpoints."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
