"""Where operators keep tables and files that more than one executor must see."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"

#: Paths written and not deleted since each open ``scope`` began, innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lodeweave/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored inside. Results must be written elsewhere before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files every executor sees."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it any more."""
    delete(df.sparkSession, df._stored_at)


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for Python functions: texts may be long, and two workers share an executor with its heap.

    A result is run after the function that makes it has returned, so these
    settings stay; a caller's smaller ones are kept.
    """
    for name, bound in (("maxRecordsPerBatch", 2048), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(docs: DataFrame, column: str = "text", each: int = 32 << 20) -> int:
    """Partitions of about ``each`` bytes of a text column; no fewer than the session's."""
    size = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // each))


def ref(name: str) -> str:
    """A column's name, quoted: it may hold dots and blanks."""
    return "`" + name.replace("`", "``") + "`"


def trim(spark: SparkSession, python: bool = True) -> None:
    """Let executors' heaps and, with ``python``, Python workers shrink before a stage.

    A heap that one stage has grown, and what its Python workers remember, stay beside the next stage and under the
    same limit of memory. A short wave of tasks collects garbage and forgets tokenizers; where a task
    does not come by, an executor is merely not trimmed. A stage of SQL functions alone goes without Python here too.
    """
    n = spark.sparkContext.defaultParallelism
    wave = spark.range(0, n, 1, n)

    def forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodeweave.llm import bpe

        bpe.forget()
        release()
        yield from batches

    if python:
        wave = wave.mapInArrow(forget, "id long")
    wave.selectExpr("id", "reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def release() -> None:
    """Give a Python worker's free memory back: workers outlive tasks, and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
