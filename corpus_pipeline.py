"""Corpus pipeline: quality filter, near-duplicate removal, PII surrogates, source mix, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` writes each stage's result to the shared folder
and gives the next stage what was written. Repeated rows and ids are handled as
each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import jaccard, mixing, packing, pii, quality_model
from lodeweave.llm.queries import PII_KEY, vocabulary
from lodeweave.llm.storage import bound_batches, materialize, new_path, ref, scope, trim
from lodeweave.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL states a fitted classifier, a seeded draw or a genetic packing; tests compare with plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    labels = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.where(F.col("score") >= 0.3).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of 75 percent Jaccard similarity on five-word shingles: that of its smallest doc_id.

    Rows without an id come last, and rows of one id are told apart by their place in the order of texts. Wordless
    texts are in no component and stay.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        rows, mark = docs, "doc_id"
    else:  # ids that name no row: rows are numbered in the order of their ids
        rows = docs.select(F.struct(*[F.col(ref(c)) for c in docs.columns]).alias("row"), "doc_id", "text").orderBy(F.asc_nulls_last("doc_id"), "text")
        rows = materialize(rows.select("row", "text", F.monotonically_increasing_id().alias("mark")), "numbered")
        mark = "mark"
    found = jaccard.join(rows.select(F.col(mark).alias("doc_id"), "text"))
    gone = materialize(found.where("n_shingles > 0 and component_id < doc_id").select(F.col("doc_id").alias("gone_id_")), "gone")  # far fewer than stay
    left = rows.join(gone, F.col(mark) == F.col("gone_id_"), "left_anti")
    return left if mark == "doc_id" else left.select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the new text."""
    replaced = pii.replace_entities(docs, key=PII_KEY, kinds=None)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, written by output shard in the shard's shuffled order."""
    plan = mixing.Mix(docs)
    return plan.shuffled(mixing.keyed(docs)).sortWithinPartitions("shard", "place").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def _prepared(stage: Stage, native: bool = False) -> Stage:
    """The stage, after sending the code to the executors, bounding Arrow batches and trimming memory (native: no Python)."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        trim(spark, python=not native)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", _prepared(quality)),
    ("jaccard_join", _prepared(deduplicate)),
    ("pii", _prepared(private, native=True)),
    ("mixing", _prepared(mix)),
    ("packing", _prepared(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last. Of a stage, its result alone stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", path)
    return docs
