import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import queries
from lodeweave.llm.storage import materialize
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def tables(spark, hard, small, small_labels, tmp_path_factory):
    """The small table with the hard rows beside it, under ids of their own, as a folder of tables."""
    path = tmp_path_factory.mktemp("tables")
    moved = hard.withColumn("doc_id", F.col("doc_id") + 100_000)
    small.unionByName(moved).withColumn("kept", F.lit("own")).write.parquet(f"{path}/documents.parquet")
    small_labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, tables), "test")
        assert after.columns == columns, name
        if name == "quality_classifier":
            good = spark.read.parquet(f"{tables}/labels.parquet").where("quality = 1")
            assert good.join(after, "doc_id", "left_anti").count() <= 0.05 * good.count()
            bad = spark.read.parquet(f"{tables}/labels.parquet").where("quality = 0")
            assert bad.join(after, "doc_id", "left_semi").count() <= 0.2 * bad.count()
        if name == "jaccard_join":
            rows = [(i, r["text"]) for i, r in enumerate(before.collect())]
            linked = {c for _, n, c in brute(rows) if n}
            components = {c: {rows[i][1] for i, n, c2 in brute(rows) if n and c2 == c} for c in linked}
            left = [r["text"] for r in after.collect() if r["text"] and r["text"].strip()]
            assert len(left) == len(linked) and all(sum(t in texts for t in left) == 1 for texts in components.values())
            wordless = lambda rows_: sum(not (t and t.strip()) for t in rows_)
            assert wordless([t for _, t in rows]) == wordless([r["text"] for r in after.collect()])
        if name == "pii":
            assert after.count() == before.count()
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert after.select("doc_id").distinct().count() <= before.count() < after.count() * 2
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, tables)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.where("piece = 0").count() == before.count()


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 100


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_per_document(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    if "page" in got.columns[0]:
        assert got.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    else:
        want = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert set(ids) == want and (len(ids) == len(want) or name.startswith("op9"))
