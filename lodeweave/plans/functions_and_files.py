"""User functions and file formats."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lodeweave.plans.registry import query
from lodeweave.session import ship, table
from lodeweave.sources import files, generator


@query("uf1_row_udf", "SELECT c_custkey, c_custkey % 97 + 1 AS tag FROM customer")
def row_udf(spark, sf_dir):
    """The slow path, for functions that take one row at a time."""
    tag = F.udf(lambda k: k % 97 + 1, "long", useArrow=True)
    return table(spark, sf_dir, "customer").select("c_custkey", tag("c_custkey").alias("tag"))


@query("uf2_vectorized", "SELECT o_orderkey, o_totalprice * 2.5 AS gross FROM orders")
def vectorized(spark, sf_dir):
    @F.pandas_udf("double")
    def gross(net: pd.Series) -> pd.Series:
        return net * 2.5

    return table(spark, sf_dir, "orders").select("o_orderkey", gross("o_totalprice").alias("gross"))


@query("uf3_udaf", "SELECT event_type, round(exp(avg(ln(value))), 6) AS geometric FROM events GROUP BY event_type")
def udaf(spark, sf_dir):
    """A mean that needs no group in one place: logarithms are averaged with partial sums.

    Spark's logarithm is null outside its domain, and an average would leave such rows out; here they count as in IEEE arithmetic.
    """
    value = F.col("value")
    log = F.when(value > 0, F.ln(value)).when(value == 0, F.lit(float("-inf"))).when(value < 0, F.lit(float("nan")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.exp(F.avg(log)), 6).alias("geometric"))


@query("uf3_pandas_udaf", "SELECT s_nationkey, max(s_acctbal) - min(s_acctbal) AS spread FROM supplier GROUP BY s_nationkey")
def pandas_udaf(spark, sf_dir):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return x.max() - x.min()

    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(spread("s_acctbal").alias("spread"))


@query("uf4_udtf", "SELECT n_nationkey, unnest(range(CAST(n_regionkey AS BIGINT) + 1)) AS step FROM nation")
def udtf(spark, sf_dir):
    class Steps:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    spark.udtf.register("lodeweave_steps", F.udtf(Steps, returnType="step long"))
    table(spark, sf_dir, "nation").createOrReplaceTempView("uf4_nation")
    return spark.sql("SELECT n_nationkey, step FROM uf4_nation, LATERAL lodeweave_steps(n_regionkey)")


@query("uf5_sql_udf", "SELECT p_partkey, p_retailprice * (1 - 0.05 * (p_size % 3)) AS price FROM part")
def sql_udf(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lodeweave_price(p DOUBLE, n INT) RETURNS DOUBLE RETURN p * (1 - 0.05D * (n % 3))")
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("lodeweave_price(p_retailprice, p_size)").alias("price"))


@query("uf6_grouped_map", "SELECT s_suppkey, s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey) > 0 AS above FROM supplier")
def grouped_map(spark, sf_dir):
    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_suppkey": pdf["s_suppkey"], "above": pdf["s_acctbal"] > pdf["s_acctbal"].mean()})

    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(mark, "s_suppkey long, above boolean")


@query("uf6_partition_map", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS l1 FROM embeddings")
def partition_map(spark, sf_dir):
    def run(batches):
        for batch in batches:
            flat, ends = batch.column(1).flatten(), batch.column(1).offsets
            sums = pd.Series(pc.abs(flat.cast(pa.float64())).to_numpy()).groupby(batch.column(1).value_parent_indices().to_numpy()).sum()
            yield pa.record_batch([batch.column(0), pa.array(sums.reindex(range(len(ends) - 1), fill_value=0.0).round(4))], ["vec_id", "l1"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, l1 double")


@query("io1_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_quantity < 3")
def pruned_scan(spark, sf_dir):
    late = F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").where(late & (F.col("l_quantity") < 3)).select("l_orderkey", "l_quantity")


def _round_trip(kind):
    @query(f"io2_{kind}", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
    def run(spark, sf_dir):
        return files.round_trip(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), kind)

    return run


for _kind in ("parquet", "orc", "json", "csv"):
    _round_trip(_kind)


@query("io2_text", "SELECT n_name AS value FROM nation")
def text_file(spark, sf_dir):
    path = files.scratch(spark, "text")
    table(spark, sf_dir, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@query("io3_xml", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xml(spark, sf_dir):
    return files.round_trip(table(spark, sf_dir, "nation"), "xml")


@query("io5_partitioned", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def partitioned(spark, sf_dir):
    """Written by event type; the filter reads two of the folders."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = files.scratch(spark, "partitioned")
    files.write(events, path, "parquet", ("event_type",))
    kept = spark.read.schema(events.schema).parquet(path).where("event_type IN ('click', 'error')")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("io6_binary_files", "SELECT 1 AS files, true AS parquet")
def binary_files(spark, sf_dir):
    found = spark.read.format("binaryFile").load(f"{sf_dir}/region.parquet")
    mark = F.substring("content", 1, 4) == F.lit(b"PAR1")
    return found.agg(F.count("*").cast("int").alias("files"), F.bool_and(mark).alias("parquet"))


@query("io7_custom_source", "SELECT (i * 2654435761) % 4294967296 % 7 AS key, count(*) AS n, sum(i)::BIGINT AS ids FROM range(2000) t(i) GROUP BY 1")
def custom_source(spark, sf_dir):
    ship(spark)
    generator.register(spark)
    rows = spark.read.format("lodeweave_events").option("rows", 2000).option("keys", 7).load()
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
