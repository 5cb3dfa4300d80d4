"""Projection, filter, sampling, sorting and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.operators.relational import top_k
from lodeweave.plans.registry import query
from lodeweave.session import table


@query(
    "pf1_project_filter",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem
    WHERE l_quantity < 5 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01'
    """,
)
def project_filter(spark, sf_dir):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    kept = (F.col("l_quantity") < 5) & F.col("l_discount").between(0.05, 0.07) & F.col("l_returnflag").isin("A", "R")
    late = F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").where(kept & late).select("l_orderkey", "l_linenumber", F.round(charge, 6).alias("charge"))


@query(
    "pf2_explode",
    "SELECT doc_id, unnest(string_split(lang || ':' || source, ':')) AS tag FROM documents",
)
def explode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat_ws(":", "lang", "source"), ":")).alias("tag"))


@query("pf2_posexplode", "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INTEGER) AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
def posexplode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("pf3_seeded_sample")
def seeded_sample(spark, sf_dir):
    """About a tenth of the rows; the sample is the feature."""
    return table(spark, sf_dir, "orders").sample(fraction=0.1, seed=42).select("o_orderkey", "o_totalprice")


@query("pf3_hash_sample", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def key_sample(spark, sf_dir):
    """A sample by key, the same on every engine; the sample is the feature."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 10 = 3").select("o_orderkey")


@query(
    "pf4_pivot",
    """
    SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f_lines,
           CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o_lines FROM lineitem GROUP BY l_returnflag
    """,
)
def pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f_lines"), F.coalesce("O", F.lit(0)).alias("o_lines"))


@query(
    "pf4_unpivot",
    """
    SELECT s_suppkey, measure, amount FROM (SELECT s_suppkey, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier)
    UNPIVOT (amount FOR measure IN (balance, nation))
    """,
)
def unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["balance", "nation"], "measure", "amount")


@query("pf5_pipe_syntax", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def pipe_syntax(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("pf5_events")
    return spark.sql("FROM pf5_events |> WHERE value > 50 |> AGGREGATE count(*) AS n GROUP BY event_type")


@query("sl1_global_sort", "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer")
def global_sort(spark, sf_dir):
    """The sorted order, shown by places; ranges are sorted apart and places are offsets plus place within the range."""
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    parts = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").repartitionByRange(8, *order).withColumn("part", F.spark_partition_id())
    within = parts.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return within.join(starts, "part").select("c_custkey", "c_acctbal", (F.col("start") + F.col("local")).cast("int").alias("place"))


@query(
    "sl2_top_k",
    """
    SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer
    JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10
    """,
)
def shipping_priority(spark, sf_dir):
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day)
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("sl3_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7 OFFSET 5")
def offset(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(7)


@query(
    "sl4_top_k_per_group",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
)
def top_per_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("sl5_qualify", "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) >= 4")
def qualify(spark, sf_dir):
    counted = table(spark, sf_dir, "supplier").withColumn("n", F.count("*").over(Window.partitionBy("s_nationkey")))
    return counted.where("n >= 4").select("s_nationkey", "s_suppkey")
