"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators.relational import asof_join, interval_join, salted_join
from lodeweave.plans.registry import query
from lodeweave.session import table


@query(
    "jn1_multi_way",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer
    JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name
    """,
)
def local_suppliers(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    joined = (
        t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"))
        .join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"].where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


_BY_NATION = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def _by_nation(spark, sf_dir, hint):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customers.join(nations.hint(hint), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("jn2_broadcast_hash", _BY_NATION)
def broadcast_hash(spark, sf_dir):
    """The nation table has 25 rows at every scale."""
    return _by_nation(spark, sf_dir, "broadcast")


@query("jn3_sort_merge", _BY_NATION)
def sort_merge(spark, sf_dir):
    return _by_nation(spark, sf_dir, "merge")


@query("jn4_shuffled_hash", _BY_NATION)
def shuffled_hash(spark, sf_dir):
    return _by_nation(spark, sf_dir, "shuffle_hash")


@query(
    "jn5_theta",
    "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
)
def theta(spark, sf_dir):
    """Both sides are the nation table: 25 rows at every scale."""
    a = table(spark, sf_dir, "nation").selectExpr("n_name AS first", "n_regionkey AS r1", "n_nationkey AS k1")
    b = table(spark, sf_dir, "nation").selectExpr("n_name AS second", "n_regionkey AS r2", "n_nationkey AS k2")
    return a.join(F.broadcast(b), (F.col("r1") < F.col("r2")) & (F.col("k1") > F.col("k2"))).select("first", "second")


@query("jn6_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross(spark, sf_dir):
    """Five rows by 25 at every scale; the product is the feature."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


_OUTER = """
    SELECT o_orderkey, s_suppkey, o_totalprice, s_acctbal FROM orders
    {} JOIN (SELECT CASE WHEN s_suppkey % 3 = 0 THEN -1 - s_suppkey ELSE s_suppkey * 2 END AS s_suppkey, s_acctbal FROM supplier) s ON o_orderkey = s_suppkey
"""


def _outer(spark, sf_dir, how):
    """Every third supplier's key is moved below all orders, so that both sides have rows without a partner."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    moved = F.when(F.col("s_suppkey") % 3 == 0, -1 - F.col("s_suppkey")).otherwise(F.col("s_suppkey") * 2)
    suppliers = table(spark, sf_dir, "supplier").select(moved.alias("s_suppkey"), "s_acctbal")
    return orders.join(suppliers, F.col("o_orderkey") == F.col("s_suppkey"), how).select("o_orderkey", "s_suppkey", "o_totalprice", "s_acctbal")


@query("jn7_left", _OUTER.format("LEFT"))
def left(spark, sf_dir):
    return _outer(spark, sf_dir, "left")


@query("jn7_right", _OUTER.format("RIGHT"))
def right(spark, sf_dir):
    return _outer(spark, sf_dir, "right")


@query("jn7_full", _OUTER.format("FULL"))
def full(spark, sf_dir):
    return _outer(spark, sf_dir, "full")


@query("jn8_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn8_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("jn9_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def not_in(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("jn9_part")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("jn9_lines")
    return spark.sql("SELECT p_partkey FROM jn9_part WHERE p_partkey NOT IN (SELECT l_partkey FROM jn9_lines WHERE l_quantity = 50)")


@query(
    "jn10_asof",
    """
    SELECT e.event_id, e.user_id, p.event_id AS last_purchase, p.value AS last_value
    FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)
def asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("last_purchase"), F.col("value").alias("last_value"))
    joined = asof_join(events.select("user_id", "ts", "event_id"), bought, ["user_id"], "ts", "bought_at", ["last_purchase", "last_value"])
    return joined.select("event_id", "user_id", "last_purchase", "last_value")


@query(
    "jn11_interval",
    """
    SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'
    """,
)
def interval(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("at"))
    return interval_join(bought, clicks, "at", "start", "end", 6 * 3600.0, ["user_id"]).select("click", "purchase")


@query(
    "jn11_range_band",
    "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice >= s_acctbal / 10 AND p_retailprice < s_acctbal / 10 + 5",
)
def band(spark, sf_dir):
    """A range join without an equal key: buckets alone make it an equi-join."""
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10).alias("low"), (F.col("s_acctbal") / 10 + 5).alias("high"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return interval_join(parts, spans, "p_retailprice", "low", "high", 5.0).select("s_suppkey", "p_partkey")


@query(
    "jn12_lateral",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL
    (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t
    """,
)
def lateral(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("jn12_customer")
    table(spark, sf_dir, "orders").createOrReplaceTempView("jn12_orders")
    return spark.sql(
        """
        SELECT c_custkey, o_orderkey, o_totalprice FROM jn12_customer, LATERAL
        (SELECT o_orderkey, o_totalprice FROM jn12_orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
        """
    )


@query(
    "jn12_correlated",
    "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
)
def correlated(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("jn12_o")
    return spark.sql("SELECT o_orderkey FROM jn12_o o WHERE o_totalprice > (SELECT 1.8D * avg(o_totalprice) FROM jn12_o i WHERE i.o_custkey = o.o_custkey)")


@query("jn13_containment", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment(spark, sf_dir):
    """Benchmark items that occur whole in a document.

    An item is known by one run of its inner words, up to five: the first and last word may be cut by neighbours. Hashes of
    the documents' runs of each such length meet those of the items in an equi-join; the few pairs that share one are then
    compared exactly. Items of less than three words have no inner word; they alone are compared with every document.
    """
    blank = r"[\x20\x09-\x0D]+"
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.split("text", blank).alias("w"))
    items = items.withColumn("k", F.least(F.size("w") - 2, F.lit(5)))
    joined = lambda w, at, k: F.xxhash64(k, F.concat_ws(" ", F.slice(w, at, k)))
    keyed = items.where("k > 0").select("item_id", "item", "k", joined("w", F.lit(2), F.col("k")).alias("gram"))
    lengths = [r["k"] for r in keyed.select("k").distinct().collect()]  # 1 to 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = F.split("text", blank)
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: joined("w", i, F.lit(k)))
    grams = F.array_distinct(F.concat(*[of_length(k) for k in sorted(lengths)])) if lengths else F.array().cast("array<bigint>")
    met = docs.withColumn("w", w).select("doc_id", F.explode(grams).alias("gram"))
    pairs = met.join(keyed.select("gram", "item_id", "item"), "gram").select("doc_id", "item_id", "item").distinct()
    few = docs.join(items.where("k <= 0").select("item_id", "item"), F.contains("text", "item")).select("doc_id", "item_id")
    return pairs.join(docs, "doc_id").where(F.contains("text", "item")).select("doc_id", "item_id").unionByName(few)


@query("jn14_salted", "SELECT event_type, count(*) AS n, round(sum(w * value), 2) AS total FROM events JOIN (SELECT unnest(['click', 'view', 'error']) AS event_type, unnest([1, 2, 3]) AS w) USING (event_type) GROUP BY event_type")
def salted(spark, sf_dir):
    weights = spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "event_type string, w int")
    joined = salted_join(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), weights, ["event_type"], 8)
    return joined.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("value")), 2).alias("total"))
