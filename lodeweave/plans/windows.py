"""Window functions, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.operators.relational import sessionize
from lodeweave.plans.registry import query
from lodeweave.session import table


@query(
    "wn1_ranks",
    """
    SELECT s_suppkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER r AS INTEGER) AS rk, CAST(dense_rank() OVER r AS INTEGER) AS dr,
           CAST(ntile(4) OVER w AS INTEGER) AS quarter, percent_rank() OVER r AS pr, cume_dist() OVER r AS cd
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 5 ORDER BY s_acctbal, s_suppkey), r AS (PARTITION BY s_nationkey % 5 ORDER BY round(s_acctbal / 1000))
    """,
)
def ranks(spark, sf_dir):
    group = F.col("s_nationkey") % 5
    w = Window.partitionBy(group).orderBy("s_acctbal", "s_suppkey")
    r = Window.partitionBy(group).orderBy(F.round(F.col("s_acctbal") / 1000))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.row_number().over(w).alias("rn"), F.rank().over(r).alias("rk"), F.dense_rank().over(r).alias("dr"),
        F.ntile(4).over(w).alias("quarter"), F.percent_rank().over(r).alias("pr"), F.cume_dist().over(r).alias("cd"),
    )


@query(
    "wn2_offsets",
    """
    SELECT event_id, lag(value, 1, 0.0) OVER w AS before, lead(event_type) OVER w AS next_type, first_value(event_id) OVER w AS first_id,
           nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    """,
)
def offsets(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("value", 1, 0.0).over(w).alias("before"), F.lead("event_type").over(w).alias("next_type"),
        F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(whole).alias("second_id"),
    )


@query(
    "wn3_rows_frame",
    """
    SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving,
           count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM events
    """,
)
def rows_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("moving"), F.count("*").over(w.rowsBetween(1, 3)).alias("ahead")
    )


@query(
    "wn4_range_frame",
    """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_a_day FROM events
    """,
)
def range_frame(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("wn4_events")
    return spark.sql(
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_a_day FROM wn4_events"
    )


@query(
    "wn5_sessionize",
    """
    SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
    FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 1 ELSE 0 END AS new FROM events)
    """,
)
def sessions(spark, sf_dir):
    return sessionize(table(spark, sf_dir, "events"), ["user_id"], "ts", "8 HOURS").select("event_id", "session")


@query("so1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return _keys(spark, sf_dir, "customer", "c_nationkey").unionAll(_keys(spark, sf_dir, "supplier", "s_nationkey"))


@query("so1_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, sf_dir):
    return _keys(spark, sf_dir, "customer", "c_nationkey").union(_keys(spark, sf_dir, "supplier", "s_nationkey")).distinct()


@query("so2_intersect", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice < 50000")
def intersect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 300000").selectExpr("o_custkey AS k").intersect(orders.where("o_totalprice < 50000").selectExpr("o_custkey AS k"))


@query("so2_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, sf_dir):
    return _keys(spark, sf_dir, "customer", "c_nationkey").intersectAll(_keys(spark, sf_dir, "supplier", "s_nationkey"))


@query("so2_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k").subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 45").selectExpr("l_partkey"))


@query("so2_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, sf_dir):
    return _keys(spark, sf_dir, "customer", "c_nationkey").exceptAll(_keys(spark, sf_dir, "supplier", "s_nationkey"))


def _keys(spark, sf_dir, name, column):
    return table(spark, sf_dir, name).select(F.col(column).alias("k"))


@query(
    "so3_recursive",
    """
    WITH RECURSIVE walk(start, here, steps) AS (
      SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_regionkey = 0
      UNION ALL SELECT start, (here * 7 + 3) % 25, steps + 1 FROM walk WHERE steps < 6)
    SELECT start, here, steps FROM walk
    """,
)
def recursive(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("so3_nation")
    return spark.sql(
        """
        WITH RECURSIVE walk(start, here, steps) AS (
          SELECT n_nationkey, n_nationkey, 0 FROM so3_nation WHERE n_regionkey = 0
          UNION ALL SELECT start, (here * 7 + 3) % 25, steps + 1 FROM walk WHERE steps < 6)
        SELECT start, here, steps FROM walk
        """
    )
