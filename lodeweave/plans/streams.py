"""Streaming queries, each against the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeweave.plans.registry import query
from lodeweave.session import ship, table
from lodeweave.sources.files import scratch
from lodeweave.streaming import streams as st


def _start(name="window"):
    return F.col(name)["start"].cast("timestamp_ntz").alias("start")


@query(
    "st1_tumbling",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def tumbling(spark, sf_dir):
    out = st.settle(st.tumbling(st.events(spark, sf_dir, None), "1 hour", "event_type"), "complete")
    return out.select(_start(), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "st2_sliding",
    """
    SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY start
    """,
)
def sliding(spark, sf_dir):
    out = st.settle(st.sliding(st.events(spark, sf_dir, None), "12 hours", "6 hours"), "complete")
    return out.select(_start(), "n")


@query(
    "st3_sessions",
    """
    WITH marked AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM numbered GROUP BY user_id, s
    """,
)
def sessions(spark, sf_dir):
    out = st.settle(st.sessions(st.events(spark, sf_dir), "6 hours", "user_id"), "complete")
    return out.select("user_id", _start("session_window"), "n")


@query("st4_deduplicated", "SELECT user_id, event_type FROM events GROUP BY ALL")
def deduplicated(spark, sf_dir):
    """With a watermark longer than the data, one row of each key."""
    return st.settle(st.first_of_each(st.events(spark, sf_dir, "400 days"), "user_id", "event_type").select("user_id", "event_type"))


@query(
    "st5_stream_join",
    """
    SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'
    """,
)
def stream_join(spark, sf_dir):
    clicks = st.events(spark, sf_dir).where("event_type = 'click'")
    bought = st.events(spark, sf_dir).where("event_type = 'purchase'")
    joined = st.interval_join(clicks, bought, "user_id", "ts", "ts", "6 HOURS")
    return st.settle(joined.select(F.col("l.event_id").alias("click"), F.col("r.event_id").alias("purchase")))


@query("st6_complete_mode", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def complete_mode(spark, sf_dir):
    return st.settle(st.events(spark, sf_dir, None).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("st7_keyed_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def keyed_state(spark, sf_dir):
    """The last state that the stream gave out for each key."""
    ship(spark)
    out = st.settle(st.running_totals(st.events(spark, sf_dir, None).select("user_id", "value"), "user_id"))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("st7_rocksdb_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def rocksdb_state(spark, sf_dir):
    ship(spark)
    with st.rocksdb(spark):
        out = st.settle(st.running_totals_in_rocksdb(st.events(spark, sf_dir, None).select("user_id", "value"), "user_id"))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("st9_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def memory_sink(spark, sf_dir):
    """The memory sink holds its result on the driver: here a row per event type."""
    counts = st.events(spark, sf_dir, None).groupBy("event_type").agg(F.count("*").alias("n"))
    name = f"st9_{uuid.uuid4().hex}"
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(
    "st8_late_data",
    """
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1
    """,
)
def late_data(spark, sf_dir):
    """Days closed by the watermark do not change when rows of them come late.

    The rows are split into an early file, a file that moves the watermark and
    closes the first days, and a file of repeats that are too late to count.
    """
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, out, state = (scratch(spark, x) for x in ("late-inbox", "late-out", "late-state"))
    first = rows.where("ts < '2024-01-11'")
    first.limit(0).write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).parquet(inbox).withWatermark("ts", "1 hour")
    days = stream.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    for batch in (first, rows.where("ts >= '2024-01-12'"), first.limit(50), rows.limit(0).unionByName(rows.where("ts >= '2024-01-12'").limit(1))):
        batch.write.mode("append").parquet(inbox)
        days.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).format("parquet").start(out).awaitTermination()
    closed = spark.read.schema(days.schema).parquet(out)
    return closed.where("window.start < '2024-01-11'").select(_start(), "n")
