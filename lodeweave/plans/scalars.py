"""Scalar functions, text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.functions import vectors as vx
from lodeweave.operators.relational import exact_duplicates, top_k
from lodeweave.plans.registry import query
from lodeweave.session import table


@query(
    "sc1_strings",
    """
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, trim('  ' || p_brand || ' ') AS bare, CAST(length(p_name) AS INTEGER) AS n, md5(p_name) AS digest,
           sha256(p_name) AS sha, CAST(levenshtein(p_name, p_type) AS INTEGER) AS far, replace(p_brand, '#', '-') AS dashed, substr(p_name, 2, 3) AS mid,
           reverse(p_type) AS back, lpad(p_brand, 12, '*') AS padded, CAST(instr(p_name, ' ') AS INTEGER) AS gap, split_part(p_name, ' ', 2) AS second,
           starts_with(p_name, 'blue') AS blue, repeat('ab', p_size % 3) AS twice
    FROM part
    """,
)
def strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("bare"),
        F.length("p_name").alias("n"), F.md5("p_name").alias("digest"), F.sha2("p_name", 256).alias("sha"), F.levenshtein("p_name", "p_type").alias("far"),
        F.replace("p_brand", F.lit("#"), F.lit("-")).alias("dashed"), F.substring("p_name", 2, 3).alias("mid"), F.reverse("p_type").alias("back"),
        F.lpad("p_brand", 12, "*").alias("padded"), F.instr("p_name", " ").alias("gap"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
        F.startswith("p_name", F.lit("blue")).alias("blue"), F.expr("repeat('ab', p_size % 3)").alias("twice"),
    )


@query(
    "sc2_regex",
    """
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs,
           regexp_matches(url, '^https://') AS secure, regexp_replace(url, '[0-9]+', 'N', 'g') AS shape FROM pages
    """,
)
def regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"),
        F.col("url").rlike("^https://").alias("secure"), F.regexp_replace("url", "[0-9]+", "N").alias("shape"),
    )


@query("sc3_url_host", "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@query(
    "sc4_dates",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
           CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS ym,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER) AS left_days, last_day(o_orderdate) AS month_end,
           o_orderdate + INTERVAL 3 MONTH AS later
    FROM orders
    """,
)
def dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.dayofweek("o_orderdate").alias("dow"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), day.alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
        F.datediff(F.lit("2001-12-31").cast("date"), day).alias("left_days"), F.last_day("o_orderdate").alias("month_end"),
        (F.col("o_orderdate") + F.expr("INTERVAL 3 MONTHS")).alias("later"),
    )


@query(
    "sc5_math",
    """
    SELECT s_suppkey, round(s_acctbal, 1) AS r1, CAST(floor(s_acctbal) AS BIGINT) AS down, CAST(ceil(s_acctbal) AS BIGINT) AS up, abs(s_acctbal) AS size,
           CAST(s_suppkey // 7 AS BIGINT) AS seventh, s_suppkey % 7 AS rest, greatest(s_acctbal, 0.0) AS top, least(s_acctbal, 0.0) AS low,
           CAST(sign(s_acctbal) AS DOUBLE) AS sgn, round(sqrt(abs(s_acctbal)), 6) AS root, round(ln(1 + abs(s_acctbal)), 6) AS lg, round(power(s_nationkey, 2), 1) AS square
    FROM supplier
    """,
)
def math(spark, sf_dir):
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(b, 1).alias("r1"), F.floor(b).alias("down"), F.ceil(b).alias("up"), F.abs(b).alias("size"), F.expr("s_suppkey div 7").alias("seventh"),
        (F.col("s_suppkey") % 7).alias("rest"), F.greatest(b, F.lit(0.0)).alias("top"), F.least(b, F.lit(0.0)).alias("low"), F.signum(b).alias("sgn"),
        F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.round(F.log1p(F.abs(b)), 6).alias("lg"), F.round(F.pow("s_nationkey", F.lit(2)), 1).alias("square"),
    )


@query(
    "sc6_arrays",
    """
    SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS length2, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive,
           round(CAST(list_max(embedding) AS DOUBLE), 6) AS most, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings
    """,
)
def arrays(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(vx.dot(e, e), 5).alias("length2"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
        F.round(F.array_max(e).cast("double"), 6).alias("most"), F.round(e[0].cast("double"), 6).alias("first"),
    )


@query("sc7_maps", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50")
def maps(spark, sf_dir):
    parsed = F.map_filter(F.from_json("props", "map<string,int>"), lambda k, v: v > 50)
    return table(spark, sf_dir, "events").select("event_id", F.element_at(parsed, "k").alias("k")).where("k IS NOT NULL")


@query("sc8_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("sc8_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query(
    "sc9_safe",
    """
    SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INTEGER) AS brand, try_cast(p_name AS INTEGER) AS none, p_retailprice / nullif(p_size % 4, 0) AS share,
           coalesce(nullif(p_type, 'ECONOMY'), 'other') AS kind FROM part
    """,
)
def safe(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("try_cast(split_part(p_brand, '#', 2) AS INT)").alias("brand"), F.expr("try_cast(p_name AS INT)").alias("none"),
        F.try_divide("p_retailprice", F.col("p_size") % 4).alias("share"), F.coalesce(F.nullif("p_type", F.lit("ECONOMY")), F.lit("other")).alias("kind"),
    )


@query("tx1_exact_duplicates", "SELECT md5(text) AS digest, min(doc_id) AS first_key, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id").where("copies > 1")


@query("tx4_emails", "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g') AS clean FROM documents WHERE contains(text, '@')")
def emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", tx.redact_emails(F.col("text")).alias("clean"))


#: Keys of known services, long hexadecimal numbers, and quoted values behind a word for a secret.
SECRET = r"\b(sk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,}|\b[0-9a-f]{32,}\b|(token|secret|password|api_key) ?[=:] ?\"[^\"\s]{8,}\""
#: Lines that state a licence or a copyright.
LICENSE = r"(?i)\b(licensed under|license|copyright|all rights reserved|spdx)\b"


@query("tx4_secrets", f"SELECT doc_id, len(regexp_extract_all(text, '{SECRET}')) AS n, md5(regexp_replace(text, '{SECRET}', '<secret>', 'g')) AS clean FROM documents WHERE regexp_matches(text, '{SECRET}')")
def secrets(spark, sf_dir):
    found = table(spark, sf_dir, "documents").where(F.rlike("text", F.lit(SECRET)))
    n = F.regexp_count("text", F.lit(SECRET)).cast("long")
    return found.select("doc_id", n.alias("n"), F.md5(F.regexp_replace("text", SECRET, "<secret>")).alias("clean"))


@query(
    "tx4_license_lines",
    f"""
    SELECT line, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '{LICENSE}') GROUP BY line
    """,
)
def license_lines(spark, sf_dir):
    """Each line that states a licence, with how often it occurs; lines are filtered before they are shuffled."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.rlike("line", F.lit(LICENSE)))
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "tx5_quality_by_source",
    "SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source",
)
def quality(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query(
    "tx6_strip_tags",
    r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain
    FROM pages
    """,
)
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query(
    "tx7_nearest_vectors",
    """
    SELECT q.vec_id AS query_id, d.vec_id AS found_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) DESC, d.vec_id) <= 5
    """,
)
def nearest(spark, sf_dir):
    """Exact search: the stated queries (ids divisible by 100) against all vectors, best five by similarity."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = vectors.crossJoin(asked).where("vec_id <> query_id")
    scored = pairs.select("query_id", F.col("vec_id").alias("found_id"), F.round(vx.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    return top_k(scored, ["query_id"], [F.desc("similarity"), F.col("found_id")], 5)


@query("tx8_word_counts", r"SELECT lower(word) AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text, e' \n\t'), '\s+')) AS word FROM conversations) GROUP BY 1")
def word_counts(spark, sf_dir):
    words = F.explode(F.split(F.btrim("text", F.lit(" \n\t")), r"\s+")).alias("word")
    return table(spark, sf_dir, "conversations").select(words).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


@query(
    "tx9_conversation_turns",
    """
    SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS flow, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id
    """,
)
def turns(spark, sf_dir):
    flow = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), flow.alias("flow"), F.sum(F.length("text")).alias("chars"))
