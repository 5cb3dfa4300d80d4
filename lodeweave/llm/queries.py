"""The subpackage's queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import html_text, jaccard, media, mixing, packing, pii, quality_model, quality_rules, token_files, toxicity
from lodeweave.llm.storage import bound_batches
from lodeweave.session import ship

#: Stands for the secret that a deployment keeps; replacements can't be linked to entities without it.
PII_KEY = "lodeweave-demo-key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_media(spark, sf_dir):
    return media.text_media(_table(spark, sf_dir, "documents")).drop("tile")


@_query
def op2_jaccard_join(spark, sf_dir):
    return jaccard.join(_table(spark, sf_dir, "documents"))


@_query
def op3_token_files(spark, sf_dir):
    return token_files.token_table(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@_query
def op4_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in pii.PATTERNS]
    replaced = pii.replace_entities(docs, key=PII_KEY)
    return replaced.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_entities"), *counts)


def _remainder(n: int):
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


@_query
def op5_quality_classifier(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(_remainder(5) != 0)
    scored = quality_model.classify(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


@_query
def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))


@_query
def op7_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op8_mixing(spark, sf_dir):
    return mixing.taken(_table(spark, sf_dir, "documents"))


@_query
def op9_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


@_query
def op10_toxicity(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(_remainder(4) != 2)
    scored = toxicity.classify(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM lowered),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT sizes.doc_id, sizes.n AS n_shingles, least(sizes.doc_id, coalesce(first, sizes.doc_id)) AS component_id
FROM sizes LEFT JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) f ON f.a = sizes.doc_id
"""


def _quality_rules_statement(rounds: int = 50, belief: float = 0.02, prior: float = 0.85, n_rules: int = 10) -> str:
    """Counts, votes, expectation maximisation on vote patterns, and verdicts, as one statement."""
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    without = lambda letters: f"length(translate(t, {letters}, ''))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    start = {True: {1: 0.78, 0: 0.215, -1: 0.005}, False: {1: 0.6, 0: 0.2, -1: 0.2}}
    first = ", ".join(f"({c}, {v}, {p}::DOUBLE)" for c, of in ((1, start[True]), (0, start[False])) for v, p in of.items())
    return rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
windows AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
again AS (SELECT id, i FROM windows JOIN (SELECT id, g FROM windows GROUP BY id, g HAVING count(*) > 1) USING (id, g)),
covered AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY id),
counted AS (
  SELECT id, doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stops,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, {without(blanks)} AS word_chars, length(t) - {without(f"'{quality_rules.SYMBOLS}'")} AS n_symbols,
         length(t) - {without(f"'{upper}'")} AS n_upper, length(t) - {without("'!'")} AS n_shouts, length(t) - {without(f"'{digits}'")} AS n_digits,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{Ll}}[.,;:?]?$'))) AS n_plain
  FROM texts LEFT JOIN covered USING (id)),
rates AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean, n_symbols / nullif(n_words, 0) AS sym, n_shouts / nullif(n_words, 0) AS sho, n_upper / nullif(word_chars, 0) AS upp,
         n_repeat_words / nullif(n_words, 0) AS rep, n_dup_lines / nullif(n_lines, 0) AS dup, n_plain / nullif(n_words, 0) AS pla, n_stops / nullif(n_words, 0) AS sto,
         n_digits / nullif(word_chars, 0) AS dig, n_distinct / sqrt(nullif(n_words, 0)) AS var
  FROM counted),
ballots AS (
  SELECT *, [CASE WHEN mean < 2 OR mean > 16 THEN -1 WHEN mean >= 3 AND mean <= 10 THEN 1 ELSE 0 END, CASE WHEN sym > 0.15 THEN -1 WHEN sym <= 0.03 THEN 1 ELSE 0 END,
    CASE WHEN sho > 0.2 THEN -1 WHEN sho <= 0.03 THEN 1 ELSE 0 END, CASE WHEN upp > 0.3 THEN -1 WHEN upp <= 0.1 THEN 1 ELSE 0 END,
    CASE WHEN rep > 0.4 THEN -1 WHEN rep <= 0.2 THEN 1 ELSE 0 END, CASE WHEN dup > 0.4 THEN -1 WHEN dup <= 0.1 THEN 1 ELSE 0 END,
    CASE WHEN pla < 0.65 THEN -1 WHEN pla >= 0.85 THEN 1 ELSE 0 END, CASE WHEN sto < 0.02 THEN -1 WHEN sto >= 0.08 THEN 1 ELSE 0 END,
    CASE WHEN dig > 0.25 THEN -1 WHEN dig <= 0.05 THEN 1 ELSE 0 END, CASE WHEN var < 2.5 THEN -1 WHEN var >= 4 THEN 1 ELSE 0 END] AS votes FROM rates),
patterns AS (SELECT votes, count(*)::DOUBLE AS n FROM ballots WHERE n_words > 0 GROUP BY votes),
long AS (SELECT votes, n, r, votes[r] AS v FROM (SELECT votes, n, unnest(range(1, {n_rules} + 1)) AS r FROM patterns)),
total AS (SELECT sum(n) AS n FROM patterns),
start AS (SELECT * FROM (VALUES {first}) s(c, v, p)),
em(round, prior, chances) AS (
  SELECT 0, {prior}::DOUBLE, (SELECT map_from_entries(list((r * 100 + c * 10 + v + 1, p))) FROM start, (SELECT unnest(range(1, {n_rules} + 1)) AS r))
  UNION ALL
  SELECT round + 1, new_prior, chances2 FROM (
    WITH post AS (
      SELECT em.round, votes, any_value(n) AS n, 1 / (1 + exp(-(ln(any_value(prior) / (1 - any_value(prior))) + sum(ln(chances[r * 100 + 10 + v + 1] / chances[r * 100 + v + 1]))))) AS p
      FROM em, long WHERE em.round < {rounds} GROUP BY em.round, votes),
    mass AS (
      SELECT r, c, s.v, any_value(({belief} * total.n + 1) * s.p) + coalesce(sum(CASE WHEN long.v = s.v THEN post.n * CASE WHEN c = 1 THEN post.p ELSE 1 - post.p END END), 0) AS m
      FROM long JOIN post USING (votes), start s, total GROUP BY r, c, s.v)
    SELECT (SELECT any_value(round) FROM post) AS round, (SELECT least(greatest((sum(n * p) + 1) / (sum(n) + 2), 0.01), 0.99) FROM post) AS new_prior,
           (SELECT map_from_entries(list((r * 100 + c * 10 + v + 1, m / whole))) FROM (SELECT *, sum(m) OVER (PARTITION BY r, c) AS whole FROM mass)) AS chances2)
  WHERE round IS NOT NULL),
final AS (SELECT * FROM em ORDER BY round DESC LIMIT 1),
scored AS (
  SELECT votes, 1 / (1 + exp(-(ln(any_value(prior) / (1 - any_value(prior))) + sum(ln(chances[r * 100 + 10 + votes[r] + 1] / chances[r * 100 + votes[r] + 1]))))) AS p
  FROM (SELECT votes, unnest(range(1, {n_rules} + 1)) AS r FROM (SELECT DISTINCT votes FROM ballots)), final GROUP BY votes),
verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM ballots JOIN scored USING (votes))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS probability FROM verdicts
"""


ORACLES["op6_quality_rules"] = _quality_rules_statement()
