"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are of whole texts, computed batch by batch. A Gaussian
kernel over the standardised statistics is approximated by random cosines; each
partition of the training rows sums its part of the normal equations, and the
driver adds at most ``fit_tasks`` of those sums (each ``features + 1`` squared).
Scores are calibrated by isotonic regression on rows that the scored fold was not
fitted on.

Training rows are the labelled ones the caller passes, thinned by a hash of the
id to about ``max_rows``; every document is scored. Labels are joined by doc_id;
repeated ids train on each of their rows, and an id's label is the smallest given.
A null text counts as empty, and empty texts get a score like any other. Without
labels of both classes every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm.storage import materialize, release
from lodeweave.llm.words import distinct_per_row, words

#: Common function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des du et un une en que qui dans pour pas sur au avec est par plus il elle "
    "el los las del y que en un una por con no para se su al lo como".split()
)
#: Byte classes counted per text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "symbol": b"#*$%&<>@^~=+_\\/{}[]",
    "bar": b"|",
    "quote": b"\"'()",
    "line": b"\n",
    "continued": bytes(range(128, 192)),
}
STATISTICS = [
    "log_chars", "log_words", "mean_word", *[c for c in CLASSES if c != "continued"], "stop_words", "distinct", "variety",
    "pairs_again", "lines_again", "line_words", "ends",
]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    table = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES.values()):
        table[list(members), k] = 1
    counts = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(n, 256) @ table
    found = dict(zip(CLASSES, counts.T))
    chars = np.diff(offsets) - found.pop("continued")
    w = words(texts)
    n_words = w.counts()
    per_word, per_char = 1 / np.maximum(n_words, 1), 1 / np.maximum(chars, 1)
    is_stop = np.fromiter((x.lower().strip(".,;:!?") in STOP_WORDS for x in w.distinct), float, len(w.distinct))
    ends = np.fromiter((x[-1:] in ".!?" and x != "" for x in w.distinct), float, len(w.distinct))
    distinct = distinct_per_row(w.rows, w.index, n)
    same = w.rows[1:] == w.rows[:-1]
    pairs = (w.index[:-1] * len(w.distinct) + w.index[1:])[same]
    pair_rows = w.rows[1:][same]
    n_pairs = np.bincount(pair_rows, minlength=n)
    lines = pc.split_pattern(texts, "\n")
    n_lines = np.diff(np.asarray(lines.offsets))
    line_key = np.asarray(lines.flatten().dictionary_encode().indices).astype(np.int64)
    own_lines = distinct_per_row(np.repeat(np.arange(n), n_lines), line_key, n)
    columns = [
        np.log1p(chars), np.log1p(n_words), np.minimum((chars - found["line"]) * per_word, 40),
        *[c * per_char for c in found.values()], w.per_row(is_stop) * per_word, distinct * per_word, distinct / np.sqrt(np.maximum(n_words, 1)),
        1 - distinct_per_row(pair_rows, pairs, n) / np.maximum(n_pairs, 1), 1 - own_lines / np.maximum(n_lines, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)), w.per_row(ends) * per_word,
    ]
    return np.column_stack(columns).astype(np.float64)


def _statistics_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``f``, the statistics of ``text``, of every row."""
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                f = statistics(rows.column("text"))
                values = pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), f.astype(np.float32).ravel())
                yield pa.record_batch([*(rows.column(c) for c in keep), values], [*keep, "f"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "f array<float>"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


class FourierRidge:
    """Random cosine features of standardised statistics; ridge weights from summed normal equations."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, 1 / (width * np.sqrt(len(mean))), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.deviation, -6, 6)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.column_stack([z, np.ones(len(z))])

    @staticmethod
    def solve(a: np.ndarray, v: np.ndarray, ridge: float) -> np.ndarray:
        return np.linalg.solve(a + ridge * np.eye(len(v)), v)

    def score(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(f) @ self.weights, *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing means of y (weights n) over ascending x."""
    blocks: list[list[float]] = []
    for at, mean, weight in zip(x, y, n):
        blocks.append([mean, weight, at * weight])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, s = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + s]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 100_000, fit_tasks: int = 12, features: int = 256, width: float = 1.0, ridge: float = 1e-2, seed: int = 11
) -> FourierRidge | float:
    """docs: doc_id, text. labels: doc_id, label (0 or 1). ``max_rows`` bounds the ids fitted on, to within sampling error."""
    given = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    counts = given.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not counts["n"] or counts["share"] in (0.0, 1.0):
        return 0.5 if counts["share"] is None else float(counts["share"])
    share = min(1.0, max_rows / counts["n"])
    sample = given.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).alias("fold")
    # at most about max_rows ids go to every task; the texts stay where they are read
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", fold)
    rows = materialize(_statistics_of(rows, ["label", "fold"]).repartition(fit_tasks), "quality-train")
    size = len(STATISTICS)
    sums = rows.agg(*[F.avg(F.get("f", F.lit(i))).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(F.get("f", F.lit(i))).alias(f"d{i}") for i in range(size)]).first()
    if sums["m0"] is None:
        return float(counts["share"])
    model = FourierRidge(np.array(sums[:size], float), np.array(sums[size:], float), features, width, seed)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, v = np.zeros((2, features + 1, features + 1)), np.zeros((2, features + 1))
        for batch in batches:
            z, y, fold = model.features(_matrix(batch.column("f"))), np.asarray(batch.column("label")), np.asarray(batch.column("fold"))
            for k in (0, 1):
                own = z[fold == k]
                a[k] += own.T @ own
                v[k] += own.T @ y[fold == k]
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["a", "v"])

    a, v = np.zeros((2, features + 1, features + 1)), np.zeros((2, features + 1))
    for part in rows.mapInArrow(equations, "a binary, v binary").toLocalIterator():  # at most fit_tasks parts, of fixed size
        a += np.frombuffer(part["a"]).reshape(a.shape)
        v += np.frombuffer(part["v"]).reshape(v.shape)
    model.weights = model.solve(a.sum(0), v.sum(0), ridge)
    crossed = [model.solve(a[1 - k], v[1 - k], ridge) for k in (0, 1)]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.features(_matrix(batch.column("f"))), np.asarray(batch.column("fold"))
            raw = np.where(fold == 0, z @ crossed[0], z @ crossed[1])
            yield pa.record_batch([pa.array(np.clip(np.rint(raw * 400), -400, 800).astype(np.int32)), batch.column("label")], ["bin", "label"])

    steps = rows.mapInArrow(held, "bin int, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most 1201 bins
    model.steps = isotonic(*(np.array([float(s[c]) for s in steps]) for c in ("bin", "y", "n")))
    model.steps = (model.steps[0] / 400, model.steps[1])
    return model


def score(docs: DataFrame, model: FourierRidge | float) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with the ``score`` of its text."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    if isinstance(model, float):
        return packed.select("row", F.lit(model).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                yield pa.record_batch([rows.column("row"), pa.array(model.score(statistics(rows.column("text"))))], ["row", "score"])
        release()

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Fit on ``labels`` (doc_id, label) and score every row of docs (doc_id, text): doc_id, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("row.doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
