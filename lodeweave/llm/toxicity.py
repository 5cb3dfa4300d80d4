"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicons (given insults, plain and obfuscated; words and word beginnings
that training shows to be far commoner in toxic texts, dealt to several lists;
those that are somewhat commoner, which count where a text has more of them than
chance brings) and patterns (insults near a pronoun of address, their density, the
balance of evidence over all words). Each votes toxic, not toxic, or abstains; the
annotators are one more voter, believed to be right mostly. The label
model has a latent class and lets each voter depend on the class and on the one
other voter it is most correlated with (a tree); expectation maximisation fits
it to the votes. Its posterior labels train a logistic classifier on the voters'
counts, which scores every text.

Training uses the labelled rows that the caller passes, thinned by a hash of the
id to about ``max_rows`` documents; that bounds all that comes to the driver.
A lexicon's entries are chosen by significance alone. Each is in one in fifty of the
toxic training texts or more, so there are at most fifty times as many as such a
text has on average, however large the corpus; that is the bound on what is sent to tasks.

Null and empty texts have no words; they get the score of a text without any
vote. Repeated rows are scored alike. Without labels the given insults decide.
Columns but doc_id and text are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.storage import materialize
from lodeweave.llm.words import Words, words

#: Fixed word list: common insults of the languages served.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum scumbag trash pathetic worthless disgusting clown fool foolish jerk creep "
    "freak filthy vile vermin imbecile retard bastard bitch asshole asshat bullshit fuck fucking shit shitty cunt dick douche slut whore twat wanker "
    "dumm dummkopf trottel arschloch arsch abschaum ekelhaft versager widerlich wertlos erbärmlich hässlich scheiße scheiss wichser hurensohn depp spinner "
    "imbécile crétin débile ordure pathétique dégoûtant salaud salope connard connasse merde minable stupide putain abruti enculé racaille "
    "idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso perdedor tonto tonta mierda puta puto cabrón pendejo gilipollas maricón".split()
)
ADDRESS = frozenset("you your you're youre du dich dir dein deine ihr tu te toi ton ta vous votre tú ti tus eres usted su".split())
LISTS = 4
_LEET = str.maketrans("013457@$!|", "oieastasil")
_TRIM = re.compile(r"^[^\w$@]+|\W+$")
_TWICE = re.compile(r"(.)\1{2,}")

COUNTS = ["insults", "hidden", *[f"words{i}" for i in range(LISTS)], *[f"stems{i}" for i in range(LISTS)], "near", "shouted", "evidence", "weak", "excess", "n_words"]


def bare(word: str) -> str:
    return _TRIM.sub("", word).lower()


def plain(word: str) -> str:
    """A word with digits and signs read as letters and drawn-out letters shortened."""
    return _TWICE.sub(r"\1", re.sub(r"[._-]", "", word.lower()).translate(_LEET))


def masked(word: str) -> bool:
    """Is this an insult with some inner letters starred out?"""
    return "*" in word and any(len(w) == len(word) and all(a in ("*", b) for a, b in zip(word, w)) for w in INSULTS)


def stems(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters, marked as such. Words with digits have none."""
    if not word.isalpha() or len(word) < 4:
        return []
    return [word, *[word[:k] + "*" for k in (4, 5, 6) if len(word) > k]]


def log_lift(a: int, b: int, n1: int, n0: int) -> tuple[float, float]:
    """Log of how much commoner a stem is in toxic texts (a of n1) than in others (b of n0), and two deviations less."""
    odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    return odds, odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


class Lexicon:
    """Stems with their log odds, dealt to lists by a checksum; ``weak`` ones, and how often a word of a clean and of a toxic text has one."""

    def __init__(self, weights: dict[str, float], weak: frozenset[str] = frozenset(), rates: tuple[float, float] = (1e-3, 1e-2)):
        self.weights, self.weak, self.rates = weights, weak, rates
        self.lists = {s: zlib.crc32(s.encode()) % LISTS for s in weights}

    def counts(self, found: Words) -> np.ndarray:
        """A row of COUNTS for each text."""
        per = np.zeros((len(COUNTS), len(found.distinct)))
        at = {c: i for i, c in enumerate(COUNTS)}
        address = np.zeros(len(found.distinct), bool)
        for k, raw in enumerate(found.distinct):
            word = bare(raw)
            if not word:
                continue
            address[k] = word in ADDRESS
            known = word in INSULTS
            per[at["insults"], k] = known
            if not known and not word.isalpha() and (plain(word) in INSULTS or masked(word)):
                per[at["hidden"], k] = 1
            hit, evidence = known, 0.0
            for s in stems(word):
                w = self.weights.get(s)
                if w is not None:
                    kind = "stems" if s.endswith("*") else "words"
                    per[at[f"{kind}{self.lists[s]}"], k] = 1
                    evidence, hit = max(evidence, w), True
            per[at["evidence"], k] = evidence
            per[at["weak"], k] = not hit and any(s in self.weak for s in stems(word))
            per[at["shouted"], k] = hit and raw.upper() == raw and any(c.isalpha() for c in raw)
        out = np.column_stack([found.per_row(p) for p in per]) if len(found.distinct) else np.zeros((found.n_rows, len(COUNTS)))
        out[:, at["n_words"]] = found.counts()
        low, high = self.rates  # log likelihood ratio of the weak stems met, as chance would bring them to a toxic and to a clean text
        out[:, at["excess"]] = out[:, at["weak"]] * math.log(high / low) - out[:, at["n_words"]] * (high - low)
        if len(found.index):  # a listed word within three words of a pronoun of address
            listed = (per[at["evidence"]] + per[at["insults"]])[found.index] > 0
            near = np.zeros(len(listed), bool)
            spoken = address[found.index]
            for gap in (1, 2, 3):
                same = found.rows[gap:] == found.rows[:-gap]
                near[gap:] |= listed[gap:] & spoken[:-gap] & same
                near[:-gap] |= listed[:-gap] & spoken[gap:] & same
            out[:, at["near"]] = np.bincount(found.rows[near], minlength=found.n_rows)
        return out


def votes(counts: np.ndarray) -> np.ndarray:
    """Each voter's vote on each text: 0 not toxic, 1 abstains, 2 toxic."""
    c = dict(zip(COUNTS, counts.T))
    n = np.maximum(c["n_words"], 1)
    any_ = c["insults"] + c["hidden"] + sum(c[f"words{i}"] + c[f"stems{i}"] for i in range(LISTS))
    quiet = (c["excess"] < 3) | (c["weak"] < 2)
    clear = (any_ == 0) & (c["n_words"] >= 20) & quiet
    backed = (any_ >= 2) | (c["insults"] > 0)  # one learnt word or beginning alone may be chance
    ballots = [np.where(c["insults"] > 0, 2, np.where(clear, 0, 1)), np.where(c["hidden"] > 0, 2, 1)]
    ballots += [np.where((c[f"{kind}{i}"] > 0) & backed, 2, 1) for kind in ("words", "stems") for i in range(LISTS)]
    ballots += [np.where((c[x] > 0) & backed, 2, 1) for x in ("near", "shouted")]
    ballots.append(np.where((any_ / n >= 0.01) & backed, 2, np.where((any_ / n < 0.002) & quiet, 0, 1)))
    ballots.append(np.where((c["evidence"] >= 3) & backed, 2, np.where((c["evidence"] < 0.5) & quiet, 0, 1)))
    ballots.append(np.where(~quiet, 2, np.where(c["excess"] < -1, 0, 1)))
    return np.column_stack(ballots).astype(np.int64)


class LabelModel:
    """Latent class with a tree of voters: P(vote | class, vote of its parent)."""

    def __init__(self, prior: float, rounds: int = 25, smooth: float = 1.0, trusted: tuple[int, ...] = (), trust: float = 0.998, belief: float = 4.0):
        """``trusted`` voters are believed to be right with chance ``trust``, with the weight of ``belief`` times the rows."""
        self.prior, self.rounds, self.smooth = prior, rounds, smooth
        self.trusted, self.trust, self.belief = trusted, trust, belief

    def _fit_tables(self, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        self.tables = []
        for i, parent in enumerate(self.parents):
            up = v[:, parent] if parent >= 0 else np.zeros(len(v), np.int64)
            table = np.full((2, 3, 3), self.smooth)
            if i in self.trusted:
                weight = self.belief * n.sum()
                for c, vote in ((1, 2), (0, 0)):
                    share = weight * (self.prior if c else 1 - self.prior)
                    table[c, :, vote] += share * self.trust
                    table[c, :, 2 - vote] += share * (1 - self.trust)
            np.add.at(table, (1, up, v[:, i]), n * p)
            np.add.at(table, (0, up, v[:, i]), n * (1 - p))
            self.tables.append(table / table.sum(2, keepdims=True))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for i, parent in enumerate(self.parents):
            up = v[:, parent] if parent >= 0 else np.zeros(len(v), np.int64)
            odds += np.log(self.tables[i][1, up, v[:, i]] / self.tables[i][0, up, v[:, i]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def _tree(self, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> list[int]:
        """Maximum spanning tree over the voters' mutual information given the class."""
        k = v.shape[1]
        info = np.zeros((k, k))
        for i in range(k):
            for j in range(i):
                for w in (n * p, n * (1 - p)):
                    joint = np.zeros((3, 3))
                    np.add.at(joint, (v[:, i], v[:, j]), w)
                    total = joint.sum()
                    if total > 0:
                        q = joint / total
                        m = q.sum(1, keepdims=True) * q.sum(0, keepdims=True)
                        seen = q > 0
                        info[i, j] += total * (q[seen] * np.log(q[seen] / m[seen])).sum()
        info = (info + info.T) / max(n.sum(), 1)
        parents, inside = [-1] * k, [0]
        while len(inside) < k:
            value, i, j = max((info[i, j], i, j) for i in inside for j in range(k) if j not in inside)
            parents[j] = i if value > 1e-4 else -1
            inside.append(j)
        return parents

    def fit(self, ballots: np.ndarray) -> LabelModel:
        v, n = np.unique(ballots, axis=0, return_counts=True)
        n = n.astype(float)
        k = v.shape[1]
        self.parents = [-1] * k
        strength = (v == 2).sum(1) - (v == 0).sum(1)
        p = np.where(strength > 0, 0.95, np.where((v == 2).any(1), 0.5, 0.02))
        for tree in (False, True):  # independent voters first; their posterior then tells which are correlated
            if tree:
                self.parents = self._tree(v, n, p)
            for _ in range(self.rounds):
                self._fit_tables(v, n, p)
                self.prior = float(np.clip((n * p).sum() / n.sum(), 0.005, 0.6))
                p = self.posterior(v)
        return self

    def accuracy(self, ballots: np.ndarray) -> np.ndarray:
        """Chance that each voter is right where it votes, by the posterior labels."""
        p = self.posterior(ballots)[:, None]
        right = ((ballots == 2) * p + (ballots == 0) * (1 - p)).sum(0)
        return right / np.maximum((ballots != 1).sum(0), 1)


def inputs(counts: np.ndarray) -> np.ndarray:
    """The classifier's inputs: voters' counts and rates on log scales, and a constant."""
    n = np.maximum(counts[:, -1:], 1)
    hits, excess = counts[:, :-2], np.clip(counts[:, -2:-1], 0, 10)
    more = (excess >= 3) & (counts[:, [COUNTS.index("weak")]] >= 2)
    given = hits[:, :2].sum(1)
    learnt = hits[:, 2 : 2 + 2 * LISTS]
    sums = np.column_stack([given, learnt[:, :LISTS].sum(1), learnt[:, LISTS:].sum(1), hits[:, COUNTS.index("evidence")]])
    rates = np.column_stack([np.minimum(100 * sums / n, 10), np.minimum(sums, 10), sums >= 1, sums >= 2, sums >= 4])
    return np.column_stack([np.log1p(hits), np.log1p(1000 * hits / n), rates, excess * more, 4 * more, np.log1p(n), np.ones(len(counts))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts: pa.Array) -> np.ndarray:
        z = inputs(self.lexicon.counts(words(texts))) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _stem_counts(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """stem, n: texts that hold each stem. Counted per batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column("text"))
            total: Counter = Counter()
            own = [[s for s in stems(bare(w)) if among is None or s in among] for w in found.distinct]
            cuts = np.flatnonzero(np.diff(found.rows, prepend=-1)) if len(found.rows) else np.empty(0, int)
            for part in np.split(found.index, cuts[1:]) if len(cuts) else []:
                total.update({s for k in set(part.tolist()) for s in own[k]})
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["stem", "n"])

    return rows.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, fit_tasks: int = 24) -> Model:
    """docs: doc_id, text. labels: doc_id, label (1 toxic, 0 not)."""
    given = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    known = given.count()
    share = min(1.0, max_rows / known) if known else 0.0
    sample = given.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_rows ids go to every task; the texts stay where they are read
    rows = docs.select("text", "doc_id").where("text is not null").join(F.broadcast(sample), "doc_id")
    # a text counts once, however many copies it has and ids they bear
    rows = rows.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    rows = materialize(rows.select("text", "label").repartition(fit_tasks), "toxic-train")
    sizes = dict(rows.groupBy("label").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 + n0:
        lexicon = Lexicon({})
        weights = np.zeros(inputs(np.zeros((1, len(COUNTS)))).shape[1])
        weights[0], weights[1], weights[-1] = 4.0, 4.0, -2.5  # an insult decides
        return Model(lexicon, weights)
    chosen: dict[str, float] = {}
    weak: set[str] = set()
    if n1 and n0:
        least = max(5, 0.02 * n1)
        toxic = dict(_stem_counts(rows.where("label = 1"), None).where(F.col("n") >= least).collect())  # at most fifty times a text's own
        other = dict(_stem_counts(rows.where("label = 0"), frozenset(toxic)).collect())
        for stem, a in toxic.items():
            odds, sure = log_lift(a, other.get(stem, 0), n1, n0)
            if odds >= math.log(20) and sure >= math.log(6):
                chosen[stem] = odds
            elif odds >= math.log(5) and sure >= math.log(2.5) and stem not in ADDRESS:
                weak.add(stem)
    lexicon = Lexicon(chosen, frozenset(weak))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = lexicon.counts(words(batch.column("text"))).astype(np.float32)
            yield pa.record_batch([pa.array([r.tobytes() for r in c], pa.binary()), batch.column("label")], ["c", "label"])

    raw = rows.mapInArrow(count, "c binary, label int").collect()  # about max_rows rows of fixed size
    counts = np.frombuffer(b"".join(r["c"] for r in raw), np.float32).reshape(-1, len(COUNTS)).astype(np.float64)
    given_labels = np.fromiter((r["label"] for r in raw), np.int64, len(raw))
    at = {c: i for i, c in enumerate(COUNTS)}
    rate = lambda label: (counts[given_labels == label, at["weak"]].sum() + 0.5) / (counts[given_labels == label, at["n_words"]].sum() + 100)
    if weak and rate(1) > 1.5 * rate(0):
        lexicon.rates = (rate(0), rate(1))
    low, high = lexicon.rates
    counts[:, at["excess"]] = counts[:, at["weak"]] * math.log(high / low) - counts[:, at["n_words"]] * (high - low)
    ballots = votes(counts)
    ballots = np.column_stack([ballots, 2 * given_labels])  # the annotators are one more voter
    label_model = LabelModel(prior=max(0.01, n1 / (n0 + n1)), trusted=(ballots.shape[1] - 1,)).fit(ballots)
    return Model(lexicon, logistic(inputs(counts), label_model.posterior(ballots)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                rows = batch.slice(at, 8192)
                yield pa.record_batch([rows.column(0), pa.array(model.score(rows.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Fit on ``labels`` (doc_id, label) and score every row of ``docs``: doc_id, score, predicted."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
