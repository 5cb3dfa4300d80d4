"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs them.

Everything that touches rows is a native expression. ``text_statistics`` counts
over whole texts, ``votes`` turns the counts into votes, and expectation
maximisation runs on the table of vote patterns: a row per pattern seen, at most
``3 ** len(RULES)`` whatever the size of the corpus, which is why it may come to
the driver. The learnt log odds go back into the plan as constants.

Null texts count as empty. Repeated rows and ids are judged row by row. An empty
table gives an empty result. Columns but doc_id and text are not read, whatever
their names. Repeated three-word windows are found by sorting 64-bit hashes and
comparing the words of neighbours, at any length of the text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.permute import let
from lodeweave.llm.storage import BLANKS, materialize

SYMBOLS = "#*$%&|<>"
#: Common function words of the languages served.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not his but at are this have from or which one you were "
    "der die und den von zu das mit sich des auf für ist im dem ein eine als auch "
    "le la les de du et un une en que qui dans pour pas sur au avec est par "
    "el los las del y por con para se su al lo como"
).split()
#: Where a word of plain prose ends: a lower-case letter, one mark at most, then a blank or the end.
PLAIN_END = r"\p{Ll}[.,;:?]?(?=[\x20\x09-\x0D]|\z)"


def words_of(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words found at least twice in the text.

    Windows are sorted by a 64-bit hash with their places. Windows of one hash are compared word by word with the
    first of them, so that a hash shared by chance counts as a repeat only if the words are the same.
    """

    def windows(w: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))

    def covered(w: Column, sorted_: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            alike = (other["h"] == x["h"]) & (reduce(lambda a, b: a & b, [F.get(w, other["i"] + k) == F.get(w, x["i"] + k) for k in range(window)]))
            return F.coalesce(alike, F.lit(False))

        again = F.filter(sorted_, lambda x, i: same(x, F.get(sorted_, i - 1)) | same(x, F.get(sorted_, i + 1)))
        places = F.transform(again, lambda x: x["i"])
        moved = lambda p, k: F.transform(p, lambda x: x + F.lit(k))
        spread = lambda p: F.concat(*[moved(p, k) for k in range(window)])
        return let(places, lambda p: F.size(F.array_distinct(spread(p))))

    whole = lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(let(windows(w), lambda s: covered(w, s)))
    return let(words, whole)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts over each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stops"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    size = F.length(text)
    counted = docs.select(
        "doc_id",
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        _without(text, BLANKS).cast("long").alias("word_chars"),
        (size - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (size - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (size - _without(text, "!")).cast("long").alias("n_shouts"),
        F.regexp_count(text, F.lit(PLAIN_END)).cast("long").alias("n_plain"),
        (size - _without(text, "0123456789")).cast("long").alias("n_digits"),
    )
    return counted.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_shouts", "n_digits", "n_plain")


def _band(value: Column, good: Column, bad: Column) -> Column:
    """1 where ``good`` holds, -1 where ``bad`` holds, 0 (abstain) between and where there is no value."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The voters: name -> vote on a row of ``text_statistics``. A rule that sees nothing amiss may still abstain."""
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    chars = F.nullif(F.col("word_chars"), F.lit(0)).cast("double")
    lines = F.nullif(F.col("n_lines"), F.lit(0)).cast("double")
    mean, symbols, shouts = chars / n, F.col("n_symbols") / n, F.col("n_shouts") / n
    again, dup = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines
    upper, digits, plain, stops = F.col("n_upper") / chars, F.col("n_digits") / chars, F.col("n_plain") / n, F.col("n_stops") / n
    variety = F.col("n_distinct") / F.sqrt(n)
    return {
        "word_length": _band(mean, (mean >= 3) & (mean <= 10), (mean < 2) | (mean > 16)),
        "symbols": _band(symbols, symbols <= 0.03, symbols > 0.15),
        "shouting": _band(shouts, shouts <= 0.03, shouts > 0.2),
        "capitals": _band(upper, upper <= 0.1, upper > 0.3),
        "repeats": _band(again, again <= 0.2, again > 0.4),
        "same_lines": _band(dup, dup <= 0.1, dup > 0.4),
        "plain_words": _band(plain, plain >= 0.85, plain < 0.65),
        "stop_words": _band(stops, stops >= 0.08, stops < 0.02),
        "digits": _band(digits, digits <= 0.05, digits > 0.25),
        "variety": _band(variety, variety >= 4, variety < 2.5),
    }


class LabelModel:
    """Two latent classes; each rule votes 1, 0 or -1 with its own chances in each class.

    ``belief`` is the weight of the prior, as a share of the rows: it says that
    rules vote against few good texts, and for many bad ones, which fail in one
    respect at a time. It also fixes which class is which.
    """

    def __init__(self, n_rules: int, prior: float = 0.85, belief: float = 0.02):
        self.prior, self.belief = prior, belief
        start = {True: {1: 0.78, 0: 0.215, -1: 0.005}, False: {1: 0.6, 0: 0.2, -1: 0.2}}
        self.chance = [{c: dict(v) for c, v in start.items()} for _ in range(n_rules)]
        self.start = start

    def log_odds(self, votes: Sequence[int]) -> float:
        known = math.log(self.prior / (1 - self.prior))
        return known + sum(math.log(ch[True][v] / ch[False][v]) for ch, v in zip(self.chance, votes))

    def posterior(self, votes: Sequence[int]) -> float:
        x = self.log_odds(votes)
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))

    def fit(self, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> LabelModel:
        total = sum(n for _, n in patterns)
        if not total:
            return self
        extra = self.belief * total + 1
        for _ in range(rounds):
            weight = [(votes, n, self.posterior(votes)) for votes, n in patterns]
            good = sum(n * p for _, n, p in weight)
            self.prior = min(max((good + 1) / (total + 2), 0.01), 0.99)
            for r, chance in enumerate(self.chance):
                for c in (True, False):
                    mass = {v: extra * self.start[c][v] for v in (1, 0, -1)}
                    for votes, n, p in weight:
                        mass[votes[r]] += n * (p if c else 1 - p)
                    all_ = sum(mass.values())
                    chance[c] = {v: m / all_ for v, m in mass.items()}
        return self

    def accuracy(self) -> list[float]:
        """Chance that a rule is right where it votes."""
        out = []
        for ch in self.chance:
            right = self.prior * ch[True][1] + (1 - self.prior) * ch[False][-1]
            wrong = self.prior * ch[True][-1] + (1 - self.prior) * ch[False][1]
            out.append(right / (right + wrong))
        return out


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, ``probability`` of good quality, ``base_failed`` and ``kept`` of every row of docs (doc_id, text)."""
    stats = materialize(text_statistics(docs), "quality-statistics")
    voters = rules()
    names = [f"vote_{r}" for r in voters]
    voted = stats.select("*", *[v.cast("int").alias(f"vote_{r}") for r, v in voters.items()])
    seen = voted.where("n_words > 0").groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    patterns = sorted((tuple(row[x] for x in names), row["count"]) for row in seen)
    model = LabelModel(len(names)).fit(patterns)
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, chance in zip(names, model.chance):
        weight = {v: math.log(chance[True][v] / chance[False][v]) for v in (1, 0, -1)}
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
