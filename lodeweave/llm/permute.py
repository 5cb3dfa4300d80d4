"""Keyed permutations of short strings, as native expressions.

A string is a list of symbols, each a value below its own radix. A Feistel
network over its two halves, keyed by SHA-512, is a permutation of all strings of
the same radices: distinct strings stay distinct without any look at the others.

Read as numbers, the permuted strings form a ring. A string's replacement is the
string whose permuted form stands one step further, so nothing replaces itself;
``advance`` finds it. ``step`` is keyed, and below the number of strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6  # even, so that both halves end where they began
_DIGITS = 5  # of the keystream's hexadecimal digits for each symbol
_WIDE = 1 << 20


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stream(key: str, domain: Column, half: Column, turn: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), domain, turn.cast("string"), F.concat_ws(",", half.cast("array<string>"))), 512)


def _moved(values: Column, radices: Column, stream: Column, sign: int) -> Column:
    """Each value moved by its part of the stream, within its radix."""

    def one(v: Column, i: Column) -> Column:
        at = F.pmod(i * _DIGITS, F.lit(125)) + 1
        by = F.conv(F.substr(stream, at, F.lit(_DIGITS)), 16, 10).cast("int")
        return F.pmod(v + F.lit(sign) * by, F.get(radices, i))

    return F.transform(values, one)


def permuted(key: str, domain: Column, values: Column, radices: Column, back: bool = False) -> Column:
    """The permutation of ``values`` (array<int>) under ``radices``; ``back`` undoes it."""
    half = F.floor(F.size(values) / 2).cast("int")
    left = lambda x: F.slice(x, F.lit(1), half)
    right = lambda x: F.slice(x, half + 1, F.size(x) - half)
    start = F.struct(left(values).alias("a"), left(radices).alias("ra"), right(values).alias("b"), right(radices).alias("rb"))

    def forth_(s: Column, turn: Column) -> Column:
        moved = let(_stream(key, domain, s["b"], turn), lambda k: _moved(s["a"], s["ra"], k, 1))
        return F.struct(s["b"].alias("a"), s["rb"].alias("ra"), moved.alias("b"), s["ra"].alias("rb"))

    def back_(s: Column, turn: Column) -> Column:
        moved = let(_stream(key, domain, s["a"], turn), lambda k: _moved(s["b"], s["rb"], k, -1))
        return F.struct(moved.alias("a"), s["rb"].alias("ra"), s["a"].alias("b"), s["ra"].alias("rb"))

    turns = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    return F.aggregate(turns, start, back_ if back else forth_, lambda s: F.concat(s["a"], s["b"]))


def advance(values: Column, radices: Column, by: Column) -> Column:
    """The string ``by`` places further (or back) on the ring of all strings of these radices."""

    def one(s: Column, x: Column) -> Column:
        total = x["v"] + s["carry"]
        digit = F.pmod(total, x["r"])
        carry = ((total - digit) / x["r"]).cast("long")
        return F.struct(carry.alias("carry"), F.concat(F.array(digit.cast("int")), s["out"]).alias("out"))

    pairs = F.reverse(F.zip_with(values, radices, lambda v, r: F.struct(v.cast("long").alias("v"), r.cast("long").alias("r"))))
    start = F.struct(by.cast("long").alias("carry"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pairs, start, one, lambda s: s["out"])


def step(key: str, domain: Column, radices: Column) -> Column:
    """A keyed step, above 0 and below the number of strings (0 if there is only one)."""
    count = F.aggregate(radices, F.lit(1).cast("long"), lambda n, r: F.least(n * r, F.lit(_WIDE).cast("long")))
    drawn = F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("step"), domain), 256), F.lit(1), F.lit(14)), 16, 10).cast("long")
    return let(count, lambda n: F.when(n > 1, F.pmod(drawn, n - 1) + 1).otherwise(0))


def spelled(values: Column) -> Column:
    return F.concat_ws(",", values.cast("array<string>"))
