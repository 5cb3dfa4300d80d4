"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources, in code point order with null last, get weights in turn and
share the budget by them; none gets more than ``most`` times its size, and what
is cut off is shared again by weight. A source's rows are dealt to blocks by a
hash of doc_id. A target is whole passes over the source's blocks, then blocks in
permuted order, then rows of one last block chosen to come near the target (if that
block holds a document long beside it, blocks without take its turn where they suffice): these
are the source's block quotas. A tree over the output shards splits the quotas
exactly: at each node the left half draws its share of every source from the
multivariate hypergeometric distribution, seeded by the node. A shard walks its
own path alone, so no task holds the tree. Sources' blocks, permuted anew for
each pass, go to the shards in runs, and each shard shuffles its rows.

One row per source comes to the driver, for ``max_sources`` sources at most; more
are an error. A source has at most ``max_blocks`` blocks, so ranking its blocks is a
bounded window however hot the source.

A null text has size 0. Null sources are one source. A row is told by its source,
doc_id, a hash of its text, and among rows alike in these by a number; so each
repeat is drawn on its own, and reruns agree on how often each is taken. Other columns
are not read, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.quality_rules import words_of
from lodeweave.llm.storage import materialize, partitions, ref

#: What tells a row of a source.
TOLD = ["doc_id", "mark", "twin"]
SOURCES = "source string, source_at int, source_size long, target double, passes int, rest double, n_blocks long"


def word_count(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """Whole rows of docs as ``row``, with what a mix tells them by: doc_id, source, size and mark, the hash of the text."""
    source = F.col("source").cast("string").alias("source")
    row = F.struct(*[F.col(ref(c)).alias(c) for c in docs.columns]).alias("row")
    return docs.select(row, "doc_id", source, word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))


def share_out(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Targets in proportion to weights, none above ``most`` times its size; the excess is shared again."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = most * float(sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def split_quotas(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of each source's blocks that go to a shard: its walk down the splitting tree."""
    first, have = np.zeros(len(quotas), np.int64), np.array(quotas, np.int64)
    total, low, high = int(have.sum()), 0, shards
    upto = lambda k: total * k // shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        room = upto(middle) - upto(low)
        left = rng.multivariate_hypergeometric(have, room, method="marginals") if have.sum() else have * 0
        if shard < middle:
            have, high = left, middle
        else:
            first, have, low = first + left, have - left, middle
    return first, have


def fill(sizes: np.ndarray, room: float, tail: int = 64) -> np.ndarray:
    """Mask of the items taken, which come near to the room: those that fit in turn, then the best subset of ``tail`` others.

    Where room stays, items too long for their turn are tried first in turn, and the fullest choice is returned.
    """
    sizes = np.asarray(sizes, np.int64)
    best = _fill(sizes, room, tail, None)
    for i in np.flatnonzero(~best & (sizes <= room))[:tail]:
        if sizes[best].sum() >= int(room):
            break
        other = _fill(sizes, room, tail, int(i))
        if sizes[other].sum() > sizes[best].sum():
            best = other
    return best


def _fill(sizes: np.ndarray, room: float, tail: int, first: int | None) -> np.ndarray:
    taken, left = np.zeros(len(sizes), bool), int(room)
    if first is not None:
        taken[first], left = True, left - int(sizes[first])
    fit = sizes[sizes <= left]
    slack = fit.mean() * tail / 4 if len(fit) else 0
    for i, size in enumerate(sizes.tolist()):
        if not taken[i] and size <= left - slack:
            taken[i], left = True, left - size
    open_ = np.flatnonzero(~taken & (sizes <= left))[:tail].tolist()
    sums, keep = [1], (1 << (left + 1)) - 1  # bit k of sums[i]: the first i open items can make k
    for i in open_:
        sums.append((sums[-1] | sums[-1] << int(sizes[i])) & keep)
    at = sums[-1].bit_length() - 1
    for k in range(len(open_) - 1, -1, -1):
        if not sums[k] >> at & 1:
            taken[open_[k]] = True
            at -= int(sizes[open_[k]])
    return taken


class Mix:
    """The plan of a mix of ``docs`` (doc_id, source, text and any other columns)."""

    def __init__(
        self, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        block_words: int = 65_536, block_rows: int = 256, max_blocks: int = 65_536, blocks_per_shard: int = 64, max_sources: int = 200_000, seed: int = 23,
    ):
        self.spark, self.seed, self.blocks_per_shard = docs.sparkSession, seed, blocks_per_shard
        id_type = docs.schema["doc_id"].dataType
        rows = materialize(keyed(docs).drop("row"), "mix-rows")
        twins = rows.groupBy("source", "doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        self.twins = None if twins.isEmpty() else materialize(twins, "mix-twins").withColumnsRenamed({k: f"{k}_" for k in twins.columns})
        self.rows = rows if self.twins is None else materialize(self._numbered(rows), "mix-rows")
        found = self.rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()  # a row per source
        if len(found) > max_sources:
            raise ValueError(f"more than max_sources={max_sources} sources")
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [r["n"] for r in found]
        weight = [float(weights[i % len(weights)]) for i in range(len(found))]
        targets = share_out(sizes, weight, share * sum(sizes), most)
        plan = []
        for i, (r, n, target) in enumerate(zip(found, sizes, targets)):
            passes = int(target // n) if n else 0
            plan.append((r["source"], i, n, target, passes, max(0.0, target - passes * n), max(1, min(max_blocks, -(-n // block_words), r["rows"] // block_rows))))
        self.sources = self.spark.createDataFrame(plan, SOURCES)
        self.n_sources = len(plan)
        self._plan_blocks(id_type.simpleString())

    def _order(self, *parts) -> Column:
        return F.xxhash64(F.lit(self.seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def _of_row(self, *parts) -> Column:
        """A hash of a row's doc_id; rows without one, and further ones of one doc_id and text, differ by mark and twin."""
        alone = F.col("doc_id").isNotNull() & (F.col("twin") == 0)
        return F.when(alone, self._order(parts[0], F.col("doc_id"), *parts[1:])).otherwise(self._order(*parts, *map(F.col, TOLD)))

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """Add ``twin``, a number that tells rows alike in source, doc_id and text apart, unless it is there."""
        if "twin" in rows.columns:
            return rows
        if self.twins is None:
            return rows.withColumn("twin", F.lit(0))
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in ("source", "doc_id", "mark")]
        own = Window.partitionBy("source", "doc_id", "mark").orderBy("size")
        several = rows.join(self.twins, same, "left_semi").withColumn("twin", F.row_number().over(own) - 1)
        return rows.join(self.twins, same, "left_anti").withColumn("twin", F.lit(0)).unionByName(several)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Add the source's plan and the block to rows with doc_id, source, size and mark."""
        plan = self.sources.withColumnRenamed("source", "source_")
        joined = self._numbered(rows).join(plan, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        return joined.withColumn("block", F.pmod(self._of_row("block"), F.col("n_blocks")))

    def _plan_blocks(self, id_type: str) -> None:
        rows = self.placed(self.rows)
        blocks = rows.groupBy("source_at", "block").agg(F.sum("size").alias("words"), F.max("size").alias("longest"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        upto = Window.partitionBy("source_at").orderBy(self._order("last", F.col("source_at"), F.col("block")), "block")
        blocks = blocks.withColumn("rank", F.row_number().over(upto)).withColumn("end", F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        begin = F.col("end") - F.col("words")
        blocks = blocks.withColumn("whole", (F.col("rest") > 0) & (F.col("end") <= F.col("rest")))
        blocks = blocks.withColumn("part", (F.col("rest") > begin) & (F.col("end") > F.col("rest"))).withColumn("room", F.col("rest") - begin)
        self.blocks = materialize(self._edge_moved(blocks), "mix-blocks")

        edge = rows.join(self.blocks.where("part").select("source_at", "block", "room"), ["source_at", "block"])
        edge = edge.select("source_at", "room", *TOLD, "size", self._of_row("edge", F.col("size")).alias("turn"))

        def choose(pdf):  # a block's rows at most
            pdf = pdf.sort_values(["turn", "size", "twin"], kind="stable").reset_index(drop=True)
            return pdf[fill(pdf["size"].to_numpy(np.float64), float(pdf["room"].iloc[0]))][["source_at", *TOLD]]

        chosen = edge.groupBy("source_at").applyInPandas(choose, f"source_at int, doc_id {id_type}, mark long, twin int")
        self.chosen = materialize(chosen, "mix-chosen")

    def _edge_moved(self, blocks: DataFrame, times: int = 16) -> DataFrame:
        """A last block with a document longer than one ``times``-th of it leaves its turn to blocks without.

        It is taken whole, as often as its share of the room, and blocks before it give up as much; or it is left out, and
        blocks after it fill the room. The last of these is chosen row by row. Where neither is enough, it stays.
        """
        of_source = Window.partitionBy("source_at")
        blocks = blocks.withColumn("even", F.col("longest") * times <= F.col("words"))
        blocks = blocks.withColumn("edge", F.max(F.when(F.col("part"), F.struct("rank", "words", "room", "even"))).over(of_source))
        rank, words, room = (F.col(f"edge.{k}") for k in ("rank", "words", "room"))
        before, after = F.col("even") & (F.col("rank") < rank), F.col("even") & (F.col("rank") > rank)
        upto = of_source.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        summed = lambda which, over: F.coalesce(F.sum(F.when(which, F.col("words"))).over(over), F.lit(0))
        blocks = blocks.withColumns({"given": summed(before, upto), "filled": summed(after, upto)})
        gives, fills = summed(before, of_source) >= words - room, summed(after, of_source) >= room
        drawn = F.pmod(self._order("edge whole", F.col("source_at")), F.lit(1 << 20)) < room / words * (1 << 20)
        keep = F.when(F.col("edge.even"), None).when(gives & fills, drawn).when(gives, True).when(fills, False)
        blocks = blocks.withColumn("keep", keep)
        changes = F.coalesce(F.when(F.col("keep"), before).otherwise(after), F.lit(False)) & F.col("keep").isNotNull()
        need, sum_ = F.when(F.col("keep"), words - room).otherwise(room), F.when(F.col("keep"), F.col("given")).otherwise(F.col("filled"))
        last = changes & (sum_ - F.col("words") < need) & (sum_ > need)
        old = F.col("keep").isNotNull() & (F.col("rank") == rank)
        return blocks.withColumns({
            "part": F.when(old, False).when(last, True).otherwise(F.col("part")),
            "whole": F.when(old, F.col("keep")).when(last, False).when(changes & (sum_ <= need), ~F.col("keep")).otherwise(F.col("whole")),
            "room": F.when(last, F.when(F.col("keep"), sum_ - need).otherwise(need - sum_ + F.col("words"))).otherwise(F.col("room")),
        }).drop("edge", "longest", "even", "given", "filled", "keep")

    def instances(self) -> DataFrame:
        """source_at, block, copy, partial, shard: every drawing of a block, with the shard that gets it."""
        copies = self.blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        copies = copies.where((F.col("copy") < F.col("passes")) | F.col("whole") | F.col("part"))
        anew = Window.partitionBy("source_at").orderBy("copy", self._order("pass", F.col("copy"), F.col("source_at"), F.col("block")), "block")
        numbered = materialize(copies.select("source_at", "block", "copy", (F.col("part") & (F.col("copy") == F.col("passes"))).alias("partial"), (F.row_number().over(anew).cast("long") - 1).alias("at")), "mix-drawings")
        counts = dict(numbered.groupBy("source_at").count().collect())  # a row per source
        quotas = np.array([counts.get(i, 0) for i in range(self.n_sources)], np.int64)
        shards = max(1, int(-(-quotas.sum() // self.blocks_per_shard))) if len(quotas) else 1
        seed, self.shards = self.seed, shards

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    first, count = split_quotas(quotas, shard, shards, seed)
                    at = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)]) if len(quotas) else np.empty(0, np.int64)
                    yield pa.record_batch(
                        [pa.array(np.repeat(np.arange(len(quotas), dtype=np.int32), count)), pa.array(at, pa.int64()), pa.array(np.full(len(at), shard), pa.int64())],
                        ["source_at", "at", "shard"],
                    )

        walked = self.spark.range(shards).mapInArrow(walk, "source_at int, at long, shard long")
        return numbered.join(walked, ["source_at", "at"]).drop("at")

    def draw(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with doc_id, source, size and mark) once for each time that the mix takes them, with twin, copy and shard."""
        columns = [c for c in rows.columns if c != "twin"]
        # stored, its size is known before rows move: where it is small they stay in place
        instances = materialize(self.instances(), "mix-instances")
        drawn = self.placed(rows).select(*columns, "twin", "source_at", "block").join(instances, ["source_at", "block"])
        picked = self.chosen.withColumnsRenamed({k: f"{k}_" for k in self.chosen.columns})
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in self.chosen.columns]
        whole = drawn.where(~F.col("partial"))
        part = drawn.where("partial").join(picked, same, "left_semi")
        return whole.unionByName(part).select(*columns, "twin", "copy", "shard")

    def shuffled(self, rows: DataFrame) -> DataFrame:
        """The drawn rows with their place in the shard's own permutation; tasks are as many as shards, whatever the session says."""
        place = Window.partitionBy("shard").orderBy(self._order("place", F.col("shard"), self._of_row("row"), F.col("copy")), "doc_id", "mark", "twin", "copy")
        drawn = self.draw(rows)
        return drawn.repartition(max(partitions(self.spark), self.shards), "shard").withColumn("place", F.row_number().over(place))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken words, and shard and place of the first copy, of every row of ``docs``.

    Shard and place are null where none is taken.
    """
    mix = Mix(docs, **options)
    keys = ["source", *TOLD]
    rows = mix._numbered(mix.rows)
    drawn = mix.shuffled(rows).groupBy(*keys).agg(F.sum("size").alias("taken"), F.min(F.struct("copy", "shard", "place")).alias("first"))
    drawn = drawn.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    joined = mix.placed(rows).select(*keys, "size", "source_size", "target").join(drawn, same, "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first.shard", "first.place")
