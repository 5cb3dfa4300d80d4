"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are encoded and cut; pieces of full length fill a sequence each. The
others are dealt to blocks of a bounded number of pieces. A block is a multiset
of lengths, solved by several islands: each keeps a population of packings,
crosses two by injecting whole well-filled bins of one into the other, drops the
bins that repeat pieces already placed, and best-fits what that displaced. After
each epoch an island's elite migrates to the next island of its block. Islands
are rows of their own, so they run wherever there is a core.

Nulls: a null text is an empty document, which still has its end token. Repeated
rows are packed one by one. A text of any length is cut; texts are encoded in batches
of bounded bytes. Columns but doc_id and text are not read, whatever their names. An
empty table gives no pieces.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.bpe import encoder, regrouped
from lodeweave.llm.storage import materialize, partitions, release

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and cut them: PIECES, and ``ids`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, True)
        end = np.array([end_id], "<u4")
        for batch in regrouped(batches):
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                ids, offsets = coder.encode(rows.column(1))
                out: list[tuple] = []
                for k, doc_id in enumerate(rows.column(0).to_pylist()):
                    own = np.concatenate((ids[offsets[k] : offsets[k + 1]].astype("<u4", copy=False), end))
                    for i, (start, length) in enumerate(cut(len(own), capacity)):
                        part = own[start : start + length]
                        out.append((doc_id, i, start, length, zlib.crc32(part), part.astype(np.int32) if with_ids else None))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class BestFit:
    """Open bins by free space. A bit per free space says which are held, so the best fit is one shift."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.at, self.mask = capacity, [], [[] for _ in range(capacity + 1)], 0

    def add(self, bin_: list[int]) -> None:
        self.bins.append(bin_)
        self._hold(self.capacity - sum(bin_), len(self.bins) - 1)

    def _hold(self, free: int, i: int) -> None:
        self.at[free].append(i)
        self.mask |= 1 << free

    def place(self, size: int) -> None:
        room = self.mask >> size
        if not room:
            self.bins.append([size])
            self._hold(self.capacity - size, len(self.bins) - 1)
            return
        free = size + (room & -room).bit_length() - 1
        i = self.at[free].pop()
        if not self.at[free]:
            self.mask ^= 1 << free
        self.bins[i].append(size)
        self._hold(free - size, i)


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones beside emptier ones."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(one: list[list[int]], other: list[list[int]], items: Counter, capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``one`` into ``other``, drop repeats, best-fit what is displaced."""
    ranked = sorted(one, key=sum, reverse=True)
    take = rng.uniform(0.3, 0.8) * len(ranked)
    left, child = [0] * (capacity + 1), BestFit(capacity)
    for size, n in items.items():
        left[size] = n

    def fits(bin_: list[int]) -> bool:
        for i, size in enumerate(bin_):
            if not left[size]:  # a repeat: put back what the bin has taken
                for other_ in bin_[:i]:
                    left[other_] += 1
                return False
            left[size] -= 1
        child.add(list(bin_))
        return True

    for bin_ in ranked[: int(take)]:
        if rng.random() < 0.9:
            fits(bin_)
    for bin_ in sorted(other, key=sum, reverse=True):
        if sum(bin_) >= 0.98 * capacity or rng.random() < 0.5:
            fits(bin_)
    for size in range(capacity, 0, -1):
        for _ in range(left[size]):
            child.place(size)
    return child.bins


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    packed = BestFit(capacity)
    for size in sizes:
        packed.place(size)
    return packed.bins


def evolve(sizes: list[int], capacity: int, seeds: list[list[list[int]]], population: int, generations: int, rng: random.Random) -> list[list[int]]:
    """The best packing that one island finds in an epoch. Stops early at the lower bound."""
    bound = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    items = Counter(sizes)
    group = [*seeds, best_fit(sorted(sizes, reverse=True), capacity)]
    while len(group) < population:  # decreasing order, disturbed
        group.append(best_fit(sorted(sizes, key=lambda s: s * rng.uniform(0.9, 1.0), reverse=True), capacity))
    scored = sorted(((fitness(g, capacity), g) for g in group), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -scored[0][0][0] <= bound:
            break
        a, b = rng.sample(range(len(scored)), 2)
        child = crossover(scored[min(a, b)][1], scored[max(a, b)][1], items, capacity, rng)
        score = fitness(child, capacity)
        if score > scored[-1][0]:
            scored[-1] = (score, child)
            scored.sort(key=lambda x: x[0], reverse=True)
    return scored[0][1]


def _to_array(bins: list[list[int]]) -> list[int]:
    return [x for b in bins for x in (*b, 0)]


def _to_bins(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for x in flat:
        if x:
            out[-1].append(x)
        else:
            out.append([])
    return out[:-1]


def _epoch(blocks: DataFrame, number: int, capacity: int, population: int, generations: int, seed: int) -> DataFrame:
    """blocks: block, island, sizes, seeds (array of packings). Returns block, island, elite, n_bins, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = random.Random(f"{seed}/{number}/{row['block']}/{row['island']}")
                best = evolve(row["sizes"], capacity, [_to_bins(s) for s in row["seeds"] or []], population, generations, rng)
                count, score = fitness(best, capacity)
                yield pa.record_batch(
                    [pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([_to_array(best)], pa.list_(pa.int32())), pa.array([-count], pa.int64()), pa.array([score])],
                    ["block", "island", "elite", "n_bins", "score"],
                )

    return blocks.select("block", "island", "sizes", "seeds").mapInArrow(run, "block long, island int, elite array<int>, n_bins long, score double")


def pack(items: DataFrame, capacity: int, block_items: int = 8192, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 16, seed: int = 7) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``block_items`` bounds how many pieces one island holds; a larger block packs tighter and runs longer.
    """
    columns, spark = items.columns, items.sparkSession
    stored = materialize(items.withColumn("uid_", F.monotonically_increasing_id()), "pieces")
    full = stored.where(F.col("length") == capacity).select(
        *columns, (-F.col("uid_") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = stored.where(F.col("length") < capacity)
    n_blocks = max(1, -(-rest.count() // block_items))
    rest = rest.withColumn("block_", F.pmod(F.xxhash64("uid_"), F.lit(n_blocks)))
    n = partitions(spark)
    sizes = rest.groupBy(F.col("block_").alias("block")).agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("sizes"))
    sizes = materialize(sizes, "pack-blocks")
    homes = sizes.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = homes.withColumn("seeds", F.lit(None).cast("array<array<int>>"))
    for number in range(epochs):
        elites = materialize(_epoch(state.repartition(n, "block", "island"), number, capacity, population, generations, seed), "pack-elites")
        came = elites.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant"))
        state = homes.join(elites.select("block", "island", "elite").hint("merge"), ["block", "island"]).join(came.hint("merge"), ["block", "island"])
        state = state.withColumn("seeds", F.array("elite", "migrant"))
    best = elites.groupBy("block").agg(F.max_by("elite", F.struct(-F.col("n_bins"), "score", -F.col("island"))).alias("elite"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen: Counter = Counter()
                out = []
                for i, bin_ in enumerate(_to_bins(row["elite"])):
                    at = 0
                    for size in bin_:
                        out.append((row["block"], size, seen[size], (row["block"] << 33) + i, at))
                        seen[size] += 1
                        at += size
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["block_", "length", "turn_", "sequence_id", "offset"])

    placed = best.mapInArrow(places, "block_ long, length long, turn_ long, sequence_id long, offset long")
    turn = F.row_number().over(Window.partitionBy("block_", "length").orderBy("uid_")).cast("long") - 1
    packed = rest.withColumn("turn_", turn).join(placed.hint("merge"), ["block_", "length", "turn_"]).select(*columns, "sequence_id", "offset")
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, **options) -> DataFrame:
    """Encode, cut and pack ``docs``: PIECES with sequence_id and offset."""
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity, **options)
