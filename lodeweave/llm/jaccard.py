"""Exact Jaccard join of documents on word shingles by a token-group matrix.

Documents of one word sequence are a class. The matrix holds, for each token (a
64-bit shingle hash), which groups have it; a query's overlap with a group's token
union bounds its overlap with every member, so a group is opened only where the
bound reaches the threshold.

1. Screening takes the rest of the corpus as one group. Tokens are dealt by hash
   to buckets, in packed arrays; a bucket finds which of its tokens two classes
   have. A class with too few such tokens links with nothing and is done, which
   is most of them. A token that many classes of one task have is sent once.
2. The classes left form groups: members with a common min-hash are compared with
   one leader each, and connected components of the links are the groups.
3. Each group's token union is one set of matrix rows. Groups whose unions have too
   little in common with other groups are done whole. For a query of the others,
   candidate groups come from its rarest tokens (enough of them that a partner of
   its size must show one too), the overlap with the candidate's token union
   bounds it, and members of the qualifying groups are compared exactly.

Token ids keep 40 bits of the hash beside the bucket, so two shingles of a pair
are confused with a chance of about one in 2 ** (40 + log2 buckets) per pair of
shingles; class ids have 64 bits.

Parts are as many as the texts' bytes need. Null, empty and wordless texts link with nothing and are their own components.
Repeated rows and ids are kept row by row; copies are linked as one class. An
empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.components import components
from lodeweave.llm.skew import spread_join
from lodeweave.llm.storage import materialize, partitions, partitions_for, release
from lodeweave.llm.words import words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_LOW = np.uint64(0xFFFFFF)  # bits of a token id that hold the bucket
MANY = np.uint64(0)  # owner of a token that several classes of a task have
TOKENS, SHARED, DOCS, CLASSES = range(4)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and a hash of its word sequence (0: no words)."""
    import xxhash

    found = words(texts, lower=True)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.distinct), np.uint64, len(found.distinct))[found.index]
    ends = np.concatenate(([0], np.cumsum(found.counts())))
    rolled = np.zeros(max(len(hashed) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += hashed[k : k + len(rolled)] * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    rolled = mix(rolled)
    sets, sequence = [], np.zeros(found.n_rows, np.uint64)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if a == b:
            sets.append(rolled[:0])
            continue
        whole = np.uint64(xxhash.xxh3_64_intdigest(hashed[a:b].tobytes()))
        sequence[i] = whole or np.uint64(1)
        sets.append(np.unique(rolled[a : b - size + 1]) if b - a >= size else mix(sequence[i : i + 1]))
    return sets, sequence


def _pack(classes: np.ndarray, counts: np.ndarray, *arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(classes)], "<u4").tobytes(), classes.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(blob: memoryview) -> tuple[np.ndarray, np.ndarray, memoryview]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    return np.frombuffer(blob, "<u8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n), blob[4 + 12 * n :]


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs."""
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
    return owner[at], np.diff(at, append=len(owner))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"])


def _dealt(part: np.ndarray, owner: np.ndarray, parts: int, kind: int, token: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of (owner, token) pairs by part; the pairs of a part keep their owners together."""
    order = np.argsort(part, kind="stable")
    part, owner, token = part[order], owner[order], token[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if a < b:
            classes, counts = _runs(owner[a:b])
            t = token[a:b]
            if kind == TOKENS:
                out.append((p, kind, _pack(classes, counts, (t >> np.uint64(32)).astype("<u4"), ((t >> np.uint64(24)) & np.uint64(255)).astype("<u1"))))
            else:
                out.append((p, kind, _pack(classes, counts, t.astype("<u8"))))
    return out


def _deal(size: int, parts: int, many: int, chunk: int):
    """Task function of the first step: doc_id, text -> part, kind, blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                rows = batch.slice(at, chunk)
                sets, sequence = shingles(rows.column(1), size)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                ids = rows.column(0)
                known = np.asarray(pc.is_valid(ids)).astype("<u1")
                doc = np.asarray(pc.fill_null(ids, 0)).astype("<i8")
                out = [(int(doc[0] % parts), DOCS, _pack(sequence, sizes, doc, known))]
                classes, first = np.unique(sequence, return_index=True)
                first = first[classes != 0]
                owner, own_size = sequence[first], sizes[first]
                home = (owner % np.uint64(parts)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                cuts = np.searchsorted(home[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    pick = order[cuts[p] : cuts[p + 1]]
                    out.append((int(p), CLASSES, _pack(owner[pick], own_size[pick])))
                if len(first):
                    token = np.concatenate([sets[i] for i in first])
                    who = np.repeat(owner, own_size)
                    bucket = token % np.uint64(parts)
                    token = (token & ~_LOW) | bucket
                    ranked = np.sort(token)
                    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                    often = ranked[starts[np.diff(starts, append=len(ranked)) >= many]]
                    here = np.zeros(len(token), bool)
                    if len(often):
                        near = np.minimum(np.searchsorted(often, token), len(often) - 1)
                        here = often[near] == token
                        spread = (mix(who[here] ^ token[here]) % np.uint64(parts)).astype(np.int64)
                        out += _dealt(spread, who[here], parts, SHARED, token[here])
                        out += _dealt((often & _LOW).astype(np.int64), np.full(len(often), MANY), parts, TOKENS, often)
                    out += _dealt(bucket[~here].astype(np.int64), who[~here], parts, TOKENS, token[~here])
                yield _batch(out)
        release()

    return run


def _meet(parts: int):
    """Task function of the second step: a part's rows -> the (class, token) pairs that another class shares, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, paired = [], [], []
        for batch in batches:
            through = []
            for part, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = memoryview(blob.as_buffer())
                if kind in (DOCS, CLASSES):
                    through.append((part, kind, bytes(data)))
                    continue
                classes, counts, rest = _unpack(data)
                owners.append(np.repeat(classes, counts))
                paired.append(np.full(len(owners[-1]), kind == SHARED))
                n = len(owners[-1])
                if kind == SHARED:
                    tokens.append(np.frombuffer(rest, "<u8", n))
                else:
                    high, mid = np.frombuffer(rest, "<u4", n), np.frombuffer(rest, "<u1", n, 4 * n)
                    tokens.append((high.astype(np.uint64) << np.uint64(32)) | (mid.astype(np.uint64) << np.uint64(24)) | np.uint64(part))
            if through:
                yield _batch(through)
        if not tokens:
            return
        batch = data = rest = None
        token, owner, pair = np.concatenate(tokens), np.concatenate(owners), np.concatenate(paired)
        tokens.clear()
        owners.clear()
        order = np.argsort(token, kind="stable")
        ranked = token[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        run_ = np.cumsum(new) - 1
        length = np.bincount(run_)
        held = pair[order] | (length[run_] > 1)
        token, owner, pair, run_ = ranked[held], owner[order][held], pair[order][held], run_[held]
        # within a token, is there a second class or the mark of several?
        low, high = np.full(len(length), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(length), np.uint64)
        counted = ~pair
        np.minimum.at(low, run_[counted], owner[counted])
        np.maximum.at(high, run_[counted], owner[counted])
        good = (pair | (low[run_] != high[run_])) & (owner != MANY)
        token, owner = token[good], owner[good]
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))) if len(token) else np.empty(0, bool)
        token, owner = token[fresh], owner[fresh]
        yield _batch(_dealt((owner % np.uint64(parts)).astype(np.int64), owner, parts, SHARED, token))
        del token, owner, pair, order, ranked, new, run_, held
        release()

    return run


def _gather(threshold: int, hashes: int):
    """Task function of the third step: a part's classes -> documents, and the token sets that pass the bound."""
    salts = mix(np.arange(1, hashes + 1, dtype=np.uint64) * _ODD[0])

    def rows(kind: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        types = {"doc_id": pa.int64(), "class": pa.int64(), "n": pa.int64(), "tokens": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}
        arrays = [pa.array(np.full(n, kind, np.int32))] + [columns.get(c) if c in columns else pa.nulls(n, t) for c, t in types.items()]
        return pa.record_batch(arrays, ["kind", *types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, seen, sizes = [], [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                classes, counts, rest = _unpack(memoryview(blob.as_buffer()))
                if kind == DOCS:
                    n = len(classes)
                    ids = pa.array(np.frombuffer(rest, "<i8", n), mask=np.frombuffer(rest, "<u1", n, 8 * n) == 0)
                    yield rows(DOCS, doc_id=ids, **{"class": pa.array(classes.view(np.int64)), "n": pa.array(counts.astype(np.int64))})
                elif kind == CLASSES:
                    seen.append(classes)
                    sizes.append(counts.astype(np.int64))
                else:
                    owners.append(np.repeat(classes, counts))
                    tokens.append(np.frombuffer(rest, "<u8", len(owners[-1])))
        if not tokens:
            return
        known, at = np.unique(np.concatenate(seen), return_index=True)
        size = np.concatenate(sizes)[at]
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
        token, owner = token[fresh], owner[fresh]
        classes, counts = _runs(owner)
        n = size[np.searchsorted(known, classes)]
        keep = 100 * counts >= threshold * n
        token = token[np.repeat(keep, counts)]
        classes, counts, n = classes[keep], counts[keep], n[keep]
        if not len(classes):
            return
        starts = np.concatenate(([0], np.cumsum(counts)))
        for a in range(0, len(classes), 2000):
            b = min(a + 2000, len(classes))
            part = token[starts[a] : starts[b]]
            offsets = (starts[a : b + 1] - starts[a]).astype(np.int32)
            least = np.stack([np.minimum.reduceat(mix(part ^ s), offsets[:-1]) for s in salts], axis=1)
            yield rows(
                SHARED,
                **{"class": pa.array(classes[a:b].view(np.int64)), "n": pa.array(n[a:b])},
                tokens=pa.ListArray.from_arrays(offsets, part.view(np.int64)),
                keys=pa.ListArray.from_arrays(np.arange(0, least.size + 1, hashes, dtype=np.int32), least.ravel().view(np.int64)),
            )

    return run


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets reach the threshold."""
    one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    met = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * met >= threshold * (F.col("na") + F.col("nb") - met)).select("a", "b")


def _least(n: Column, threshold: int) -> Column:
    """Smallest overlap that a set of n can have with a partner at the threshold."""
    return F.ceil(n * F.lit(threshold) / 100)


def _leaders(sets: DataFrame) -> DataFrame:
    """Pairs (a, b): a class and the leader of each min-hash it has. The leader has most of its tokens shared."""
    keyed = sets.select("class", (F.size("tokens") / F.col("n")).alias("share"), F.posexplode("keys").alias("slot", "key"))
    best = keyed.groupBy("slot", "key").agg(F.max(F.struct("share", "class"))["class"].alias("b"), F.count("*").alias("count")).where("count > 1")
    return keyed.join(best, ["slot", "key"]).where(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct()


def _across(sets: DataFrame, threshold: int, step: float = 1.04, members: int = 512, queries: int = 8192) -> DataFrame:
    """Links (a, b) between classes of different groups. sets: class, n, tokens, grp.

    Of a pair, the smaller set asks and the larger one's group offers. Sizes are cut
    into bands by ``step``; for two bands the least overlap of a link is known, so
    each side shows as many of its rarest tokens as a link can't avoid, and a pair
    of classes that shows no common token for its bands is no link. A group's rows
    of a band show the union of what its classes show.
    """
    spark, ratio = sets.sparkSession, threshold / (100 + threshold)
    none = sets.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    union = materialize(sets.select("grp", F.explode("tokens").alias("token")).distinct(), "matrix")
    common = union.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    smallest = sets.groupBy("grp").agg(F.min("n").alias("smallest"))
    met = union.join(common.hint("merge"), "token").groupBy("grp").agg(F.count("*").alias("met"))
    able = materialize(met.join(smallest, "grp").where(F.col("met") >= _least(F.col("smallest"), threshold)).select("grp"), "able-groups")
    if able.isEmpty():
        return none
    rarity = union.join(able, "grp", "left_semi").groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    band = F.floor(F.log(F.col("n")) / math.log(step) + 1e-9).cast("int")
    open_ = sets.join(able, "grp", "left_semi").withColumn("band", band)
    rows = open_.select("class", "grp", "n", "band", F.explode("tokens").alias("token")).join(rarity.hint("merge"), "token")
    own = Window.partitionBy("class")
    rows = rows.withColumn("met", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("groups", "token")))
    least = _least(F.col("n"), threshold)
    shown = rows.where((F.col("met") >= least) & (F.col("rank") <= F.col("met") - least + 1)).drop("groups")
    shown = materialize(shown, "shown")

    low = lambda b: F.ceil(F.pow(F.lit(step), b) - 1e-6)  # noqa: E731  smallest size of a band
    need = lambda m: F.ceil((F.col("n") + m) * ratio - 1e-6)  # noqa: E731  least overlap with a set of m
    apart = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(math.log(100 / threshold) / math.log(step)) + 1))).alias("apart")
    asks = shown.select("*", apart).withColumn("larger", F.col("band") + F.col("apart"))
    asks = asks.where(F.col("rank") <= F.col("met") - need(F.greatest(low(F.col("larger")), F.col("n"))) + 1)
    asks = asks.select("class", F.col("grp").alias("asker"), "token", F.col("band").alias("smaller"), "larger")
    offers = shown.select("*", apart).withColumn("smaller", F.col("band") - F.col("apart"))
    offers = offers.where(F.col("rank") <= F.col("met") - need(low(F.col("smaller"))) + 1)
    offers = offers.select("token", "smaller", F.col("band").alias("larger"), "grp").distinct()
    asked = asks.join(offers.hint("merge"), ["token", "smaller", "larger"]).where("asker <> grp").select("class", "grp", "larger").distinct()
    asked = materialize(asked, "asked")

    held = open_.join(asked.select("grp", F.col("larger").alias("band")).distinct(), ["grp", "band"], "left_semi")
    sizes = held.groupBy("grp", "band").agg(F.ceil(F.count("*") / F.lit(members)).cast("int").alias("chunks"))
    held = held.join(sizes, ["grp", "band"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    # queries of a group that many ask are cut into slices too, each with a copy of the chunk
    asking = asked.withColumnRenamed("larger", "band").join(sizes, ["grp", "band"])
    slices = asking.groupBy("grp", "band").agg(F.ceil(F.count("*") / F.lit(queries)).cast("int").alias("slices"))
    asking = asking.join(slices, ["grp", "band"]).withColumn("slice", F.pmod(F.xxhash64("class", F.lit("slice")), F.col("slices")).cast("int"))
    asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asking = asking.select("grp", "band", "chunk", "slice", F.lit(1).alias("side"), "class").join(sets.select("class", "n", "tokens").hint("merge"), "class")
    held = held.join(slices, ["grp", "band"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    held = held.select("grp", "band", "chunk", "slice", F.lit(0).alias("side"), "class", "n", "tokens")
    both = held.unionByName(asking).repartition(partitions(spark), "grp", "band", "chunk", "slice").sortWithinPartitions("grp", "band", "chunk", "slice", "side")
    return both.mapInArrow(_open(threshold), "a long, b long")


class _Group:
    """One chunk of a group's members: its token union, and which members have each token."""

    def __init__(self, classes: list[int], sizes: list[int], sets: list[np.ndarray]):
        self.classes, self.sizes = classes, np.array(sizes, np.int64)
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.union, begin = np.unique(token[order], return_index=True)
        self.begin = np.append(begin, len(token))

    def link(self, n: int, tokens: np.ndarray, threshold: int) -> int | None:
        """A member that links with the query, if the bound lets the group be opened and one does."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if (100 + threshold) * len(at) < threshold * (n + int(self.sizes.min())):
            return None
        begin, count = self.begin[at], self.begin[at + 1] - self.begin[at]
        which = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        met = np.bincount(self.owner[which], minlength=len(self.sizes))
        found = np.flatnonzero(100 * met >= threshold * (n + self.sizes - met))
        return self.classes[found[0]] if len(found) else None


def _open(threshold: int):
    """Task function: rows by grp, band, chunk, slice, members before queries -> a link for each query that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        classes: list[int] = []
        sizes: list[int] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            column = batch.column(7)
            flat, ends = np.asarray(column.values), np.asarray(column.offsets)
            out: list[tuple[int, int]] = []
            meta = [batch.column(i).to_pylist() for i in range(7)]
            for i, (grp, band, chunk, slice_, side, class_, n) in enumerate(zip(*meta)):
                if (grp, band, chunk, slice_) != key:
                    key, group, classes, sizes, sets = (grp, band, chunk, slice_), None, [], [], []
                tokens = flat[ends[i] : ends[i + 1]]
                if side == 0:
                    classes.append(class_)
                    sizes.append(n)
                    sets.append(tokens.copy())
                    continue
                if group is None and classes:
                    group = _Group(classes, sizes, sets)
                other = group.link(n, tokens, threshold) if group else None
                if other is not None:
                    out.append((class_, other))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def join(docs: DataFrame, size: int = 5, threshold: int = 75, hashes: int = 8, many: int = 4, chunk: int = 2048) -> DataFrame:
    """Components of docs (doc_id, text) under links of Jaccard similarity ``threshold`` percent.

    One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reached).
    """
    parts = partitions_for(docs)  # a part is held in memory by its task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.mapInArrow(_deal(size, parts, many, chunk), "part int, kind int, blob binary")
    met = dealt.repartitionById(parts, F.col("part")).mapInArrow(_meet(parts), "part int, kind int, blob binary")
    screened = met.repartitionById(parts, F.col("part")).mapInArrow(_gather(threshold, hashes), "kind int, doc_id long, class long, n long, tokens array<long>, keys array<long>")
    screened = materialize(screened, "screened")
    listed = screened.where(F.col("kind") == DOCS).select("doc_id", "class", "n")
    sets = screened.where(F.col("kind") == SHARED).select("class", "n", "tokens", "keys")

    links = materialize(_linked(_leaders(sets), sets, threshold), "links")
    groups = components(links)
    grouped = sets.drop("keys").join(groups, F.col("class") == F.col("node"), "left").withColumn("grp", F.coalesce("root", "class")).drop("node", "root")
    grouped = materialize(grouped, "grouped")
    more = materialize(_across(grouped, threshold), "links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    # documents to classes to components, each summed first; a class of many copies, or a large component, meets in many tasks
    classes = listed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(groups, F.col("class") == F.col("node"), "left").select("class", "least", "copies", F.coalesce("root", "class").alias("component"))
    classes = materialize(classes, "classes")
    first = materialize(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "components")
    classes = materialize(spread_join(classes, first, ["component"], "members").select("class", "copies", "component_id"), "class-components")
    out = spread_join(listed.where("n > 0"), classes, ["class"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(listed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
