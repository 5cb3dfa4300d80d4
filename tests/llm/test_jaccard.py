import random
import re

import numpy as np
import pytest

from lodeweave.llm import jaccard
from lodeweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(rows, threshold=75):
    """(doc_id, size, component) of every row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if met and 100 * met >= threshold * (len(sets[i]) + len(sets[j]) - met):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out.append((rows[i][0], len(sets[i]), (min(ids) if ids else None) if sets[i] else rows[i][0]))
    return sorted(out, key=str)


def joined(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, **options).collect()), key=str)


def test_hard_rows(hard, clashing):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert joined(clashing, chunk=4, many=2) == brute(rows)


def test_families_and_shared_passages(spark):
    """Chains at the edge of the threshold, a family of near copies, and a passage that all documents share."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    base = text(80)
    for i in range(60):  # members of one family differ in a word or three
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"own{rng.random()}"
        rows.append(t)
    chain = text(100)
    for i in range(12):  # each is near its neighbours alone
        rows.append(chain[i * 5 :] + text(i * 5))
    for i in range(60):
        rows.append(text(rng.randint(5, 60)) + passage + text(rng.randint(5, 60)))
    for i in range(25):  # passage and little else: near or not by a hair
        rows.append(passage + text(rng.randint(0, 16)))
    rows = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({"chunk": 16, "many": 2}, {"hashes": 1}):
        assert joined(df, **options) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_small_vocabulary(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, chunk=20, many=3) == brute(rows)


def test_grouping_never_decides(spark, monkeypatch):
    """Without any leader, the matrix alone finds every link."""
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(60)]
    rows = [(i, " ".join(base[:50] + [str(rng.random())] * (i % 4))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_leaders", lambda sets: sets.selectExpr("class as a", "class as b").limit(0))
    assert joined(df) == brute(rows)


def test_empty(empty):
    assert joined(empty) == []


def test_components(spark):
    rng = random.Random(3)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], [(0, i) for i in range(1, 50)]):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        want = {x: find(x) for x in list(root) if find(x) != x}
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_shingles_match_the_plain_definition():
    import pyarrow as pa

    texts = ["A b C d e f", "a B c d E f", "a b c d", "a\tb\nc  d", "", None, "x " * 50]
    sets, sequence = jaccard.shingles(pa.array(texts), 5)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert np.array_equal(sets[0], sets[1]) and np.array_equal(sets[2], sets[3])
    assert sequence[4] == sequence[5] == 0 and sequence[0] == sequence[1] != 0
