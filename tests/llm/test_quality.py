import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.llm import quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the plain definition."""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(hard, clashing):
    want = sorted(((r["doc_id"], *base(r["text"] or "")) for r in hard.collect()), key=str)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, quality_rules.text_statistics(clashing).select(*names).collect()), key=str) == want


def test_statistics_of_made_up_texts(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\t#x é") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.text_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: base(t) for i, t in enumerate(texts)}


def test_rules_separate_labels(small, small_labels):
    judged = quality_rules.judge(small).join(small_labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in judged)
    assert {r["kept"] for r in judged} == {True, False}


def test_judge_edges(hard, empty):
    rows = quality_rules.judge(hard).collect()
    assert len(rows) == hard.count()
    assert all(not r["kept"] for r in rows if r["n_words"] < 50)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert quality_rules.judge(empty).count() == 0


def test_label_model_recovers_accuracies():
    import random

    rng = random.Random(1)
    accuracy, seen, right = [0.95, 0.8, 0.7, 0.9], Counter(), Counter()
    for _ in range(8000):
        good = rng.random() < 0.8
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in accuracy)
        seen[votes] += 1
        right[votes, good] += 1
    model = quality_rules.LabelModel(4).fit(sorted(seen.items()), rounds=100)
    found = model.accuracy()
    assert sorted(range(4), key=lambda r: found[r]) == sorted(range(4), key=lambda r: accuracy[r])
    assert sum(n for (votes, good), n in right.items() if (model.posterior(votes) > 0.5) == good) >= 0.92 * 8000


def test_native_plan(small):
    plan = quality_rules.text_statistics(small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier_on_held_out_rows(small, small_labels):
    labels = small_labels.select("doc_id", F.col("quality").alias("label"))
    train = labels.where("doc_id % 3 != 0")
    got = quality_model.classify(small, train).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(got) > 15 and sum(r["predicted"] == r["label"] for r in got) >= 0.9 * len(got)


def test_classifier_edges(spark, hard, clashing, empty, small_labels):
    labels = small_labels.select("doc_id", F.col("quality").alias("label"))
    none = labels.limit(0)
    assert {r["score"] for r in quality_model.classify(hard, none).collect()} == {0.5}
    assert {r["score"] for r in quality_model.classify(hard, labels.where("label = 1")).collect()} == {1.0}
    odd = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None), (2, 0), (3, 1), (4, 1), (99, 1)], "doc_id long, label int")
    rows = quality_model.classify(clashing, odd).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.classify(empty, odd).count() == 0
    kept = quality_model.score(clashing, 0.25).select("row.*")
    assert kept.columns == clashing.columns and sorted(map(str, kept.collect())) == sorted(map(str, clashing.collect()))


@given(y=st.lists(st.floats(0, 1), min_size=1, max_size=30))
@settings(deadline=None)
def test_isotonic(y):
    x, v = quality_model.isotonic(np.arange(len(y), dtype=float), np.array(y), np.ones(len(y)))
    assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all()
    assert v.min() >= min(y) - 1e-9 and v.max() <= max(y) + 1e-9


def test_kernel_is_gaussian():
    model = quality_model.FourierRidge(np.zeros(4), np.ones(4), 20_000, 1.0, 3)
    a, b = np.array([[0.1, -0.4, 0.3, 1.0]]), np.array([[0.5, 0.2, -0.1, 0.2]])
    z = model.features(np.vstack([a, b]))[:, :-1]
    assert z[0] @ z[1] == pytest.approx(np.exp(-((a - b) ** 2).sum() / (2 * 4)), abs=0.03)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["A b b.\nA b b.", None, "", "é" * 9, "x | y"]
    whole = quality_model.statistics(pa.array(texts))
    parts = np.vstack([quality_model.statistics(pa.array(["pad"] + texts, pa.string()).slice(i + 1, 1)) for i in range(len(texts))])
    assert np.allclose(whole, parts)


def test_windows_of_millions_of_words(spark):
    """Distinct words have no repeated window at any length; one planted repeat is found."""
    made = spark.range(1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 4300000), x -> concat('w', hex(x))), ' ') AS text")
    more = made.selectExpr("doc_id + 1 AS doc_id", "concat(text, ' w1 w2 w3') AS text")
    got = {r["doc_id"]: r["n"] for r in made.unionByName(more).select("doc_id", quality_rules.repeated_words(quality_rules.words_of(F.col("text"))).alias("n")).collect()}
    assert got == {0: 0, 1: 6}
