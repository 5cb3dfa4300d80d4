import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import toxicity
from lodeweave.llm.words import words


def corpus(n=600, seed=2):
    """Texts in an invented language; toxic ones hold words of a marked stem that no list has."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        toxic = i % 8 == 0
        t = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["zorg", "zorgul", "zorgat"] if i % 16 else ["idiot", "moron"]))
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_learns_words_from_labels(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", F.col("toxic").alias("label")).where("doc_id % 3 <> 0")
    got = {r["doc_id"]: r for r in toxicity.classify(df.drop("toxic"), labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 3 == 0]
    assert sum(p == y for p, y in held) >= 0.98 * len(held)


def test_edges(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None), (2, 0), (50, 1)], "doc_id long, label int")
    none = labels.limit(0)
    for given in (labels, none):
        rows = toxicity.classify(clashing, given).collect()
        assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.classify(empty, given).count() == 0
    told = spark.createDataFrame([(1, "you are an idiot"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.classify(told, none).collect()} == {1: 1, 2: 0, 3: 0}


def test_repeated_rows_score_alike(spark):
    rows = corpus(100)
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string, toxic int").repartition(4)
    scores = {}
    for r in toxicity.classify(df.drop("toxic"), df.selectExpr("doc_id", "toxic as label")).collect():
        assert scores.setdefault(r["doc_id"], r["score"]) == r["score"]


def test_counts():
    found = words(pa.array(["You IDIOT! st*pid 1d10t moron,", "zorgul", "", None, "fine words"]))
    counts = toxicity.Lexicon({"zorg*": 5.0}).counts(found)
    c = {n: counts[:, i] for i, n in enumerate(toxicity.COUNTS)}
    assert c["insults"].tolist() == [2, 0, 0, 0, 0] and c["hidden"][0] == 2 and c["shouted"][0] == 1 and c["near"][0] == 1
    assert c["evidence"].tolist() == [0, 5, 0, 0, 0] and c["n_words"].tolist() == [5, 1, 0, 0, 2]


def test_label_model_with_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    one = np.where(rng.random(len(y)) < 0.9, y, ~y)
    twin = np.where(rng.random(len(y)) < 0.97, one, ~one)  # says what the first says
    others = [np.where(rng.random(len(y)) < 0.85, y, ~y) for _ in range(6)]
    ballots = 2 * np.column_stack([one, twin, *others]).astype(np.int64)
    model = toxicity.LabelModel(0.2).fit(ballots)
    assert 0 in (model.parents[1],) or 1 in (model.parents[0],)
    label = model.posterior(ballots) > 0.5
    assert (label == y).mean() >= 0.9
    assert model.accuracy(ballots)[2] == pytest.approx(0.85, abs=0.08)


def test_label_model_by_brute_force():
    """Posteriors from the tables, one row and voter at a time."""
    rng = np.random.default_rng(2)
    truth = rng.random(400) < 0.2
    ballots = np.column_stack([np.where(rng.random(400) < right, 2 * truth, 1) for right in (0.9, 0.7, 0.5)] + [np.where(rng.random(400) < 0.97, 2 * truth, 2 - 2 * truth)])
    model = toxicity.LabelModel(prior=0.2, trusted=(3,)).fit(ballots)
    for row, got in zip(ballots[:50], model.posterior(ballots[:50])):
        weight = [1 - model.prior, model.prior]
        for i, parent in enumerate(model.parents):
            for c in (0, 1):
                weight[c] *= model.tables[i][c, row[parent] if parent >= 0 else 0, row[i]]
        assert abs(got - weight[1] / sum(weight)) < 1e-9
    assert ((model.posterior(ballots) > 0.5) == truth).mean() > 0.95


def test_a_learnt_beginning_alone_is_no_vote():
    lexicon = toxicity.Lexicon({"réeu*": 4.0}, frozenset({"boco*"}), (1e-4, 1e-2))
    texts = ["réeuxan " + "mot " * 60, "réeuxan réeuxon " + "mot " * 60, "bocoes " + "mot " * 60, "bocoes bocoor " + "mot " * 60, "mot " * 60]
    got = toxicity.votes(lexicon.counts(toxicity.words(pa.array(texts))))
    assert [bool((v == 2).any()) for v in got] == [False, True, False, True, False]
