"""Toxicity: held-out rows, the learner beside a plain loop, features beside a plain loop, awkward inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import toxicity
from gridloom.llm.queries import op11_ftrl_toxicity

DIR = "/root/testdata/sf0.1"


def test_held_out(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = op11_ftrl_toxicity(spark, DIR).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    caught = [r["predicted"] for r in held if r["toxic"] == 1]
    wrong = [r["predicted"] for r in held if r["toxic"] == 0]
    assert np.mean(caught) > 0.88 and np.mean(wrong) < 0.02


def test_learner_like_plain_loop():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 16, 4)), int(rng.integers(0, 2))) for _ in range(60)]
    learner = toxicity.Ftrl.empty(4, l1=0.3)
    z, n = [0.0] * 17, [0.0] * 17
    for features, y in rows:
        learner.learn(features, y)
        at = [*features.tolist(), 16]
        w = {}
        for i in at:
            free = 0.0 if i == 16 else 0.3
            w[i] = 0.0 if abs(z[i]) <= free else -(z[i] - math.copysign(free, z[i])) / ((1 + math.sqrt(n[i])) / 1.0 + 1.0)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * w[i]
            n[i] += g * g
    assert learner.z == pytest.approx(z) and learner.n == pytest.approx(n)


def test_features_stay_in_their_text():
    texts = [b"one two three", None, b"", b"Two", b"three four_five one"]
    who, features = toxicity.hashed_features(texts)
    alone = [np.sort(toxicity.hashed_features([t])[1]) for t in texts]
    assert all((np.sort(features[who == i]) == alone[i]).all() for i in range(len(texts)))
    # Words, stems, neighbours and pairs with one word between.
    assert [len(x) for x in alone] == [3 + 1 + 2 + 1, 0, 0, 1, 4 + 1 + 3 + 2]
    assert set(toxicity.hashed_features([b"TWO"])[1]) <= set(alone[0])


def test_scores_sum_distinct_features_of_whole_texts():
    texts = [b"bad bad words " * 50, b"fine words", b"", None, b"word " * 50000 + b"bad"]
    rows = [(np.unique(toxicity.hashed_features([t])[1]), y) for t, y in [(b"bad thing %d" % i, 1) for i in range(40)] + [(b"fine thing %d" % i, 0) for i in range(60)]]
    model = toxicity.fit_ftrl(rows, 0.4)
    dense = np.zeros(1 << model.bits)
    dense[model.at] = model.weight
    want = [model.bias + dense[np.unique(toxicity.hashed_features([t])[1])].sum() for t in texts]
    assert model.raw(texts) == pytest.approx(want, abs=1e-5)
    assert (model.scores(texts) >= 0.3).tolist() == [True, False, False, False, True]


def test_awkward_tables(spark):
    rows = [(i, f"you idiot {i}" if i % 3 == 0 else f"a fine day {i}", "n") for i in range(200)]
    rows += [(None, "you idiot", "n"), (7, None, "n"), (8, "", "n"), (9, "idiot " * 100000, "n")] + [(300, "you idiot again", "n")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (3, 1), (5, None), (6, 7), (300, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(df, labels).collect()
    assert len(got) == len(rows)
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in (None, 300)) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels)).columns == ["doc_id", "text", "score"]
    assert toxicity.toxicity_report(df.limit(0), labels).count() == 0
    none = toxicity.toxicity_report(df, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert {r["predicted"] for r in toxicity.toxicity_report(df, labels.where("toxic = 1")).collect()} == {1}
    assert toxicity.toxicity_report(df.withColumn("text", F.lit(None).cast("string")), labels).count() == len(rows)


def test_sample_is_bounded_for_one_id_with_many_texts(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "fine").otherwise("idiot"), F.lit(" "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    taught = []
    fit = toxicity.fit_ftrl
    toxicity.fit_ftrl = lambda rows, share: taught.extend(rows) or fit(rows, share)
    try:
        toxicity.fit_toxicity(df, labels, docs_each=100)
    finally:
        toxicity.fit_ftrl = fit
    assert 100 < len(taught) < 300
