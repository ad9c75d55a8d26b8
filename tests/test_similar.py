"""Similarity operators against brute force, with a hot group of copies."""

from itertools import combinations

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from gridloom.operators import similar as sm


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_length():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc "), rng.integers(0, 12))) for _ in "xy")
        assert sm.common_length(a, b) == _lcs(a, b)


def test_pairs_are_complete(spark):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcdef"), rng.integers(1, 22))) for _ in range(60)]
    texts = base + [w[:-1] + "x" for w in base] + [w + "y" for w in base[:30]] + ["ab", "a b", "b a", "abc", "abcd"]
    pdf = pd.DataFrame({"id": range(len(texts)), "t": texts})
    got = {(r["value_a"], r["value_b"]) for r in sm.similar_texts(spark.createDataFrame(pdf), "t", "id").collect()}
    first = pdf.groupby("t").id.min().sort_values()
    norm = {t: " ".join(sorted(t.split())) for t in first.index}
    want = {(a, b) for a, b in combinations(first.index, 2) if 200 * _lcs(norm[a], norm[b]) / (len(norm[a]) + len(norm[b])) >= 85}
    assert got == want


def test_groups_follow_the_first_value(spark):
    rows = [(1, "acme corporation"), (2, "corporation acme"), (3, "acme corporatio"), (4, "zebra"), (5, "acme corporations")] + [(6 + i, "acme corporation") for i in range(20)]
    got = sm.fuzzy_groups(spark.createDataFrame(rows, "id int, t string"), "t", "id").collect()
    assert {r["canonical"] for r in got} == {"acme corporation"} and len(got) == 3


def test_near_rows_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 2)
    x[:100] = x[0]
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(300))
    got = {(r["first_id"], r["second_id"]) for r in sm.near_duplicate_rows(spark.createDataFrame(pdf), "id", list("abc")).collect()}
    assert {(i, i + 1) for i in range(99)} <= got
    z = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    limit = max(0.05, np.quantile(d.min(1), 0.05))
    want = {(i, i + 1 + int(np.argmin(d[i, i + 1:]))) for i in range(99, 299) if d[i, i + 1:].min() <= limit}
    assert {p for p in got if p[0] >= 99} == want


def test_near_rows_with_a_third_in_one_cell(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    far = rng.normal(size=(600, 5))
    dense = rng.normal(size=(300, 5)) * 1e-3 + 0.5
    x = np.vstack([far, dense])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, c double, d double, e double")
    got = {r["first_id"]: (r["second_id"], r["distance"]) for r in sm.near_duplicate_rows(df, "id", ["a", "b", "c", "d", "e"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    dist = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    limit = max(0.05, np.quantile(dist.min(1), 0.05))
    want = {}
    for i in range(len(x) - 1):
        j = i + 1 + int(np.argmin(dist[i, i + 1:]))
        if dist[i, j] <= limit:
            want[i] = (j, round(float(dist[i, j]), 4))
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-4 for i in want)


def test_near_duplicate_embeddings_read_whole_vectors(spark, tmp_path):
    import numpy as np

    import __spark_entry__

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12))
    x[30:40] = x[:10] + rng.normal(size=(10, 12)) * 0.004
    x[40:50, :8] = x[10:20, :8]  # equal in the first eight components only
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) + np.where(np.eye(60) > 0, np.inf, 0)
    limit = max(0.05, np.quantile(d.min(axis=1), 0.05))
    want = {(i, j, round(d[i, j], 4)) for i in range(59) for j in [i + 1 + int(d[i, i + 1 :].argmin())] if d[i, j] <= limit}
    got = {tuple(r) for r in __spark_entry__.queries()["near_duplicate_embeddings"](spark, str(tmp_path)).collect()}
    assert want and {g[:2] for g in got} == {w[:2] for w in want}


def _brute_near(ids, x):
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    limit = max(0.05, np.quantile(d.min(1), 0.05))
    later = np.where(ids[None, :] > ids[:, None], d, np.inf)
    return {int(ids[i]): later[i].min() for i in range(len(ids)) if later[i].min() <= limit}


def test_wide_vectors_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 100))
    x[:40] = x[40:80] + rng.normal(size=(40, 100)) * 0.01
    ids = rng.permutation(700)
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, x)] + [(-1, None, "x"), (-2, [0.5] * 3, "x"), (-3, [None] + [0.5] * 99, "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, cell string")
    got = sm.near_duplicate_vectors(df, "id", "v").collect()
    want = _brute_near(ids, x)
    assert {r["first_id"] for r in got} == set(want) and all(abs(r["distance"] - want[r["first_id"]]) < 1e-4 for r in got)
    assert sm.near_duplicate_vectors(df.limit(0), "id", "v").count() == 0


def test_crowded_vectors_split_and_match_brute_force(spark, monkeypatch):
    from gridloom.plans import metric

    monkeypatch.setattr(metric, "PIECE", 50)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 6)) * 3
    x[:250] = x[0] + rng.normal(size=(250, 6)) * 1e-3  # over a third in one spot
    x[250:300] = x[299]  # equal rows
    x[:, 5] = 1.0
    cols = list("abcdef")
    pdf = pd.DataFrame(x, columns=cols).assign(id=np.arange(600))
    got = sm.near_duplicate_rows(spark.createDataFrame(pdf), "id", cols).collect()
    want = _brute_near(np.arange(600), x)
    assert {(i, i + 1, 0.0) for i in range(250, 299)} <= {tuple(r) for r in got}
    assert {r["first_id"] for r in got} == set(want) and all(abs(r["distance"] - want[r["first_id"]]) < 1e-4 for r in got)


def test_no_cell_within_reach_is_skipped():
    from gridloom.plans import metric

    rng = np.random.default_rng(4)
    for unknown in (0.0, 0.3):
        x, y, p = (np.where(rng.random((n, 5)) < unknown, np.nan, rng.normal(size=(n, 5))) for n in (60, 400, 12))
        p = np.vstack([p, np.ones((1, 5))])
        cells = metric.Cells(p, np.zeros(13), np.zeros(13))
        home, gap = cells.homes(y)
        for c in range(13):
            cells.reach[c] = gap[home == c].max() if (home == c).any() else 0.0
        cells.open_rows = int((home == 13).sum())
        low, _ = cells.bounds(x)
        d = metric.distances(x, y)
        assert (low[:, home] <= d + 1e-12).all()


def test_word_shared_by_all_values(spark, monkeypatch):
    monkeypatch.setattr(sm, "HOT", 5)
    rng = np.random.default_rng(11)
    texts = [f"incorporated {''.join(rng.choice(list('abcdefghij'), rng.integers(2, 9)))}" for _ in range(150)]
    texts += [t[:-1] + "z" for t in texts[:60]] + [f"{''.join(rng.choice(list('abc'), rng.integers(1, 6)))}" for _ in range(60)]
    pdf = pd.DataFrame({"id": range(len(texts)), "t": texts})
    got = {(r["a"], r["b"]) for r in sm.similar_texts(spark.createDataFrame(pdf), "t", "id").collect()}
    first = pdf.groupby("t").id.min()
    norm = {v: " ".join(sorted(t.split())) for t, v in first.items()}
    want = {(a, b) for a, b in combinations(sorted(norm), 2) if 200 * sm.common_length(norm[a], norm[b]) / (len(norm[a]) + len(norm[b])) >= 85}
    assert got == want and len(want) > 50


def test_frequent_words_meet_on_several_tokens(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(24)]
    texts = sorted({" ".join(sorted(rng.choice(words, 4, replace=False))) for _ in range(700)})
    vals = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "vid long, text string").withColumn("len", F.length("text")).cache()
    few = {tuple(r) for r in sm._candidates(vals, 2).collect()}
    monkeypatch.setattr(sm, "HOT", 10**9)
    many = {tuple(r) for r in sm._candidates(vals, 2).collect()}
    like = {(a, b) for (a, x), (b, y) in combinations(enumerate(texts), 2) if 200 * sm.common_length(x, y) / (len(x) + len(y)) >= 85}
    assert like <= few < many


def test_similar_texts_of_awkward_tables(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "a"), (5, "a"), (6, "A"), (7, "x" * 3000), (8, "x" * 2999 + "y"), (None, "lone value"), (9, "lone  value")]
    df = spark.createDataFrame(rows, "id long, value string").withColumn("len", F.lit("clash"))
    assert {(r["a"], r["b"]) for r in sm.similar_texts(df, "value", "id").collect()} == {(7, 8)}
    assert sm.fuzzy_groups(df.limit(0), "value", "id").count() == 0
