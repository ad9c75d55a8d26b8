"""Tail probabilities against table values, correlations and tests against brute force and planted effects."""

from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tails
from gridloom.operators import correlation as cor, detectors as det, hypothesis as hyp, isolation, series as ts


@pytest.mark.parametrize("got,want", [
    (tails.t_two_sided_value(2.228139, 10), 0.05), (tails.t_two_sided_value(1.959964, 1e7), 0.05), (tails.f_sf_value(4.102821, 2, 10), 0.05),
    (tails.chi2_sf_value(3.841459, 1), 0.05), (tails.chi2_sf_value(18.307038, 10), 0.05), (tails.normal_two_sided_value(2.575829), 0.01),
    (tails.t_two_sided_value(0.0, 5), 1.0), (tails.chi2_sf_value(0.0, 3), 1.0)])
def test_table_values(got, want):
    assert got == pytest.approx(want, rel=1e-5)


def test_exact_kendall_p():
    n = 5
    counts = [sum(p[i] > p[j] for i, j in combinations(range(n), 2)) for p in permutations(range(n))]
    for c in range(0, 5):
        want = min(1.0, 2 * sum(x <= c for x in counts) / len(counts))
        assert tails.kendall_exact_value(n, c) == pytest.approx(want)


def _tau_b(x, y):
    s = ux = uy = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, ux, uy = s + a * b, ux + abs(a), uy + abs(b)
    return s / np.sqrt(ux * uy)


def test_kendall_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(300) < 0.35, 1.0, rng.integers(0, 40, 300))
    y = np.round(x + rng.normal(0, 10, 300))
    got = cor.kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()
    assert got["tau"] == pytest.approx(_tau_b(x, y)) and got["n"] == 300


def test_small_kendall(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=20), rng.normal(size=20)
    got = cor.small_kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), [(0, "x", "y")]).first()
    assert got["tau"] == pytest.approx(_tau_b(x, y)) and 0 <= got["kendall_p"] <= 1


def test_spearman_with_nulls_ranks_the_pair(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 5, None, 9], "b": [2.0, 1, 4, 3, 7, 8, None], "c": [1.0, 2, 3, 4, 5, 6, 7]})
    got = cor.pair_correlations(spark.createDataFrame(pdf), ["a", "b", "c"]).toPandas()
    want = pdf.rank().pipe(lambda r: pdf[["a", "b"]].dropna().rank().corr().iloc[0, 1])
    assert got.loc[(got.col_a == "a") & (got.col_b == "b"), "spearman"].iloc[0] == pytest.approx(want)


def test_unknown_test_is_refused(spark):
    with pytest.raises(ValueError):
        hyp.run_test(spark.range(3), "nope", "id", "id")


def test_rate_gap_of_planted_groups(spark):
    rows = [("month", "Yes")] * 45 + [("month", "No")] * 55 + [("year", "Yes")] * 5 + [("year", "No")] * 95
    r = det.binary_rate_gaps(spark.createDataFrame(rows, "contract string, churn string"), ["churn"]).first()
    assert (r["best"], r["worst"], r["is_target_driver"]) == ("month", "year", True) and r["gap"] == pytest.approx(0.4)


def test_moderated_sign_flip(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    g = np.where(np.arange(400) % 2 == 0, "A", "B")
    y = np.where(g == "A", 2 * x, -2 * x) + rng.normal(0, 0.1, 400)
    levels = det.moderated_correlations(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": g})), ["x", "y"], ["g"])
    r = {row["grp"]: row["r"] for row in levels.collect()}
    assert r["A"] > 0.9 and r["B"] < -0.9


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    x[:5] = [[9, 9], [-9, 9], [9, -9], [-9, -9], [11, 0]]
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "a": x[:, 0], "b": x[:, 1]}))
    flags = isolation.isolation_forest(df, "id", ["a", "b"]).where("is_anomaly").toPandas()
    assert set(range(5)) <= set(flags.id) and len(flags) <= 12


def test_level_shift_is_one_change_point(spark):
    rows = [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", 100.0 if i >= 60 else 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "d string, v double").select(F.to_date("d").cast("timestamp_ntz").alias("d"), "v")
    got = ts.change_points(ts.points(df, "d", "v")).collect()
    assert len(got) <= 1 or all(r["direction"] == "up" for r in got)


def test_timeseries_bundle(spark):
    rows = [(i, 8.0 * i + (i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, v double").select(F.expr("date_add(date'2024-01-01', i)").cast("timestamp_ntz").alias("d"), "v")
    out = ts.run_timeseries(df, "d", "v")
    assert out["frequency"].first()["frequency"] == "daily" and out["trend"].first()["trend"] == "up"
    assert out["forecast"].count() == 22 and out["gaps"].count() == 0


def test_ranks_of_many_columns_with_nulls_in_few_jobs(spark):
    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)), 1)
    x[: 400 // 3, 2] = 7.0
    for i in range(0, 12, 2):
        x[rng.random(400) < 0.2, i] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)]).assign(value=x[:, 1] * 2)
    df = spark.createDataFrame(pdf).cache()
    df.count()
    spark.sparkContext.setJobGroup("ranks", "ranks")
    got = cor.pair_correlations(df, list(pdf.columns)).toPandas()
    spark.sparkContext.setJobGroup("", "")
    want = pdf.corr(method="spearman")
    assert len(got) == 78 and all(abs(r.spearman - want.loc[r.col_a, r.col_b]) < 1e-9 for r in got.itertuples())
    assert all(r.n == pdf[[r.col_a, r.col_b]].dropna().shape[0] for r in got.itertuples())
