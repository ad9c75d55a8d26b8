"""Imputation against plain loops over rows: chained regressions, nearest donors, awkward tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import impute


def _table(spark, frame):
    df = spark.createDataFrame(frame)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if str(frame[c].dtype) == "float64" else F.col(c) for c in frame.columns])


def _loop(x, gaps, rounds, tolerance=impute.TOLERANCE):
    """The same regressions row by row: fit all columns on the fills so far, then refill them in turn."""
    known = ~np.isnan(x)
    centre = np.array([x[k, i].mean() for i, k in enumerate(known.T)])
    scale = np.array([x[k, i].std() or 1.0 for i, k in enumerate(known.T)])
    z = (x - centre) / scale
    z = np.where(known, z, np.array([np.median(z[k, i]) for i, k in enumerate(known.T)]))
    last = None
    for done in range(1, rounds + 1):
        fits = {}
        for i in gaps:
            rest = [j for j in range(x.shape[1]) if j != i]
            a, y = z[known[:, i]][:, rest], z[known[:, i], i]
            a0, y0 = a.mean(0), y.mean()
            w = np.linalg.solve((a - a0).T @ (a - a0) / len(a) + impute.RIDGE * np.eye(len(rest)), (a - a0).T @ (y - y0) / len(a))
            fits[i] = (rest, w, y0 - a0 @ w)
        for i in gaps:
            rest, w, b = fits[i]
            z[~known[:, i], i] = z[~known[:, i]][:, rest] @ w + b
        now = np.concatenate([np.append(fits[i][1], fits[i][2]) for i in gaps])
        if last is not None and np.abs(now - last).max() < tolerance:
            break
        last = now
    return z * scale + centre, done


@pytest.mark.parametrize("width", [4, 14])
def test_chained_fills_match_a_loop_over_rows(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, width)) + rng.normal(size=(500, width)) * 0.3 + 5
    for i in (0, 1, width - 1):
        x[rng.random(500) < 0.2, i] = np.nan
    cols = [f"c{i}" for i in range(width)]
    df = _table(spark, pd.DataFrame(x, columns=cols).assign(id=np.arange(500)))
    fit = impute.fit_chained(df, "c0", cols[1:])
    want, rounds = _loop(x, [0, 1, width - 1], impute.MAX_ROUNDS)
    got = impute.impute_chained(df, "id", "c0", cols[1:], fit=fit).toPandas().sort_values("id")
    assert fit.columns == cols and fit.converged and fit.caveat is None and len(fit.rounds) == rounds
    assert np.abs(got["c0"].to_numpy() - want[:, 0]).max() < 1e-6
    lines = impute.fitted_lines(df, fit)
    assert lines.count() == 3 * width and {r["converged"] for r in lines.collect()} == {True}


def test_fills_that_still_move_are_told(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 1)) + rng.normal(size=(200, 4)) * 0.1
    for i in range(4):
        x[rng.random(200) < 0.4, i] = np.nan
    df = _table(spark, pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(200)))
    fit = impute.fit_chained(df, "a", list("bcd"), rounds=1)
    assert not fit.converged and "1 rounds" in fit.caveat
    done = impute.impute_chained(df, "id", "a", list("bcd"), fit=fit)
    assert done.count() == 200 and done.where("a IS NULL").count() == 0
    assert {r["converged"] for r in impute.fitted_lines(df, fit).collect()} == {False}


def test_chained_fills_of_awkward_tables(spark):
    schema = "id long, y double, a double, b double, n string, _line string"
    rows = [(i, None if i % 3 == 0 else 2.0 * i, float(i), 7.0, "t", "x") for i in range(30)] + [(99, None, None, None, None, None)] * 2 + [(98, float("nan"), 5.0, 7.0, "t", "x")]
    df = spark.createDataFrame(rows, schema)
    got = impute.impute_chained(df, "id", "y", ["a", "b", "a", "y"])
    assert got.columns == df.columns and got.count() == len(rows) and got.where("y IS NULL").count() == 0
    assert all(abs(r["y"] - 2.0 * r["a"]) < 0.01 for r in got.where("a IS NOT NULL").collect())
    empty = spark.createDataFrame([], schema)
    assert impute.impute_chained(empty, "id", "y", ["a", "b"]).count() == 0
    never = df.withColumn("y", F.lit(None).cast("double"))
    assert impute.impute_chained(never, "id", "y", ["a"]).where("y IS NULL").count() == len(rows)
    assert impute.impute_nearest(empty, "id", "y", ["a"]).count() == 0
    assert impute.impute_nearest(never, "id", "y", ["a"]).where("y IS NULL").count() == len(rows)
    alone = impute.impute_nearest(df, "id", "y", []).where("id = 99").first()["y"]
    assert alone == pytest.approx(np.mean([2.0 * i for i in range(30) if i % 3]))


def _donors(x, v, k):
    """Distance-weighted donors over the coordinates both rows know; ties share what is left of the k places."""
    z = (x - np.nanmean(x, 0)) / np.where(np.nanstd(x, 0) == 0, 1, np.nanstd(x, 0))
    out = v.copy()
    for i in np.flatnonzero(np.isnan(v)):
        both = ~np.isnan(z[i]) & ~np.isnan(z)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.round(np.sqrt(np.nansum(np.where(both, z - z[i], 0) ** 2, axis=1) * x.shape[1] / both.sum(1)), 9)
        ok = ~np.isnan(v) & both.any(1)
        left, top, low = k, 0.0, 0.0
        for at in np.unique(d[ok]):
            here = v[ok & (d == at)]
            if at == 0:
                top, low = here.mean(), 1.0
                break
            use = min(left, len(here))
            top, low, left = top + use / at * here.mean(), low + use / at, left - use
            if left <= 0:
                break
        out[i] = top / low if low else np.nanmean(v)
    return out


@pytest.mark.parametrize("case", ["plain", "unknown", "crowded"])
def test_nearest_fills_match_all_pairs(spark, case, monkeypatch):
    from gridloom.plans import metric

    monkeypatch.setattr(metric, "PIECE", 40)
    rng = np.random.default_rng(5)
    n = 600
    x = np.round(rng.normal(size=(n, 4)), 1 if case == "plain" else 3)
    if case == "unknown":
        monkeypatch.setattr(metric, "PATTERNS", 6)  # the other patterns share the open cells
        x[rng.random(x.shape) < 0.3] = np.nan
    if case == "crowded":
        x[: n // 3] = x[0]
        x[n // 3 : n // 2] = x[0] + rng.normal(size=(n // 2 - n // 3, 4)) * 1e-4
    v = np.round(np.nansum(x, 1) + rng.normal(size=n), 2)
    v[rng.random(n) < 0.25] = np.nan
    df = _table(spark, pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(n), v=v))
    got = impute.impute_nearest(df, "id", "v", list("abcd")).toPandas().sort_values("id")["v"].to_numpy()
    assert np.abs(got - _donors(x, v, 5)).max() < 1e-6


@pytest.mark.parametrize("k", [1, 5, 300])
def test_levels_inside_a_cell_match_all_pairs(k):
    from gridloom.plans.boxes import nearest_levels

    rng = np.random.default_rng(k)
    x, y = np.round(rng.normal(size=(200, 2)), 1), np.unique(np.round(rng.normal(size=(5000, 2)), 2), axis=0)
    w, wv = rng.integers(1, 4, len(y)).astype(float), rng.normal(size=len(y))
    reach = np.where(np.arange(200) % 3 == 0, 0.05, np.inf)
    got = list(zip(*(c.tolist() for c in nearest_levels(x, reach, y, w, wv, 1.5, k, 9))))
    want = []
    for i, d in enumerate(np.round(np.sqrt(((x[:, None] - y) ** 2).sum(axis=2) * 1.5), 9)):
        before = 0.0
        for at in np.unique(d[d <= reach[i]]):
            if before >= k:
                break
            want.append((i, at, w[d == at].sum(), wv[d == at].sum()))
            before += w[d == at].sum()
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_no_row_of_a_box_is_nearer_than_its_bound(spark, monkeypatch):
    from gridloom.plans import boxes, metric

    monkeypatch.setattr(metric, "PIECE", 25)
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=(3000, 3)), 2)
    y[rng.random(y.shape) < 0.2] = np.nan
    y = np.array(sorted({tuple(None if np.isnan(v) else float(v) for v in r) for r in y}, key=str), object)
    donors = spark.createDataFrame([(list(r), 2.0) for r in y], "vec array<double>, w double")
    found, placed = boxes.settle_boxes(donors, 3, 5)
    rows = placed.toPandas()
    assert len(rows) == len(y) and found.cells > 20 and found.weight.sum() == 2 * len(y)
    x = rng.normal(size=(50, 3))
    x[rng.random(x.shape) < 0.3] = np.nan
    low, worth = found.bounds(x)
    of, cell = metric.distances(x, np.array([[np.nan if v is None else v for v in r] for r in rows["vec"]], float)), rows["cell"].to_numpy()
    for c in range(found.cells):
        assert (low[:, c] <= of[:, cell == c].min(axis=1)).all() and (np.isinf(low[:, c]) == np.isinf(of[:, cell == c]).all(axis=1)).all()
    assert np.mean(low == 0) < 0.5 and (worth >= low).all()
