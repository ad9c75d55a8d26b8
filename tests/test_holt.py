"""Damped Holt against the plain recursion, for short, long and crowded series."""

import numpy as np
import pandas as pd

from gridloom.operators import holt


def _plain(y):
    """Best parameters by a loop over the grid: errors, level and trend of each."""
    best = None
    for a, b, phi in holt.GRID:
        level, trend, errors = y[0], y[1] - y[0], []
        for v in y[1:]:
            ahead = level + phi * trend
            errors.append(v - ahead)
            now = ahead + a * (v - ahead)
            level, trend = now, b * (now - level) + (1 - b) * phi * trend
        sse = float(np.square(errors).sum())
        if best is None or sse < best[0] * (1 - 1e-12):
            best = (sse, (a, b, phi), level, trend, float(np.std(errors, ddof=1)))
    return best


def _check(rows, series):
    for k, y in series.items():
        r, (sse, params, level, trend, spread) = rows[k], _plain(y)
        assert (r["alpha"], r["beta"], r["phi"]) == params and r["n"] == len(y)
        assert np.allclose([r["sse"], r["level"], r["trend"], r["deviation"]], [sse, level, trend, spread], rtol=1e-7, atol=1e-7)


def _points(spark, series):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "date": pd.date_range("2020-01-01", periods=len(y)).date, "value": y}) for k, y in series.items()]))


def test_fits_match_the_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(holt, "RUN", 20)
    monkeypatch.setattr(holt, "FAN", 3)
    monkeypatch.setattr(holt, "ABREAST", 4)
    rng = np.random.default_rng(0)
    series = {f"s{i}": np.cumsum(rng.normal(size=n)) * 10 + 100 for i, n in enumerate([10, 11, 21, 22, 40, 41, 42, 150, 333])}
    series["flat"] = np.full(30, 7.0)
    pts = _points(spark, series)
    _check({r["k"]: r for r in holt.fit_holt(pts, ["k"]).collect()}, series)
    alone = {"x": series["s8"]}
    _check({"x": holt.fit_holt(_points(spark, alone).drop("k")).first()}, alone)


def test_forecasts_and_short_series(spark):
    rng = np.random.default_rng(1)
    series = {"long": np.arange(60.0) + rng.normal(size=60), "short": np.array([1.0, 2.0, 4.0]), "one": np.array([5.0])}
    pts = _points(spark, series).unionByName(spark.createDataFrame([(None, None, 3.0), ("long", None, 9.0)], "k string, date date, value double"))
    rows = holt.holt_forecast(pts, ["k"]).collect()
    _, (a, b, phi), level, trend, spread = _plain(series["long"])
    got = sorted((r["step"], r["forecast"], r["upper_80"]) for r in rows if r["k"] == "long")
    ahead = [level + trend * sum(phi**i for i in range(1, h + 1)) for h in range(1, 16)]
    assert [g[0] for g in got] == list(range(1, 16)) and np.allclose([g[1] for g in got], ahead, atol=1e-4)
    assert np.allclose([g[2] for g in got], [f + 1.28 * spread * (h + 1) ** 0.5 for h, f in enumerate(ahead)], atol=1e-4)
    assert {r["k"]: r["model_used"] for r in rows} == {"long": "damped_holt", "short": "drift"}
    assert sorted(r["forecast"] for r in rows if r["k"] == "short")[:2] == [6.0, 8.0]
    assert holt.holt_forecast(pts.limit(0), ["k"]).count() == 0 and holt.holt_forecast(pts.limit(0).drop("k")).count() == 0
