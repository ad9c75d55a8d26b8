"""Ordered computations under skew: one key and one value hold a third of the rows, blocks are tiny."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.plans import ordered as o


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcde"), n))
    value = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.normal(5, 3, n), 2))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "value": value})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = o.grouped_quantiles(df, ["key"], "value", {"a": 0.1, "m": 0.5, "z": 0.97}, blocks=16).toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        assert got.loc[k, ["a", "m", "z"]].tolist() == pytest.approx(np.quantile(g.value, [0.1, 0.5, 0.97]).tolist())
        assert got.loc[k, "n"] == len(g)


def test_weighted_quantiles(skewed):
    pdf, df = skewed
    counts = df.groupBy("value").agg(F.count(F.lit(1)).alias("w"))
    got = o.grouped_quantiles(counts, [], "value", {"m": 0.25}, weight="w", blocks=8).first()
    assert got["m"] == pytest.approx(np.quantile(pdf.value, 0.25)) and got["n"] == len(pdf)


def test_average_ranks(skewed):
    pdf, df = skewed
    got = o.average_ranks(o.value_counts(df, [], "value"), [], "value", blocks=16).toPandas().set_index("value")["rank"]
    want = pdf.value.rank()
    assert all(got[v] == pytest.approx(r) for v, r in zip(pdf.value, want))


@pytest.mark.parametrize("down", [False, True])
def test_positions_with_a_frequent_value(skewed, down):
    pdf, df = skewed
    got = o.with_position(df, ["key"], "value", "id", descending=down, blocks=16).toPandas().set_index("id")["pos"]
    want = pdf.sort_values(["value", "id"], ascending=[not down, True]).groupby("key").cumcount() + 1
    assert (got.sort_index() == want.sort_index()).all()


def test_frames_and_running_values_across_runs(skewed):
    pdf, df = skewed
    placed = o.with_position(df, ["key"], "id", blocks=8)
    near = o.neighbourhood(placed, ["key"], lambda fr: {"lag2": F.lag("value", 2).over(fr(None, None)), "mean": F.avg("value").over(fr(-4, 3))}, 4, 3, size=10)
    top = o.running(near, ["key"], "value", "max", "top", size=10).toPandas().set_index("id").sort_index()
    total = o.running(placed, ["key"], "value", "sum", "total", size=10).toPandas().set_index("id").sort_index()
    assert len(top) == len(pdf)
    for _, g in pdf.groupby("key"):
        v = g.value.to_numpy()
        assert top.loc[g.index, "lag2"].tolist()[2:] == pytest.approx(v[:-2].tolist())
        assert top.loc[g.index, "mean"].tolist() == pytest.approx([v[max(0, i - 4): i + 4].mean() for i in range(len(v))])
        assert top.loc[g.index, "top"].tolist() == pytest.approx(np.maximum.accumulate(v).tolist())
        assert total.loc[g.index, "total"].tolist() == pytest.approx(np.cumsum(v).tolist())


def test_last_known_value(spark):
    df = spark.createDataFrame([(i, float(i) if i % 7 == 3 else None) for i in range(1, 60)], "pos bigint, v double")
    got = [r["f"] for r in o.running(df, [], "v", "last", "f", size=5).orderBy("pos").collect()]
    want, last = [], None
    for i in range(1, 60):
        last = float(i) if i % 7 == 3 else last
        want.append(last)
    assert got == want
