"""The findings table, and corrected p-values over any number of tests."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import hypothesis as hyp, insights, ranking as rk


def test_findings_of_planted_table(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        x = rng.gauss(0, 1)
        rows.append((i, x, 2 * x + rng.gauss(0, 0.1), 5.0, "a" if i < 180 else "b", "left" if i % 2 else "right", 100.0 * (i % 2) + 10 + rng.random(), None if i % 4 == 0 else 1.0 * i))
    df = spark.createDataFrame(rows, "row bigint, x double, y double, flat double, big string, side string, level double, gap double")
    found = insights.collect_findings(df, "row")
    titles = {r["title"] for r in found.collect()}
    assert {"Relationship detected: x & y", "Constant column: flat", "Category dominance: big", "Segment gap: side → level", "Missing data in gap"} <= titles
    assert [r["seq"] for r in found.orderBy("seq").collect()] == list(range(1, found.count() + 1))
    ranked = rk.rank_findings(found)
    assert ranked.agg(F.max("rank")).first()[0] == ranked.count()


def test_findings_of_a_table_without_rows(spark):
    df = spark.createDataFrame([], "row bigint, x double, word string")
    assert insights.collect_findings(df, "row").count() == 0


def test_corrected_p_values_in_blocks_match_one_window(spark):
    rng = random.Random(3)
    rows = [(i, "k1" if i % 3 else "k2", round(rng.random() ** 3, 2)) for i in range(500)] + [(500, "k1", None)]
    df = spark.createDataFrame(rows, "i int, k string, p double")
    a = {r["i"]: r["adj_p"] for r in hyp.benjamini_hochberg(df, "p", ("k",)).collect()}
    b = {r["i"]: r["adj_p"] for r in hyp.benjamini_hochberg(df, "p", ("k",), few_rows=True).collect()}
    assert a.keys() == b.keys() and a[500] is None and b[500] is None
    assert np.allclose([a[i] for i in range(500)], [b[i] for i in range(500)])
