"""Cleaning rules on small tables with planted problems."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cleaning as cl, impute, profile as pf
from gridloom.plans.clean import clean_dataset


@pytest.fixture(scope="module")
def messy(spark):
    rng = np.random.default_rng(5)
    n = 200
    base = rng.normal(500, 50, n)
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "Order Date": [f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(n)],
        "Revenue ($)": [f"${v * 2:,.2f}" for v in base], "costs": base, "Margin": [f"{5 + i % 20}%" for i in range(n)],
        "Region": ["NORTH SIDE" if i % 2 else "SOUTH SIDE" for i in range(n)], "is active": [["Yes", "no", "Y", "TRUE", "off", "n"][i % 6] for i in range(n)],
        "sparse": [1.0 if i % 10 == 0 else None for i in range(n)], "same": base, "note": ["n/a" if i % 5 == 0 else f"text {i}" for i in range(n)]})
    copies = pdf.iloc[:5].assign(row_id=[n + i for i in range(5)])
    return spark.createDataFrame(pd.concat([pdf, copies]))


def test_aggressive_flow(messy):
    out = clean_dataset(messy, "row_id")
    d = out.data
    kinds = dict(d.dtypes)
    assert d.count() == 200
    assert kinds["revenue"] == "double" and kinds["margin"] == "double" and kinds["order_date"] == "timestamp_ntz"
    assert "sparse" not in kinds and "same" not in kinds and "order_date_month" in kinds
    assert {r[0] for r in d.select("is_active").distinct().collect()} == {"yes", "no"}
    assert {r[0] for r in d.select("region").distinct().collect()} == {"North Side", "South Side"}
    kinds_seen = {r["kind"] for r in out.audit.collect()}
    assert {"placeholder", "drop_rows", "drop_column", "rename", "type_fix", "boolean", "impute", "casing"} <= kinds_seen
    s = out.summary.first()
    assert s["final_rows"] == 200 and 0 <= s["score"] <= 100


def test_safe_flow_changes_nothing(messy):
    out = clean_dataset(messy, "row_id", "safe")
    assert out.data.columns == messy.columns and out.data.count() == 205
    assert {r["impact"] for r in out.audit.collect()} == {"warning"}


def test_names():
    assert cl.snake_case("  Net-Sales (EUR) ") == "net_sales_eur"
    assert cl.unique_names(["age", "age", "age"]) == ["age", "age_1", "age_2"]


def test_mixed_dates_use_the_fixed_order(spark):
    df = spark.createDataFrame([("2024-03-04",), ("04/03/2024",), ("12/25/2024",), ("March 4, 2024",), ("20240304",), ("x",)], "d string")
    got = [r[0] and r[0].strftime("%Y-%m-%d") for r in df.select(cl.parse_dates("d")).collect()]
    assert got == ["2024-03-04", "2024-03-04", "2024-12-25", "2024-03-04", "2024-03-04", None]


def test_isolate_nulls_outside_values(spark):
    df = spark.createDataFrame([(1.0,), (50.0,), (None,)], "x double")
    assert [r[0] for r in cl.treat_outliers(df, {"x": (0.0, 10.0)}, "isolate").collect()] == [1.0, None, None]


def test_chained_imputation_recovers_a_line(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = 3 * a - 2 * b + 1
    pdf = pd.DataFrame({"id": range(300), "a": a, "b": b, "c": a + b, "y": np.where(np.arange(300) % 6 == 0, np.nan, y)})
    df = spark.createDataFrame(pdf).withColumn("y", F.nullif("y", F.lit(float("nan"))))
    got = impute.impute_chained(df, "id", "y", ["a", "b", "c"]).toPandas().sort_values("id").y.to_numpy()
    assert np.abs(got - y).max() < 0.05


def test_nearest_imputation_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(120, 2))
    v = z[:, 0] * 2
    miss = np.arange(120) % 10 == 0
    pdf = pd.DataFrame({"id": range(120), "p": z[:, 0], "q": z[:, 1], "v": np.where(miss, np.nan, v)})
    df = spark.createDataFrame(pdf).withColumn("v", F.nullif("v", F.lit(float("nan"))))
    got = impute.impute_nearest(df, "id", "v", ["p", "q"]).toPandas().sort_values("id").v.to_numpy()
    s = (z - z.mean(0)) / z.std(0)
    close = 0
    for i in np.flatnonzero(miss):
        d = np.sqrt(((s[~miss] - s[i]) ** 2).sum(1))
        k = np.argsort(d)[:5]
        want = (v[~miss][k] / d[k]).sum() / (1 / d[k]).sum()
        close += abs(want - got[i]) < 1e-6
    assert close == miss.sum()


def test_profile_flags(spark):
    df = spark.createDataFrame([(i, 7, "a" if i % 3 else None) for i in range(60)], "i int, c int, t string")
    flags = {r["column"]: r["flags"] for r in pf.quality_flags(pf.full_profile(df)).collect()}
    assert "constant column" in flags["c"] and "high missing data" in flags["t"]
