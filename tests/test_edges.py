"""Ordinary input that the given tables don't hold: constants, zeros, infinities, nulls, clashing labels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates, charts, correlation, detectors, filters, hypothesis, outliers
from gridloom.plans.clean import clean_dataset
from gridloom.plans.ordered import grouped_quantiles
from gridloom.sources.prepared import content_hash


@pytest.fixture(scope="module")
def constant(spark):
    return spark.range(60).select("id", F.lit(5.0).alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") * 2.0).alias("w"), (F.col("id") * 1.0).alias("u"))


def test_constant_columns(constant):
    assert outliers.worst_rows(constant, "id", "v").count() == 0
    assert outliers.method_counts(constant, "v").first()["combined"] == 0
    assert [(r["bin"], r["value"]) for r in outliers.outlier_histogram(constant, "v").collect()] == [(0, 60)]
    assert [(r["bin"], r["value"]) for r in charts.histogram(constant, "v").collect()] == [(0, 60)]
    assert [(r["bin"], r["value"]) for r in charts.pooled_histogram(constant, "v").collect()] == [(0, 60)]
    assert correlation.histogram_overlap(constant.select("v", F.col("v").alias("x")), "v", "x").first()[0] == 1.0
    assert detectors.segment_gaps(constant.select("g", F.when(F.col("g") == "a", 1.0).otherwise(9.0).alias("v")), ["g"], ["v"]).count() >= 0
    assert hypothesis.welch_ttest(constant, "v", "g").count() == 1


def test_collinear_columns(constant):
    assert correlation.partial_correlation(constant.withColumn("x", F.rand(1)), "u", "x", "w").first()["partial_r"] is None


def test_formulas_divide_by_zero_to_null(spark):
    df = spark.createDataFrame([(0, 4.0), (2, 4.0)], "id int, x double")
    got = [r["y"] for r in filters.derive(df, "y", "x / id + (x / (id * 1e-3)) * 0 + log(x) * 0 + x % (id + 1) * 0").orderBy("id").collect()]
    assert got == [None, 2.0]


def test_infinite_values_have_quantiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(99)] + [(float("inf"),)] * 30 + [(float("-inf"),)] * 30, "v double")
    assert grouped_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 49.0


def test_deep_pages_hold_null_rows(spark):
    df = spark.range(150_000).select("id", F.when(F.col("id") < 120_000, F.col("id") % 1000).alias("v"))
    rows = filters.page(df, "v", "id", 1499, 100).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(149_800, 149_900)) and rows[0]["total_pages"] == 1500
    mixed = filters.page(df, "v", "id", 1200, 100).collect()
    assert len(mixed) == 100 and all(r["v"] == 999 for r in mixed)
    assert len(filters.page(df, "v", "id", 1201, 100, descending=True).where("v is null").collect()) == 100


def test_content_keys_see_where_nulls_stand(spark):
    kind = "a string, b string"
    one = spark.createDataFrame([("x", None), (None, "y")], kind)
    two = spark.createDataFrame([(None, "x"), ("y", None)], kind)
    assert content_hash(one) != content_hash(two) and content_hash(one) == content_hash(one.orderBy("b"))


def test_pivot_rows_with_the_margin_label(spark):
    df = spark.createDataFrame([("Grand Total", "c", 1.0), ("other", "Grand Total", 2.0), *[(f"r{i}", "c", 1.0) for i in range(30)]], "r string, c string, v double")
    rows = [(r["r"], r["Grand Total"], r["Grand Total (data)"]) for r in aggregates.pivot(df, ["r"], ["c"], "v").collect()]
    assert len(rows) == 33 and sorted(x for x in rows if x[0] == "Grand Total") == [("Grand Total", 1.0, 0.0), ("Grand Total", 33.0, 2.0)]


def test_cleaning_after_dropped_columns(spark):
    rows = [(None, i, f"T{i}", float(i), dt.date(2024, 1, 1 + i % 28)) for i in range(40)]
    df = spark.createDataFrame(rows, "empty string, `Row Id` int, `My Text` string, num double, day date")
    done = clean_dataset(df, "Row Id")
    assert done.data.columns[:4] == ["row_id", "my_text", "num", "day"] and done.data.count() == 40


def test_thirty_columns_all_take_part(spark):
    """The last of thirty columns holds what each detector looks for."""
    base = spark.range(400).withColumn("day", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id as int))"))
    noise = {f"n{i:02d}": ((F.xxhash64("id", F.lit(i)) % 1000) / 1000.0) for i in range(28)}
    df = base.withColumns(noise).withColumns({
        "z1": F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") * 1.0), "z2": F.col("id") * 3.0 + F.col("n00"),
        "gap": F.when(F.col("id") < 300, 1.0), "g": F.when(F.col("id") < 200, "low").otherwise("high"),
    })
    nums = [*noise, "z1", "z2", "gap"]
    assert "z1" in {r["column"] for r in detectors.univariate_anomalies(df, nums).collect()}
    assert "z1" in {r["column"] for r in detectors.skewness_findings(df, nums).collect()}
    assert ("g", "z2") in {(r["cat_col"], r["num_col"]) for r in detectors.segment_gaps(df, ["g"], nums).collect()}
    assert "z2" in {r["column"] for r in detectors.trend_findings(df, "day", nums).collect()}
    assert ("gap", "z2") in {(r["missing_column"], r["column"]) for r in detectors.missing_patterns(df, ["z2"]).collect()}
    assert "z2" in {r["column"] for r in detectors.vif(df, [*noise, "z2", "id"]).collect()}


def test_ad_hoc_sql_reads_its_table_only(spark):
    from gridloom.operators.adhoc import run_sql

    df = spark.range(10).withColumnRenamed("id", "x")
    spark.range(3).createOrReplaceTempView("data")
    assert run_sql(df, "select 'update -- kept; drop' as s, max(x) as m from data -- gone").first() == ("update -- kept; drop", 9)
    assert spark.table("data").count() == 3
    for sql in ("select * from parquet.`/tmp/x`", "select (select count(*) from other) from data", "select java_method('java.lang.System', 'nanoTime') from data",
                "select `reflect`('java.lang.System', 'nanoTime') from data", "select 1 from data; drop table x"):
        with pytest.raises(ValueError):
            run_sql(df, sql)
