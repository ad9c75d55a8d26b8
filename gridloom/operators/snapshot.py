"""Cross-section of assets: ranked extremes and group comparisons of a market snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.semantic import FINANCE_NAMES
from gridloom.plans.ordered import grouped_quantiles

TOP = 3
# Preferred normalised names per role, best first.
PREFERRED = {
    "return_period": [
        ["return1ypct", "oneyearreturn", "1yreturn", "1yrreturn", "ret1y", "performance1y", "perf1y"],
        ["ytdreturn", "returnytd", "retytd", "perfytd"],
        ["return6mpct", "6mreturn", "ret6m", "perf6m", "performance6m"],
        ["return3mpct", "3mreturn", "ret3m", "perf3m", "performance3m"],
        ["return1mpct", "1mreturn", "ret1m", "perf1m", "performance1m"],
    ],
    "volatility": [
        ["volatility1yann", "volatility1y", "vol1y"],
        ["volatility90dann", "volatility90d", "vol90d"],
        ["volatility30dann", "volatility30d", "vol30d"],
    ],
    "sharpe_ratio": [
        ["sharpe1y"],
        ["sharperatio"],
        ["sharpe"],
    ],
    "analyst_upside": [
        ["analystupsidepct"],
        ["analystupside"],
        ["upsidepct"],
        ["upside"],
        ["targetupside"],
        ["impliedupside"],
    ],
    "position_52w": [
        ["pctof52whigh"],
        ["week52positionpct"],
        ["week52position"],
        ["52weekposition"],
        ["pctfrom52whigh"],
    ],
}


def normal(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch not in " _-.%#@!()[]{}\t")


def role_of(name: str) -> str:
    n = normal(name)
    return next((r for r, names in FINANCE_NAMES.items() if n in names), "unknown")


def choose_columns(columns: list[str]) -> dict[str, str]:
    """The column serving each role: preferred names first, else the first column of the role."""
    out: dict[str, str] = {}
    for role in (*PREFERRED, "asset_class", "sector", "asset_label", "asset_id", "size_metric"):
        have = [c for c in columns if role_of(c) == role]
        if not have:
            continue
        best = next((c for group in PREFERRED.get(role, []) for c in have if normal(c) in group), have[0])
        out[role] = best
    return out


def extremes(df: DataFrame, value: str, label: str | None, title: str, descending: bool, ties: str, k: int = TOP) -> DataFrame:
    """The ``k`` rows at one end with their label and the value in percent units where it is a fraction."""
    v = F.col(value).cast("double")
    rows = df.select(F.coalesce(F.nullif(F.trim(F.col(label).cast("string")), F.lit("")), F.col(ties).cast("string")).alias("asset") if label else F.col(ties).cast("string").alias("asset"),
                     v.alias("value"), F.col(ties).alias("_tie")).where("value IS NOT NULL")
    facts = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("m"))).scalar()
    top = rows.orderBy(F.desc("value") if descending else F.asc("value"), "_tie").limit(k).withColumn("_f", facts).where("_f.n >= 3")
    return top.select(F.lit(title).alias("title"), "asset", F.round("value", 4).alias("value"),
                      F.round(F.when(F.col("_f.m") <= 1, F.col("value") * 100).otherwise(F.col("value")), 1).alias("percent"))


def snapshot_extremes(df: DataFrame, ties: str) -> DataFrame:
    """Top three of every available metric and the bottom three returns."""
    c = choose_columns(df.columns)
    label = c.get("asset_label", c.get("asset_id"))
    plan = [("return_period", "Top return leaders", True), ("return_period", "Largest return laggards", False), ("volatility", "Highest volatility assets", True),
            ("sharpe_ratio", "Best risk-adjusted performers", True), ("analyst_upside", "Highest analyst-implied upside", True)]
    parts = [extremes(df, c[r], label, t, d, ties) for r, t, d in plan if r in c]
    return reduce(lambda a, b: a.unionByName(b), parts)


def group_returns(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean and median return per group of three rows up (two groups at least)."""
    name = F.trim(F.col(group).cast("string"))
    rows = df.select(name.alias("grp"), F.col(value).cast("double").alias("value")).where("value IS NOT NULL").where(
        F.col("grp").isNotNull() & ~F.lower("grp").isin("", "nan", "none", "<na>"))
    m = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean")).where("count >= 3")
    med = grouped_quantiles(rows, ["grp"], "value", {"median": 0.5}).drop("n")
    enough = m.agg(F.count(F.lit(1))).scalar()
    return m.join(med, "grp").withColumn("_k", enough).where("_k >= 2").select("grp", "count", F.round("mean", 4).alias("average_return"), F.round("median", 4).alias("median_return"))


def position_extremes(df: DataFrame, value: str, label: str | None, ties: str) -> DataFrame:
    """Rows nearest to and furthest from their yearly high; values outside the column's scale are excluded and counted."""
    v = F.col(value).cast("double")
    s = df.agg(F.struct(F.avg(v.between(0, 1).cast("int")).alias("unit"), F.max(F.abs(v)).alias("m"))).scalar()
    d = df.withColumn("_s", s).withColumn("_hi", F.when((F.col("_s.unit") >= 0.85) | (F.col("_s.m") <= 1.001), 1.0).otherwise(100.0))
    valid = v.between(F.lit(0.0), F.col("_hi"))
    bad = d.agg(F.count_if(~valid)).scalar()
    ok = d.where(valid)
    high = extremes(ok, value, label, "near_high", True, ties)
    low = extremes(ok, value, label, "low_position", False, ties)
    return high.unionByName(low).withColumn("excluded", bad).drop("percent")
