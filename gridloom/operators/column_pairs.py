"""Comparison of two columns by their kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tails import chi2_sf, f_sf, t_two_sided
from gridloom.operators.aggregates import crosstab, group_rare
from gridloom.operators.correlation import compare_numeric
from gridloom.operators.detectors import pooled_d
from gridloom.operators.hypothesis import benjamini_hochberg, chi_square_parts, contingency, effect_label, welch_parts
from gridloom.plans.ordered import grouped_quantiles
from gridloom.plans.stacked import numeric_columns

TOP_GROUPS = 10


def sample_loss(df: DataFrame, a: str, b: str) -> DataFrame:
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_total"), F.count_if(ok).alias("n_used"), F.count_if(~ok).alias("n_dropped"),
                  F.round(F.count_if(~ok) / F.greatest(n, F.lit(1)) * 100, 1).alias("pct_dropped"))


def _top_rows(df: DataFrame, num: str, cat: str) -> DataFrame:
    rows = df.select(num, cat).na.drop()
    top = rows.groupBy(cat).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), cat).limit(TOP_GROUPS)
    return rows.join(F.broadcast(top.drop("_n")), cat)


def box_stats(df: DataFrame, num: str, cat: str) -> DataFrame:
    """Count, mean, std, range and quartiles of the ten largest groups."""
    rows = _top_rows(df, num, cat)
    m = rows.groupBy(cat).agg(F.count(num).alias("count"), F.avg(num).alias("mean"), F.stddev_samp(num).alias("std"),
                              F.min(num).alias("min"), F.max(num).alias("max")).where("count >= 2")
    q = grouped_quantiles(rows, [cat], num, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    return m.join(q, cat).select(F.col(cat).alias("category"), "count", *[
        F.round(F.col(c).cast("double"), 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q1", "q3")])


def _moments(df: DataFrame, num: str, cat: str) -> DataFrame:
    return _top_rows(df, num, cat).groupBy(F.col(cat).alias("g")).agg(
        F.count(num).cast("double").alias("n"), F.avg(num).alias("mean"), F.var_samp(num).alias("var")).where("n >= 2")


def group_test(df: DataFrame, num: str, cat: str) -> DataFrame:
    """Welch's t-test for two groups, one-way ANOVA for more, over the ten largest groups."""
    g = _moments(df, num, cat)
    gm = g.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    s = F.struct("n", "mean", "var")
    a = g.withColumn("_gm", gm).agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_gm"), F.lit(2))).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
        F.max_by(s, F.struct("n", "g")).alias("a"), F.min_by(s, F.struct("n", "g")).alias("b"))
    parts = [F.col(f"{e}.{f}") for e in "ab" for f in ("n", "mean", "var")]
    t, dof = welch_parts(*parts)
    d = F.abs(pooled_d(*parts))
    eta = F.col("between") / (F.col("between") + F.col("within"))
    a = a.withColumns({"_t": t, "_dof": dof, "_d1": F.col("k") - 1, "_d2": F.col("n") - F.col("k")})
    a = a.withColumn("_f", (F.col("between") / F.col("_d1")) / (F.col("within") / F.col("_d2")))
    a = a.withColumn("_pt", t_two_sided("_t", "_dof")).withColumn("_pf", f_sf("_f", "_d1", "_d2"))
    two = F.col("k") == 2
    p = F.when(two, F.col("_pt")).otherwise(F.col("_pf"))
    return a.where("k >= 2").select(
        F.when(two, "welch").otherwise("anova").alias("test_used"), F.col("k").cast("bigint").alias("groups"),
        F.round(p, 6).alias("p_value"), F.round(F.when(two, d).otherwise(eta), 4).alias("effect_size"),
        F.when(two, effect_label(d)).otherwise(F.when(eta > 0.14, "large").when(eta > 0.06, "medium").otherwise("small")).alias("effect_label"),
        (p < 0.05).alias("is_significant"))


def pairwise_tests(df: DataFrame, num: str, cat: str) -> DataFrame:
    """Welch's t-test of every pair of the ten largest groups (45 at most) with adjusted p-values."""
    g = _moments(df, num, cat)
    a = g.select(*[F.col(c).alias(f"{c}_a") for c in g.columns])
    b = g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    j = a.join(F.broadcast(b), F.col("g_a") < F.col("g_b"))
    parts = [F.col(f"{f}_{e}") for e in "ab" for f in ("n", "mean", "var")]
    t, dof = welch_parts(*parts)
    j = j.withColumn("_t", t).withColumn("_dof", dof).withColumn("p", F.round(t_two_sided("_t", "_dof"), 4))
    j = benjamini_hochberg(j, "p", out="adjusted_p", few_rows=True)
    return j.select(F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), "p", F.round(F.abs(pooled_d(*parts)), 4).alias("cohens_d"),
                    F.round("adjusted_p", 6).alias("adjusted_p"), (F.col("adjusted_p") < 0.05).alias("significant_adjusted"))


def category_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and Cramer's V of two category columns after grouping rare values."""
    both = df.select(a, b).na.drop()
    grouped = group_rare(group_rare(both, a, 8, "_a"), b, 8, "_b")
    parts = chi_square_parts(contingency(grouped, "_a", "_b"), "_a", "_b")
    v = F.col("v")
    return parts.withColumn("_p", chi2_sf("chi2", "dof")).select(
        F.col("n").cast("bigint").alias("n"), F.round("_p", 6).alias("chi2_p"), F.round(v, 4).alias("cramers_v"),
        F.when(v < 0.1, "negligible").when(v < 0.3, "weak").when(v < 0.5, "moderate").otherwise("strong").alias("cramers_label"),
        (F.col("_p") < 0.05).alias("is_significant"))


def compare_pair(df: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    """All result tables for two columns, chosen by their kinds."""
    for c in (a, b):
        if c not in df.columns:
            raise ValueError(f"column {c!r} not found")
    if a == b:
        raise ValueError("two different columns are needed")
    nums = set(numeric_columns(df))
    loss = {"sample_loss": sample_loss(df, a, b)}
    if a in nums and b in nums:
        return {"kind": "num_num", "result": compare_numeric(df, a, b), **loss}
    if a not in nums and b not in nums:
        return {"kind": "cat_cat", "result": category_test(df, a, b), "heatmap": crosstab(df, a, b), **loss}
    num, cat = (a, b) if a in nums else (b, a)
    return {"kind": "num_cat", "result": group_test(df, num, cat), "groups": box_stats(df, num, cat),
            "pairwise": pairwise_tests(df, num, cat), **loss}
