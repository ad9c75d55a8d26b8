"""Statistical tests. Every test is one or two aggregates over the rows plus closed forms over the aggregate row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.moments import chi2_sf_2df, k_squared
from gridloom.functions.tails import chi2_sf, f_sf, normal_two_sided, t_two_sided
from gridloom.plans.ordered import average_ranks, grouped_quantiles, running, running_before, value_counts, with_position
from gridloom.session import settle

# Upper limits of the labels small, medium and large per effect measure.
EFFECT_LIMITS = {
    "cohens_d": (0.2, 0.5, 0.8), "cramers_v": (0.1, 0.3, 0.5), "eta_squared": (0.01, 0.06, 0.14), "r": (0.1, 0.3, 0.5),
}


def effect_label(value: Column, measure: str = "cohens_d", scale: str = "negligible") -> Column:
    """Effect-size word. On ``scale="plain"`` the first limit above the value names it and there is no "negligible"."""
    a = F.abs(value)
    low, mid, high = EFFECT_LIMITS[measure]
    if scale == "plain":
        return F.when(a < low, "small").when(a < mid, "medium").otherwise("large")
    return F.when(a < low, "negligible").when(a < mid, "small").when(a < high, "medium").otherwise("large")


def _report(df: DataFrame, kind: str, statistic, p, effect, measure: str | None, alpha: float, *more) -> DataFrame:
    out = df.withColumn("_stat", statistic).withColumn("_p", p).withColumn("_eff", effect)
    return out.select(
        F.lit(kind).alias("test_type"), F.round("_stat", 4).alias("statistic"), F.round("_p", 6).alias("p_value"),
        F.round("_eff", 4).alias("effect_size"),
        (effect_label(F.col("_eff"), measure, "plain") if measure else F.lit("N/A")).alias("effect_interpretation"),
        (F.col("_p") < alpha).alias("is_significant"), *more,
    )


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
    )


def _two_groups(groups: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """The first and second group (by label) side by side; no row unless there are exactly two."""
    s = F.struct(*fields)
    return groups.agg(
        F.count(F.lit(1)).alias("k"), F.min_by(s, group).alias("a"), F.max_by(s, group).alias("b"),
    ).where("k = 2")


def welch_parts(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """t and its degrees of freedom from two groups' counts, means and variances; null if neither group varies."""
    e1, e2 = v1 / n1, v2 / n2
    return F.try_divide(m1 - m2, F.sqrt(e1 + e2)), F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1))


def welch_ttest(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    two = _two_groups(group_moments(df, value, group), group, ["n", "mean", "var"])
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    t, dof = welch_parts(a("n"), a("mean"), a("var"), b("n"), b("mean"), b("var"))
    sd = F.sqrt((a("var") + b("var")) / 2)
    d = F.when(sd > 0, (a("mean") - b("mean")) / sd).otherwise(0.0)
    return _report(two.withColumn("_t", t).withColumn("_dof", dof), "ttest", F.col("_t"),
                   t_two_sided("_t", "_dof"), d, "cohens_d", alpha,
                   a("n").cast("bigint").alias("n_first"), b("n").cast("bigint").alias("n_second"))


def paired_ttest(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    diff = F.col(a) - F.col(b)
    m = df.agg(F.count(diff).cast("double").alias("n"), F.avg(diff).alias("m"), F.stddev_samp(diff).alias("s"))
    m = m.withColumn("_t", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n"))).withColumn("_dof", F.col("n") - 1)
    return _report(m, "paired_ttest", F.col("_t"), t_two_sided("_t", "_dof"),
                   F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0), "cohens_d", alpha,
                   F.col("n").cast("bigint").alias("n"))


def _f_parts(groups: DataFrame, grand: Column) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - grand, F.lit(2))).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    ).withColumn("_d1", F.col("k") - 1).withColumn("_d2", F.col("n") - F.col("k")).withColumn(
        "_f", (F.col("between") / F.col("_d1")) / (F.col("within") / F.col("_d2"))
    )


def anova(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    rows = df.where(F.col(group).isNotNull())
    parts = _f_parts(group_moments(rows, value, group), rows.agg(F.avg(value)).scalar())
    eta = F.col("between") / (F.col("between") + F.col("within"))
    return _report(parts, "anova", F.col("_f"), f_sf("_f", "_d1", "_d2"), eta, "eta_squared", alpha,
                   F.col("k").cast("bigint").alias("groups"), F.col("n").cast("bigint").alias("n"))


def levene(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Median-centred Levene test: an analysis of variance of distances from the group median."""
    rows = df.select(value, group).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    med = grouped_quantiles(rows, [group], value, {"med": 0.5}).drop("n")
    dist = rows.join(med, group).select(group, F.abs(F.col(value) - F.col("med")).alias("z"))
    parts = _f_parts(group_moments(dist, "z", group), dist.agg(F.avg("z")).scalar())
    return _report(parts, "levene", F.col("_f"), f_sf("_f", "_d1", "_d2"), F.lit(0.0), None, alpha,
                   (F.col("n")).cast("bigint").alias("n"))


def _ranked_groups(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Per group: count and rank sum; and one row with the total count and the tie sum of t^3 - t.

    Rows are counted per (value, group) first, so neither a frequent value nor a frequent group gathers rows.
    """
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(value, group).agg(
        F.count(F.lit(1)).alias("n")
    )
    values = cells.groupBy(value).agg(F.sum("n").alias("n"))
    ranks = average_ranks(values, [], value)
    sums = cells.join(ranks.select(value, "rank"), value).groupBy(group).agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r")
    )
    n = F.col("n").cast("double")
    ties = values.agg(F.sum(n).alias("total"), F.sum(n * n * n - n).alias("ties"))
    return sums, ties


def mann_whitney(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Two-sided test with tie correction and continuity correction."""
    sums, ties = _ranked_groups(df, value, group)
    two = _two_groups(sums, group, ["n", "r"]).withColumn("ties", ties.select("ties").scalar())
    n1, n2 = F.col("a.n"), F.col("b.n")
    n = n1 + n2
    u = F.col("a.r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    r = F.abs((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n + 1) / 12)) / F.sqrt(n)
    return _report(two.withColumn("_z", z), "mannwhitney", u, F.least(normal_two_sided(F.greatest("_z", F.lit(0.0))), F.lit(1.0)),
                   r, "r", alpha, n.cast("bigint").alias("n"))


def kruskal(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    sums, ties = _ranked_groups(df, value, group)
    s = sums.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"),
    ).withColumn("ties", ties.select("ties").scalar())
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    s = s.withColumn("_h", h).withColumn("_dof", F.col("k") - 1)
    return _report(s, "kruskal", F.col("_h"), chi2_sf("_h", "_dof"), F.col("_h") / (n - 1), "eta_squared", alpha,
                   F.col("k").cast("bigint").alias("groups"), n.cast("bigint").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))


def chi_square_parts(cells: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """chi2 (Yates-corrected for 2x2), degrees of freedom, Cramer's V and n from contingency cells, per key."""
    o = F.col("o").cast("double")
    ra = cells.groupBy(*keys, a).agg(F.sum(o).alias("_r"))
    cb = cells.groupBy(*keys, b).agg(F.sum(o).alias("_c"))
    joined = cells.join(ra, [*keys, a]).join(cb, [*keys, b])
    main = joined.groupBy(*keys).agg(F.sum(o).alias("n"), F.sum(o * o / (F.col("_r") * F.col("_c"))).alias("_q"))
    dev = joined.groupBy(*keys).agg(F.first(F.struct(o.alias("o"), "_r", "_c")).alias("_one"))
    rows = ra.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum(1 / F.col("_r")).alias("_ir"))
    cols = cb.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("cols"), F.sum(1 / F.col("_c")).alias("_ic"))
    if keys:
        out = main.join(dev, list(keys)).join(rows, list(keys)).join(cols, list(keys))
    else:
        out = main.select(
            "*", dev.select("_one").scalar().alias("_one"),
            rows.select(F.struct("rows", "_ir")).scalar().alias("_rr"), cols.select(F.struct("cols", "_ic")).scalar().alias("_cc"),
        ).select("*", "_rr.*", "_cc.*")
    n = F.col("n")
    gap = F.abs(F.col("_one.o") - F.col("_one._r") * F.col("_one._c") / n)
    left = gap - F.least(F.lit(0.5), gap)
    yates = left * left * n * F.col("_ir") * F.col("_ic")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    out = out.withColumn("dof", dof).withColumn("chi2", F.when(dof == 1, yates).otherwise(n * (F.col("_q") - 1)))
    k = F.least("rows", "cols") - 1
    return out.withColumn("v", F.when(n * k > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (n * k))).otherwise(0.0)).select(
        *keys, "n", "rows", "cols", "dof", "chi2", "v"
    )


def chi_square(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    parts = chi_square_parts(contingency(df, a, b), a, b)
    return _report(parts, "chi_square", F.col("chi2"), chi2_sf("chi2", "dof"), F.col("v"), "cramers_v", alpha,
                   F.col("dof").cast("bigint").alias("degrees_of_freedom"), F.col("n").cast("bigint").alias("n"))


def normality(df: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """D'Agostino K2 over all rows."""
    m = df.agg(F.count(value).alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    m = m.withColumn("_k", k_squared(F.col("n"), F.col("g1"), F.col("g2"))).withColumn("_p0", chi2_sf_2df(F.col("_k")))
    return _report(m, "normality", F.col("_k"), F.col("_p0"), F.lit(0.0), None, alpha,
                   (F.col("_p0") >= alpha).alias("is_normal"), "n")


TESTS = {
    "ttest": welch_ttest, "paired_ttest": paired_ttest, "anova": anova, "mannwhitney": mann_whitney,
    "kruskal": kruskal, "chi_square": chi_square, "levene": levene,
}


def run_test(df: DataFrame, kind: str, a: str, b: str | None = None, alpha: float = 0.05) -> DataFrame:
    """One result row of the named test over columns ``a`` and ``b`` (a group or a second measure)."""
    for c in (a, b):
        if c is not None and c not in df.columns:
            raise ValueError(f"column {c!r} not found")
    if kind == "normality":
        return normality(df, a, alpha)
    if kind not in TESTS:
        raise ValueError(f"unknown test {kind!r}; valid: {', '.join([*TESTS, 'normality'])}")
    if b is None:
        raise ValueError(f"{kind} needs a second column")
    return TESTS[kind](df, a, b, alpha)


def benjamini_hochberg(df: DataFrame, p: str, keys: tuple[str, ...] = (), out: str = "adj_p", few_rows: bool = False) -> DataFrame:
    """Adjusted p-values within the keys, for any number of tests. Rows with a null p-value or key are no tests: null.

    Ranks and the running minimum from the largest p-value down are found in blocks. ``few_rows`` says that the rows are
    pairs of columns or of a top-k, so that one ordered window is enough.
    """
    if few_rows:
        by = Window.partitionBy(*(list(keys) or [F.lit(1)]))
        ranked = df.withColumn("_rk", F.row_number().over(by.orderBy(F.asc_nulls_last(p)))).withColumn("_m", F.count(p).over(by))
        up = by.orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0)
        low = F.least(F.min(F.col(p) * F.col("_m") / F.col("_rk")).over(up), F.lit(1.0))
        return ranked.withColumn(out, F.when(F.col(p).isNotNull(), low)).drop("_rk", "_m")
    rows, keys = settle(df), list(keys)  # the p-values are met again as join keys
    counts = value_counts(rows, keys, p)
    placed = running_before(counts, keys, p, before="_before", total="_m").withColumn("_q", F.col(p) * F.col("_m") / (F.col("_before") + F.col("n")))
    low = running(with_position(placed, keys, p, descending=True, pos="_pos"), keys, "_q", "min", "_low", pos="_pos")
    low = low.select(*keys, p, F.least("_low", F.lit(1.0)).alias(out))
    return rows.join(low, [*keys, p], "left").select(*df.columns, out)
