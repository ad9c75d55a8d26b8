"""Correlations between columns: matrices, method choice, partial, rank and category measures, column pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import correlation_of, k_squared
from gridloom.functions.tails import chi2_sf, kendall_exact_p, normal_two_sided, t_two_sided
from gridloom.operators.filters import distinct_counts
from gridloom.operators.hypothesis import benjamini_hochberg, chi_square_parts
from gridloom.session import settle
from gridloom.plans.ordered import average_ranks, running_before, value_counts
from gridloom.plans.stacked import clean_number, wide_to_rows

MAX_NUMERIC, MAX_CATEGORY = 20, 10
MIN_EFFECT = 0.3


def attach_ranks(df: DataFrame, cols: Sequence[str], prefix: str = "_rk_") -> DataFrame:
    """Average ranks of each column beside the rows; ranks are found on counted distinct values and joined back."""
    out = df
    for c in cols:
        ranks = average_ranks(value_counts(df.select(c), [], c), [], c).select(c, F.col("rank").alias(f"{prefix}{c}"))
        out = out.join(ranks, c, "left")
    return out


def _p_value_inputs(r: Column, n: Column) -> tuple[Column, Column]:
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-10)))
    return t, (n - 2).cast("double")


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a < 0.1, "Negligible").when(a < 0.3, "Weak").when(a < 0.5, "Moderate").when(a < 0.7, "Strong")
        .otherwise("Very strong")
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def best_first(scored: DataFrame, limit: int | None) -> DataFrame:
    ordered = scored.orderBy(F.desc("score"), "ord")
    return ordered if limit is None else ordered.limit(limit)


def rank_numeric_candidates(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Columns by completeness x uniqueness x coefficient of variation, best first."""
    stats = wide_to_rows(df, cols, {
        "ord": lambda c: F.first(F.lit(list(cols).index(c))), "rows": lambda c: F.count(F.lit(1)), "n": lambda c: F.count(c),
        "cv": lambda c: F.when(F.abs(F.avg(c)) > 1e-10, F.stddev_samp(c) / F.abs(F.avg(c))).otherwise(F.stddev_samp(c)),
    }).join(F.broadcast(distinct_counts(df, cols)), "column", "left")
    unique = F.least(F.try_divide(F.col("n_unique"), F.col("rows")), F.lit(1.0))
    score = F.try_divide(F.col("n"), F.col("rows")) * unique * F.least("cv", F.lit(10.0))
    return best_first(stats.withColumn("score", score), limit).select("column", F.round("score", 4).alias("score"))


def _pack(rows: DataFrame, items: Sequence[Column]) -> DataFrame:
    """Rows out of one aggregate row holding an array of structs."""
    packed = rows.agg(*[s.alias(f"_{i}") for i, s in enumerate(items)])
    return packed.select(F.inline(F.array(*[f"_{i}" for i in range(len(items))])))


def _pair_ranks(df: DataFrame, cols: Sequence[str], gaps: Sequence[str]) -> DataFrame:
    """(key, value, rank): average ranks of each column's values among the rows that know a partner with nulls.

    key = column * (gaps + 1) + variant; variant 0 is all rows that know the column, variant j those that also know the j-th
    column with nulls. All columns and variants are counted in one pass by (column, value, null pattern) and ranked by one range
    shuffle of those counts.
    """
    width = len(gaps) + 1
    pattern = F.concat(F.lit(""), *[F.when(F.col(g).isNull(), "0").otherwise("1") for g in gaps])
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(gaps.index(c) + 1 if c in gaps else 0).alias("own"), F.col(c).alias("value")) for i, c in enumerate(cols)])
    counts = df.select(pattern.alias("pattern"), F.inline(cells)).where("value IS NOT NULL").groupBy("c", "own", "value", "pattern").agg(F.count(F.lit(1)).alias("n"))
    known = F.filter(F.sequence(F.lit(0), F.lit(len(gaps))), lambda j: (j == 0) | ((F.substr(F.col("pattern"), j, F.lit(1)) == "1") & (j != F.col("own"))))
    variants = settle(counts.select("c", "value", "n", F.explode(known).alias("j")).groupBy((F.col("c") * width + F.col("j")).alias("key"), "value").agg(F.sum("n").alias("n")))
    placed = running_before(variants, ["key"], "value", "n", few_keys=True)
    return settle(placed.select("key", "value", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank")))


def pair_correlations(df: DataFrame, cols: Sequence[str], derived: bool = False) -> DataFrame:
    """Pearson, Spearman, pairwise n and column skew of every pair, in upper-triangle order.

    Pearson needs one aggregate. For Spearman each pair is ranked on its own complete rows, all of them at once (see
    ``_pair_ranks``); the ranks are joined to the rows once a column, whatever the number of pairs. ``derived`` says that ``df``
    is itself costly to compute and should be kept once.
    """
    cols = list(cols)
    df = df.select(*[clean_number(c).alias(c) for c in cols])
    if derived:
        df = settle(df)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    gaps = [c for c in cols if nulls[c]]
    width, ranks = len(gaps) + 1, _pair_ranks(df, cols, gaps)
    ranked = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        mine = ranks.where(F.col("key").between(i * width, i * width + width - 1))
        wide = mine.groupBy("value").agg(*[F.max(F.when(F.col("key") == i * width + j, F.col("rank"))).alias(f"r{i}_{j}") for j in range(width)])
        ranked = ranked.join(wide, F.col(f"v{i}") == F.col("value"), "left").drop("value")
    variant = lambda c: gaps.index(c) + 1 if c in gaps else 0
    items = []
    for k, ((i, a), (j, b)) in enumerate(combinations(enumerate(cols), 2)):
        x, y = F.col(f"v{i}"), F.col(f"v{j}")
        ok = x.isNotNull() & y.isNotNull()
        items.append(F.struct(
            F.lit(k).alias("pair"), F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), correlation_of(x, y).alias("pearson"),
            correlation_of(F.when(ok, F.col(f"r{i}_{variant(b)}")), F.when(ok, F.col(f"r{j}_{variant(a)}"))).alias("spearman"),
            F.count_if(ok).alias("n"), F.count(F.lit(1)).alias("n_total"), F.abs(F.skewness(x)).alias("skew_a"), F.abs(F.skewness(y)).alias("skew_b"),
        ))
    return _pack(ranked, items)


def _kendall_terms(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exact concordance counts by bit levels of the dense code of ``x``.

    Two rows with different x share a prefix of their codes up to one bit; at that level the row with bit 1 is the
    larger one. Per (level, prefix) the rows are counted by y and a running count of bit-0 rows below each y gives
    the concordant pairs: n log n counted cells, no pair of rows is ever formed.
    """
    grid = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop().groupBy(
        "x", "y"
    ).agg(F.count(F.lit(1)).alias("n"))
    xs = grid.select("x").distinct().withColumn("one", F.lit(1))
    codes = running_before(xs, [], "x", "one").select("x", F.col("before").alias("code"))
    m = xs.count()
    levels = max(1, ceil(log2(max(m, 2))))
    cells = grid.join(codes, "x").select(
        "y", "n", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "code"
    ).select(
        "level", F.expr("shiftright(code, level + 1)").alias("prefix"), F.expr("shiftright(code, level) & 1").alias("bit"),
        "y", "n",
    ).groupBy("level", "prefix", "y").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"),
    )
    below = running_before(cells, ["level", "prefix"], "y", "n0")
    concordant = below.agg(F.coalesce(F.sum(F.col("n1").cast("double") * F.col("before")), F.lit(0.0))).scalar()

    def ties(c):
        t = F.sum("n").cast("double")
        sizes = grid.groupBy(*c).agg(t.alias("t"))
        v = F.col("t")
        return sizes.agg(F.struct(
            F.coalesce(F.sum(v * (v - 1) / 2), F.lit(0.0)).alias("pairs"),
            F.coalesce(F.sum(v * (v - 1) * (2 * v + 5)), F.lit(0.0)).alias("t5"),
            F.coalesce(F.sum(v * (v - 1) * (v - 2)), F.lit(0.0)).alias("t3"),
        )).scalar()
    return grid.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).select(
        "n", concordant.alias("c"), ties(["x"]).alias("tx"), ties(["y"]).alias("ty"), ties(["x", "y"]).alias("txy")
    )


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b over all complete rows and its normal-approximation z."""
    t = _kendall_terms(df, x, y)
    n = F.col("n")
    all_pairs = n * (n - 1) / 2
    untied = all_pairs - F.col("tx.pairs") - F.col("ty.pairs") + F.col("txy.pairs")
    s = 2 * F.col("c") - untied
    tau = s / F.sqrt((all_pairs - F.col("tx.pairs")) * (all_pairs - F.col("ty.pairs")))
    var = (
        (n * (n - 1) * (2 * n + 5) - F.col("tx.t5") - F.col("ty.t5")) / 18
        + (2 * F.col("tx.pairs")) * (2 * F.col("ty.pairs")) / (2 * n * (n - 1))
        + F.col("tx.t3") * F.col("ty.t3") / (9 * n * (n - 1) * (n - 2))
    )
    return t.select(n.cast("bigint").alias("n"), tau.alias("tau"), (s / F.sqrt(var)).alias("z"))


def small_kendall(df: DataFrame, pairs: Sequence[tuple[int, str, str]]) -> DataFrame:
    """tau-b and p of pairs whose complete rows were counted to be fewer than 30.

    The counted points of a pair meet each other on the pair's number (under 900 meetings per pair). Without ties p is
    exact, else the tie-corrected normal approximation.
    """
    pts = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, a, b in pairs
    ])).alias("s")).select("s.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    o = pts.select("pair", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    sign = F.signum(F.col("x") - F.col("x2")) * F.signum(F.col("y") - F.col("y2"))
    each = pts.join(F.broadcast(o), "pair").groupBy("pair", "x", "y", "n").agg(
        F.sum(F.col("n2") * sign).alias("s"), F.sum(F.when(F.col("x") == F.col("x2"), F.col("n2")).otherwise(0.0)).alias("tx"),
        F.sum(F.when(F.col("y") == F.col("y2"), F.col("n2")).otherwise(0.0)).alias("ty"), F.sum("n2").alias("total"))
    w = F.col("n")
    def tie(c, factor):
        t = F.col(c)
        return F.sum(w * (t - 1) * factor(t))
    g = each.groupBy("pair").agg(
        F.max("total").alias("n"), (F.sum(w * F.col("s")) / 2).alias("s"),
        tie("tx", lambda t: t * 0 + 1).alias("x2"), tie("ty", lambda t: t * 0 + 1).alias("y2"),
        tie("tx", lambda t: 2 * t + 5).alias("x5"), tie("ty", lambda t: 2 * t + 5).alias("y5"),
        tie("tx", lambda t: t - 2).alias("x3"), tie("ty", lambda t: t - 2).alias("y3"))
    n = F.col("n")
    var = ((n * (n - 1) * (2 * n + 5) - F.col("x5") - F.col("y5")) / 18 + F.col("x2") * F.col("y2") / (2 * n * (n - 1))
           + F.col("x3") * F.col("y3") / (9 * n * (n - 1) * (n - 2)))
    g = g.withColumn("tau", F.col("s") / F.sqrt((n * (n - 1) - F.col("x2")) / 2 * (n * (n - 1) - F.col("y2")) / 2))
    g = g.withColumn("_z", F.col("s") / F.sqrt(var)).withColumn("_c", (n * (n - 1) / 2 - F.col("s")) / 2)
    exact = (F.col("x2") == 0) & (F.col("y2") == 0)
    return g.withColumn("_pe", kendall_exact_p("n", "_c")).withColumn("_pn", normal_two_sided("_z")).select(
        "pair", "tau", F.when(exact, F.col("_pe")).otherwise(F.col("_pn")).alias("kendall_p"))


def pair_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pair: primary method (Kendall below 30 rows, Spearman when skewed, else Pearson), p, adjusted p, labels."""
    pairs = pair_correlations(df, cols)
    small = [(r["pair"], r["col_a"], r["col_b"]) for r in pairs.where((F.col("n") < 30) & (F.col("n") >= 5)).select(
        "pair", "col_a", "col_b").collect()]
    out = pairs.where((F.col("n") >= 5) & F.col("pearson").isNotNull())
    if small:
        out = out.join(F.broadcast(small_kendall(df, small)), "pair", "left")
    else:
        out = out.withColumn("tau", F.lit(None).cast("double")).withColumn("kendall_p", F.lit(None).cast("double"))
    skewed = (F.col("skew_a") > 1) | (F.col("skew_b") > 1)
    method = F.when(F.col("n") < 30, "kendall").when(skewed, "spearman").otherwise("pearson")
    for c in ("pearson", "spearman"):
        t, dof = _p_value_inputs(F.col(c), F.col("n"))
        out = out.withColumn("_t", t).withColumn("_dof", dof).withColumn(
            f"{c}_p", F.when(F.abs(c) >= 1 - 1e-10, 0.0).otherwise(t_two_sided("_t", "_dof"))
        )
    out = out.withColumn("method", method)
    pick = lambda k, s, p: F.when(F.col("method") == "kendall", F.col(k)).when(
        F.col("method") == "spearman", F.col(s)).otherwise(F.col(p))
    out = out.withColumn("primary_r", F.round(pick("tau", "spearman", "pearson"), 4)).withColumn(
        "primary_p", F.round(pick("kendall_p", "spearman_p", "pearson_p"), 6))
    out = benjamini_hochberg(out, "primary_p", few_rows=True)
    return out.select(
        "col_a", "col_b", "n", F.round("pearson", 4).alias("pearson_r"), F.round("spearman", 4).alias("spearman_r"),
        "method", "primary_r", "primary_p", F.round("adj_p", 6).alias("adj_p"),
        ((F.col("adj_p") < 0.05) & (F.abs("primary_r") > MIN_EFFECT)).alias("is_significant"),
        strength_label(F.col("primary_r")).alias("strength"),
        F.when(F.col("primary_r") > 0, "positive").otherwise("negative").alias("direction"), stars(F.col("adj_p")).alias("stars"),
        F.round(F.col("n") / F.greatest("n_total", F.lit(1)) * 100, 1).alias("coverage_pct"),
    )


def partial_correlation(df: DataFrame, a: str, b: str, control: str) -> DataFrame:
    """Pearson r of ``a`` and ``b`` with one control held fixed, from three correlations on the complete rows."""
    rows = df.select(a, b, control).na.drop()
    m = rows.agg(F.count(F.lit(1)).alias("n"), correlation_of(a, b).alias("ab"), correlation_of(a, control).alias("ac"), correlation_of(b, control).alias("bc"))
    held = (1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc"))
    part = F.when(held > 1e-12, (F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt(F.greatest(held, F.lit(0.0))))
    out = m.where("n >= 10").select(
        F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit(control).alias("control"), F.round("ab", 4).alias("full_r"),
        F.round(part, 4).alias("partial_r"),
    ).withColumn("attenuation", F.round(F.abs("full_r") - F.abs("partial_r"), 4))
    return out.withColumn("explains", F.abs("attenuation") > 0.1)


def category_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cramer's V of every pair of category columns; all contingency tables come from one shuffle."""
    pairs = list(combinations(cols, 2))
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb"))
        for a, b in pairs
    ])).alias("s")).select("s.*").where(F.col("va").isNotNull() & F.col("vb").isNotNull()).groupBy(
        "col_a", "col_b", "va", "vb").agg(F.count(F.lit(1)).alias("o"))
    parts = chi_square_parts(cells, "va", "vb", ("col_a", "col_b")).where("n >= 10")
    p = F.round(F.when((F.col("rows") >= 2) & (F.col("cols") >= 2), chi2_sf("chi2", "dof")).otherwise(1.0), 6)
    return parts.withColumn("p", p).select(
        "col_a", "col_b", F.col("n").cast("bigint").alias("n"), F.round("v", 4).alias("cramers_v"), "p",
        ((F.col("p") < 0.05) & (F.col("v") > 0.1)).alias("is_significant"), strength_label(F.col("v")).alias("strength"),
    )


def binary_numeric_pairs(df: DataFrame, binary: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """Point-biserial r of two-valued columns with numeric ones; the larger label counts as 1."""
    tops = df.agg(*[F.max(b).alias(b) for b in binary]).first()
    items = []
    for b in binary:
        flag = (F.col(b) == tops[b]).cast("double")
        for c in nums:
            both = F.col(b).isNotNull() & F.col(c).isNotNull()
            items.append(F.struct(
                F.lit(b).alias("col_a"), F.lit(c).alias("col_b"), F.count_if(both).alias("n"),
                correlation_of(flag, F.col(c)).alias("r")))
    out = _pack(df, items).where("n >= 10 AND r IS NOT NULL")
    t, dof = _p_value_inputs(F.col("r"), F.col("n"))
    out = out.withColumn("_t", t).withColumn("_dof", dof).withColumn("p", F.round(t_two_sided("_t", "_dof"), 6))
    return out.select("col_a", "col_b", "n", F.round("r", 4).alias("point_biserial_r"), "p",
                      ((F.col("p") < 0.05) & (F.abs("r") > 0.1)).alias("is_significant"), strength_label(F.col("r")).alias("strength"))


def histogram_overlap(df: DataFrame, a: str, b: str, bins: int = 50) -> DataFrame:
    """Shared area of two columns' histograms over their combined range."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).na.drop()
    span = rows.agg(F.struct(F.least(F.min("a"), F.min("b")).alias("lo"), F.greatest(F.max("a"), F.max("b")).alias("hi"))).scalar()
    long = rows.unpivot([], ["a", "b"], "side", "v").withColumn("_s", span)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_s.lo"), width)), F.lit(0)), F.lit(bins - 1))
    hist = long.groupBy(at.alias("bin")).agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return hist.agg(F.round(F.sum(F.least("na", "nb")) / F.max(total), 4).alias("overlap"))


def compare_numeric(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row of all measures of two numeric columns."""
    rows = df.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).na.drop()
    ranked = attach_ranks(rows, [a, b])
    m = ranked.agg(
        F.count(F.lit(1)).alias("n"), correlation_of(a, b).alias("r"), correlation_of(f"_rk_{a}", f"_rk_{b}").alias("rho"),
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))
    k = kendall(rows, a, b)
    out = m.select("*", k.select(F.struct("tau", "z")).scalar().alias("k"),
                   histogram_overlap(rows, a, b).scalar().alias("overlap"))
    for c, name in (("r", "pearson_p"), ("rho", "spearman_p")):
        t, dof = _p_value_inputs(F.col(c), F.col("n"))
        out = out.withColumn("_t", t).withColumn("_dof", dof).withColumn(name, t_two_sided("_t", "_dof"))
    best = F.greatest(F.abs("r"), F.abs("rho"))
    return out.withColumn("_z", F.col("k.z")).select(
        "n", F.round("r", 4).alias("pearson_r"), F.round("pearson_p", 6).alias("pearson_p"), F.round("rho", 4).alias("spearman_r"),
        F.round("spearman_p", 6).alias("spearman_p"), F.round(F.col("r") * F.col("r"), 4).alias("r_squared"),
        F.round("k.tau", 4).alias("kendall_tau"), F.round(normal_two_sided("_z"), 6).alias("kendall_p"),
        F.col("overlap").alias("distribution_overlap"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.when(best > 0.7, "strong").when(best > 0.4, "moderate").otherwise("weak").alias("effect_size"),
    )


def residual_flags(df: DataFrame, row_id: str, x: str, y: str) -> DataFrame:
    """Every row with the distance from the least-squares line and the two-sigma flag."""
    rows = df.select(row_id, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    fit = rows.agg(F.struct(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"),
                            F.sqrt(F.regr_syy("y", "x") * (1 - F.regr_r2("y", "x")) / F.count(F.lit(1))).alias("sd"))).scalar()
    out = rows.withColumn("_f", fit).withColumn("resid", F.col("y") - F.col("_f.a") - F.col("_f.b") * F.col("x"))
    return out.select(row_id, "x", "y", F.round("resid", 4).alias("residual"),
                      ((F.col("_f.sd") > 1e-10) & (F.abs("resid") > 2 * F.col("_f.sd"))).alias("is_anomaly"))


def correlation_findings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairs with |r| > 0.3 and adjusted p < 0.05; Pearson when both columns look normal, else Spearman."""
    cols = list(cols)
    df = settle(df.select(*cols))
    pairs = pair_correlations(df, cols)
    normal = _pack(df, [F.struct(F.lit(c).alias("column"), (F.exp(-k_squared(F.count(c), F.skewness(c), F.kurtosis(c)) / 2) > 0.05)
                                 .alias("normal")) for c in cols])
    na, nb = normal.withColumnRenamed("normal", "na"), normal.withColumnRenamed("normal", "nb")
    j = pairs.where("n >= 10").join(F.broadcast(na), F.col("col_a") == na["column"]).drop("column").join(
        F.broadcast(nb), F.col("col_b") == nb["column"]).drop("column")
    j = j.withColumn("method", F.when(F.col("na") & F.col("nb"), "Pearson").otherwise("Spearman"))
    j = j.withColumn("r", F.when(F.col("method") == "Pearson", F.col("pearson")).otherwise(F.col("spearman"))).where(F.abs("r") > 0.3)
    t, dof = _p_value_inputs(F.col("r"), F.col("n"))
    j = benjamini_hochberg(j.withColumn("_t", t).withColumn("_dof", dof).withColumn("p", t_two_sided("_t", "_dof")), "p", few_rows=True)
    return j.where("adj_p < 0.05").select(
        "col_a", "col_b", "method", F.round("r", 4).alias("r"), "n", F.round("adj_p", 6).alias("adj_p"),
        F.when(F.abs("r") > 0.7, "high").otherwise("medium").alias("severity"),
        F.round(F.abs("r") * 100, 1).alias("confidence"),
        F.when(F.abs("r") > 0.9, "very strongly").when(F.abs("r") > 0.7, "strongly").when(F.abs("r") > 0.5, "moderately")
        .otherwise("weakly").alias("strength"))
