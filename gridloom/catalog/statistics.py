"""Queries of the statistical part: tests, correlations, detectors, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import sqltails as tail
from gridloom.catalog.base import query
from gridloom.operators import column_pairs as cp, correlation as cor, detectors as det, hypothesis as hyp, outliers as out

_LABEL = {  # fixed limits of the plain effect words
    "cohens_d": (0.2, 0.5), "cramers_v": (0.1, 0.3), "eta_squared": (0.01, 0.06), "r": (0.1, 0.3)}


def _report(kind, stat, p, eff, measure, more, frm):
    lab = "'N/A'" if measure is None else (
        f"CASE WHEN abs(eff) < {_LABEL[measure][0]} THEN 'small' WHEN abs(eff) < {_LABEL[measure][1]} THEN 'medium' ELSE 'large' END")
    return f"""
WITH x AS ({frm}), y AS (SELECT *, ({stat})::DOUBLE AS stat, ({p})::DOUBLE AS p, ({eff})::DOUBLE AS eff FROM x)
SELECT '{kind}' AS test_type, round(stat, 4) AS statistic, round(p, 6) AS p_value, round(eff, 4) AS effect_size,
       {lab} AS effect_interpretation, p < 0.05 AS is_significant, {more} FROM y"""


_TWO = """
SELECT a.*, b.*, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
  pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof FROM
 (SELECT count(*) AS n1, avg(v) AS m1, var_samp(v) AS v1 FROM d WHERE g = (SELECT min(g) FROM d)) a,
 (SELECT count(*) AS n2, avg(v) AS m2, var_samp(v) AS v2 FROM d WHERE g = (SELECT max(g) FROM d)) b"""


def _src(value, group, table, where="true"):
    return f"(SELECT {value} AS v, {group} AS g FROM {table} WHERE {where})"


@query("test_ttest", "STA-01", _report(
    "ttest", "t", tail.t_two_sided("t", "dof"), "(m1 - m2) / sqrt((v1 + v2) / 2)", "cohens_d", "n1 AS n_first, n2 AS n_second",
    f"WITH d AS {_src('n_chars::DOUBLE', 'toxic', 'documents JOIN labels USING (doc_id)')} {_TWO}"))
def _(t):
    return hyp.run_test(t.documents.join(t.labels, "doc_id"), "ttest", "n_chars", "toxic")


@query("test_paired_ttest", "STA-02", _report(
    "paired_ttest", "m / (s / sqrt(n))", tail.t_two_sided("m / (s / sqrt(n))", "n - 1"), "m / s", "cohens_d", "n",
    "SELECT count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s FROM lineitem"))
def _(t):
    return hyp.run_test(t.lineitem, "paired_ttest", "l_discount", "l_tax")


_F = """
SELECT count(*) AS k, sum(n) AS n, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f,
  sum(n * pow(m - gm, 2)) / (sum(n * pow(m - gm, 2)) + sum((n - 1) * v)) AS eta
FROM (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM d GROUP BY g), (SELECT avg(v) AS gm FROM d)"""


@query("test_anova", "STA-03", _report(
    "anova", "f", tail.f_sf("f", "k - 1", "n - k"), "eta", "eta_squared", "k AS groups, n::BIGINT AS n",
    f"WITH d AS {_src('o_totalprice', 'o_orderpriority', 'orders')} {_F}"))
def _(t):
    return hyp.run_test(t.orders, "anova", "o_totalprice", "o_orderpriority")


@query("test_levene", "STA-08", _report(
    "levene", "f", tail.f_sf("f", "k - 1", "n - k"), "0.0", None, "n::BIGINT AS n",
    f"""WITH s AS {_src('value', 'event_type', 'events')}, md AS (SELECT g, median(v) AS med FROM s GROUP BY g),
        d AS (SELECT g, abs(v - med) AS v FROM s JOIN md USING (g)) {_F}"""))
def _(t):
    return hyp.run_test(t.events, "levene", "value", "event_type")


_RANKS = """
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM d),
tie AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY v))"""


@query("test_mannwhitney", "STA-04", _report(
    "mannwhitney", "u", f"least({tail.normal_two_sided('greatest(z, 0)')}, 1)",
    "abs((u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)) / sqrt(n1 + n2)", "r", "(n1 + n2)::BIGINT AS n",
    f"""WITH d AS {_src('l_quantity', 'l_linestatus', 'lineitem')}, {_RANKS},
  q AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM
   (SELECT count(*)::DOUBLE AS n1, sum(r) AS r1 FROM r WHERE g = (SELECT min(g) FROM d)),
   (SELECT count(*)::DOUBLE AS n2 FROM r WHERE g = (SELECT max(g) FROM d)), tie)
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
            / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM q"""))
def _(t):
    return hyp.run_test(t.lineitem, "mannwhitney", "l_quantity", "l_linestatus")


@query("test_kruskal", "STA-05", _report(
    "kruskal", "h", tail.chi2_sf("h", "k - 1"), "h / (n - 1)", "eta_squared", "k AS groups, n::BIGINT AS n",
    f"""WITH d AS {_src('l_discount', 'l_returnflag', 'lineitem')}, {_RANKS},
  s AS (SELECT count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q FROM (SELECT count(*)::DOUBLE AS n, sum(r) AS rs FROM r GROUP BY g))
  SELECT k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s, tie"""))
def _(t):
    return hyp.run_test(t.lineitem, "kruskal", "l_discount", "l_returnflag")


def _chi(a, b, table):
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {table} GROUP BY 1, 2),
  r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
  e AS (SELECT r * k / n AS e, coalesce(o, 0) AS o FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (a, b)),
  m AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk, any_value(n) AS n FROM n)
  SELECT *, (nr - 1) * (nk - 1) AS dof, CASE WHEN (nr - 1) * (nk - 1) = 1
     THEN (SELECT sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) FROM e) ELSE (SELECT sum(pow(o - e, 2) / e) FROM e) END AS chi2 FROM m"""


for _n, _a, _b in [("test_chi_square", "event_type", "user_id"), ("test_chi_square_2x2", "quality", "toxic")]:
    _tab = "events" if _a == "event_type" else "labels"
    query(_n, "STA-06", _report(
        "chi_square", "chi2", tail.chi2_sf("chi2", "dof"), "sqrt(chi2 / (n * (least(nr, nk) - 1)))", "cramers_v",
        "dof AS degrees_of_freedom, n::BIGINT AS n", _chi(_a, _b, _tab)))(
        lambda t, a=_a, b=_b, tab=_tab: hyp.run_test(getattr(t, tab), "chi_square", a, b))


_K2 = """
SELECT *, n, pow(delta * ln(y / alpha + sqrt(pow(y / alpha, 2) + 1)), 2) + pow(((1 - 2 / (9 * a))
   - sign(term) * pow(abs(term), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) AS k2 FROM (
 SELECT *, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS term, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha FROM (
  SELECT *, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a, -1 + sqrt(2 * (beta2 - 1)) AS w2 FROM (
   SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
    (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt
   FROM ({moments})))) """
_MOM = """SELECT count(*)::DOUBLE AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS g1, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS g2
  FROM (SELECT {v} AS v, avg({v}) OVER () AS m FROM {t})"""


@query("test_normality", "STA-07 PRF-04", f"""
SELECT 'normality' AS test_type, round(k2, 4) AS statistic, round(exp(-k2 / 2), 6) AS p_value, 0.0::DOUBLE AS effect_size,
  'N/A' AS effect_interpretation, exp(-k2 / 2) < 0.05 AS is_significant, exp(-k2 / 2) >= 0.05 AS is_normal, n::BIGINT AS n
FROM ({_K2.format(moments=_MOM.format(v='s_acctbal', t='supplier'))})""")
def _(t):
    return hyp.run_test(t.supplier, "normality", "s_acctbal")


@query("bh_correction_by_brand", "STA-09", f"""
WITH g AS (SELECT p_brand, count(*)::DOUBLE AS n, avg(p_size) AS m, var_samp(p_size) AS v FROM part GROUP BY 1),
a AS (SELECT avg(p_size) AS gm FROM part), p AS (SELECT p_brand, {tail.t_two_sided('(m - gm) / sqrt(v / n)', 'n - 1')} AS p FROM g, a),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS c FROM p)
SELECT p_brand, round(p, 6) AS p, round(least(min(p * c / rk) OVER (ORDER BY rk DESC), 1.0), 6) AS adj_p FROM r""")
def _(t):
    g = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("p_size").alias("m"), F.var_samp("p_size").alias("v"))
    g = g.withColumn("_gm", t.part.agg(F.avg("p_size")).scalar())
    g = g.withColumn("_t", (F.col("m") - F.col("_gm")) / F.sqrt(F.col("v") / F.col("n"))).withColumn("_d", F.col("n") - 1)
    g = hyp.benjamini_hochberg(g.withColumn("p", hyp.t_two_sided("_t", "_d")), "p")
    return g.select("p_brand", F.round("p", 6).alias("p"), F.round("adj_p", 6).alias("adj_p"))


# --- correlations ------------------------------------------------------------------------------------------------------

_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RK = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rk_{c}" for c in _LI)


@query("corr_matrix_lineitem", "STA-10", f"WITH r AS (SELECT *, {_RK} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS pearson, round(corr(rk_{a}, rk_{b}), 4) AS spearman, count(*) AS n FROM r"
    for i, a in enumerate(_LI) for b in _LI[i + 1:]))
def _(t):
    return cor.pair_correlations(t.lineitem, _LI).select(
        "col_a", "col_b", F.round("pearson", 4).alias("pearson"), F.round("spearman", 4).alias("spearman"), "n")


def _candidate(c):
    cv = f"CASE WHEN abs(avg({c})) > 1e-10 THEN stddev_samp({c}) / abs(avg({c})) ELSE stddev_samp({c}) END"
    return f"""SELECT '{c}' AS "column", round(count({c}) / count(*) * least(count(DISTINCT {c}) / count(*), 1.0) * least({cv}, 10.0), 4) AS score FROM lineitem"""


@query("corr_candidates_lineitem", "STA-10", " UNION ALL ".join(_candidate(c) for c in [*_LI, "l_partkey", "l_suppkey", "l_linenumber"]))
def _(t):
    return cor.rank_numeric_candidates(t.lineitem, [*_LI, "l_partkey", "l_suppkey", "l_linenumber"], cor.MAX_NUMERIC)


def _pair_p(r, n):
    return tail.t_two_sided(f"{r} * sqrt(({n} - 2) / greatest(1 - {r} * {r}, 1e-10))", f"{n} - 2")


_BAL = """c AS (SELECT c_nationkey, count(*)::DOUBLE AS customers, avg(c_acctbal) AS balance, sum(c_acctbal) AS wealth, max(c_acctbal) AS top FROM customer GROUP BY 1)"""


def _nation_stats(t):
    return t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("customers"), F.avg("c_acctbal").alias("balance"), F.sum("c_acctbal").alias("wealth"),
        F.max("c_acctbal").alias("top"))


_TAU = """sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / 2 / sqrt(
   (count(*) FILTER (x.{a} <> y.{a}) / 2.0::DOUBLE) * (count(*) FILTER (x.{b} <> y.{b}) / 2.0::DOUBLE))"""
_NP = [("customers", "balance"), ("customers", "wealth"), ("customers", "top"), ("balance", "wealth"), ("balance", "top"), ("wealth", "top")]


@query("pair_report_small_n", "STA-11 STA-09", f"WITH {_BAL}, t AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_TAU.format(a=a, b=b)}, 4) AS primary_r FROM c x, c y" for a, b in _NP)
    + ") SELECT *, 'kendall' AS method, (SELECT count(*) FROM c) AS n FROM t")
def _(t):
    return cor.pair_report(_nation_stats(t), ["customers", "balance", "wealth", "top"]).select("col_a", "col_b", "primary_r", "method", "n")


@query("pair_report_parts", "STA-11 STA-09", f"""
WITH d AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b, p_partkey::DOUBLE AS c FROM part),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb,
  rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS rc FROM d),
s AS (SELECT abs(skewness(a)) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) > 1 AS sa,
  abs(skewness(b)) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) > 1 AS sb,
  abs(skewness(c)) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) > 1 AS sc FROM d),
p AS (
 SELECT 'p_size' AS col_a, 'p_retailprice' AS col_b, corr(a, b) AS r, corr(ra, rb) AS rho, count(*)::DOUBLE AS n, any_value(sa OR sb) AS sk FROM k, s
 UNION ALL SELECT 'p_size', 'p_partkey', corr(a, c), corr(ra, rc), count(*)::DOUBLE, any_value(sa OR sc) FROM k, s
 UNION ALL SELECT 'p_retailprice', 'p_partkey', corr(b, c), corr(rb, rc), count(*)::DOUBLE, any_value(sb OR sc) FROM k, s),
m AS (SELECT *, CASE WHEN sk THEN rho ELSE r END AS pr FROM p),
q AS (SELECT *, round(CASE WHEN abs(pr) >= 1 - 1e-10 THEN 0 ELSE {_pair_p('pr', 'n')} END, 6) AS pp FROM m),
z AS (SELECT *, row_number() OVER (ORDER BY pp) AS rk FROM q),
f AS (SELECT *, round(pr, 4) AS primary_r, least(min(pp * 3 / rk) OVER (ORDER BY rk DESC), 1) AS adj FROM z)
SELECT col_a, col_b, n::BIGINT AS n, round(r, 4) AS pearson_r, round(rho, 4) AS spearman_r, CASE WHEN sk THEN 'spearman' ELSE 'pearson' END AS method,
  primary_r, pp AS primary_p, round(adj, 6) AS adj_p, adj < 0.05 AND abs(primary_r) > 0.3 AS is_significant,
  CASE WHEN abs(primary_r) < 0.1 THEN 'Negligible' WHEN abs(primary_r) < 0.3 THEN 'Weak' WHEN abs(primary_r) < 0.5 THEN 'Moderate'
       WHEN abs(primary_r) < 0.7 THEN 'Strong' ELSE 'Very strong' END AS strength,
  CASE WHEN primary_r > 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN adj < 0.001 THEN '***' WHEN adj < 0.01 THEN '**' WHEN adj < 0.05 THEN '*' ELSE 'ns' END AS stars, 100.0::DOUBLE AS coverage_pct FROM f""")
def _(t):
    return cor.pair_report(t.part, ["p_size", "p_retailprice", "p_partkey"])


@query("partial_correlation", "STA-12", f"""
WITH {_BAL}, r AS (SELECT corr(customers, wealth) AS ab, corr(customers, balance) AS ac, corr(wealth, balance) AS bc FROM c),
p AS (SELECT round(ab, 4) AS full_r, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 4) AS partial_r FROM r)
SELECT 'customers' AS col_a, 'wealth' AS col_b, 'balance' AS control, *, round(abs(full_r) - abs(partial_r), 4) AS attenuation,
  abs(round(abs(full_r) - abs(partial_r), 4)) > 0.1 AS explains FROM p""")
def _(t):
    return cor.partial_correlation(_nation_stats(t), "customers", "wealth", "balance")


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_CP = [(a, b) for i, a in enumerate(_CATS) for b in _CATS[i + 1:]]


def _cat_sql(a, b):
    v = "sqrt(greatest(chi2, 0) / (n * (least(nr, nk) - 1)))"
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, n::BIGINT AS n, round({v}, 4) AS cramers_v, round({tail.chi2_sf('chi2', 'dof')}, 6) AS p,
  {tail.chi2_sf('chi2', 'dof')} < 0.05 AND {v} > 0.1 AS is_significant, CASE WHEN {v} < 0.1 THEN 'Negligible' ELSE 'Weak' END AS strength FROM ({_chi(a, b, 'lineitem')})"""


@query("cramers_v_pairs", "STA-13", " UNION ALL ".join(_cat_sql(a, b) for a, b in _CP))
def _(t):
    return cor.category_pairs(t.lineitem, _CATS)


@query("point_biserial_pairs", "STA-14", " UNION ALL ".join(f"""
SELECT 'l_linestatus' AS col_a, '{c}' AS col_b, n, round(r, 4) AS point_biserial_r, round({_pair_p('r', 'n')}, 6) AS p,
  {_pair_p('r', 'n')} < 0.05 AND abs(r) > 0.1 AS is_significant, CASE WHEN abs(r) < 0.1 THEN 'Negligible' ELSE 'Weak' END AS strength
FROM (SELECT count(*) AS n, corr((l_linestatus = 'O')::INT::DOUBLE, {c}) AS r FROM lineitem)""" for c in _LI))
def _(t):
    return cor.binary_numeric_pairs(t.lineitem, ["l_linestatus"], _LI)


@query("compare_two_numbers", "STA-15", f"""
WITH d AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM part),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM d),
m AS (SELECT count(*) AS n, corr(a, b) AS r, corr(ra, rb) AS rho, regr_slope(b, a) AS sl, regr_intercept(b, a) AS ic FROM k),
tau AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s, count(*) FILTER (x.a <> y.a) / 2.0::DOUBLE AS ua, count(*) FILTER (x.b <> y.b) / 2.0::DOUBLE AS ub FROM d x, d y),
ta AS (SELECT sum(c * (c - 1) * (2 * c + 5)) AS t5, sum(c * (c - 1)) AS t2, sum(c * (c - 1) * (c - 2)) AS t3 FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY a)),
tb AS (SELECT sum(c * (c - 1) * (2 * c + 5)) AS u5, sum(c * (c - 1)) AS u2, sum(c * (c - 1) * (c - 2)) AS u3 FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY b)),
kz AS (SELECT s / sqrt(ua * ub) AS tau, s / sqrt((n * (n - 1.0::DOUBLE) * (2 * n + 5) - t5 - u5) / 18 + t2 * u2 / (2.0::DOUBLE * n * (n - 1)) + t3 * u3 / (9.0::DOUBLE * n * (n - 1) * (n - 2))) AS z FROM tau, ta, tb, m),
sp AS (SELECT least(min(a), min(b)) AS lo, greatest(max(a), max(b)) AS hi FROM d),
h AS (SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb
      FROM (SELECT a AS v, 'a' AS s FROM d UNION ALL SELECT b, 'b' FROM d), sp GROUP BY 1)
SELECT n, round(r, 4) AS pearson_r, round({_pair_p('r', 'n')}, 6) AS pearson_p, round(rho, 4) AS spearman_r, round({_pair_p('rho', 'n')}, 6) AS spearman_p,
  round(r * r, 4) AS r_squared, round(tau, 4) AS kendall_tau, round({tail.normal_two_sided('z')}, 6) AS kendall_p,
  (SELECT round(sum(least(na, nb)) / (SELECT count(*) FROM d), 4) FROM h) AS distribution_overlap, round(sl, 4) AS slope, round(ic, 4) AS intercept,
  CASE WHEN greatest(abs(r), abs(rho)) > 0.7 THEN 'strong' WHEN greatest(abs(r), abs(rho)) > 0.4 THEN 'moderate' ELSE 'weak' END AS effect_size
FROM m, kz""")
def _(t):
    return cp.compare_pair(t.part, "p_size", "p_retailprice")["result"]


@query("regression_residual_flags", "STA-15 CHT-04", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
r AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice AS y, l_extendedprice - a - b * l_quantity AS e FROM lineitem, f)
SELECT l_orderkey, x, y, round(e, 4) AS residual, abs(e) > 2 * (SELECT stddev_pop(e) FROM r) AS is_anomaly FROM r""")
def _(t):
    return cor.residual_flags(t.lineitem, "l_orderkey", "l_quantity", "l_extendedprice")


_TOPB = """top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
d AS (SELECT p_brand AS g, p_retailprice AS v FROM part WHERE p_brand IN (FROM top))"""


@query("compare_number_by_group_boxes", "STA-16 CHT-05", f"""WITH {_TOPB}
SELECT g AS category, count(*) AS count, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std,
  round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3 FROM d GROUP BY 1""")
def _(t):
    return cp.box_stats(t.part, "p_retailprice", "p_brand")


@query("compare_number_by_group_test", "STA-16", f"""WITH {_TOPB}, x AS ({_F})
SELECT 'anova' AS test_used, k AS groups, round({tail.f_sf('f', 'k - 1', 'n - k')}, 6) AS p_value, round(eta, 4) AS effect_size,
 CASE WHEN eta > 0.14 THEN 'large' WHEN eta > 0.06 THEN 'medium' ELSE 'small' END AS effect_label, {tail.f_sf('f', 'k - 1', 'n - k')} < 0.05 AS is_significant FROM x""")
def _(t):
    return cp.compare_pair(t.part, "p_brand", "p_retailprice")["result"]


@query("compare_number_by_group_pairs", "STA-16 STA-09", f"""WITH {_TOPB},
g AS (SELECT g, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS v FROM d GROUP BY 1),
p AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM g a JOIN g b ON a.g < b.g),
q AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof FROM p),
r AS (SELECT *, round({tail.t_two_sided('t', 'dof')}, 4) AS p FROM q), s AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS c FROM r),
z AS (SELECT *, least(min(p * c / rk) OVER (ORDER BY rk DESC), 1.0) AS ap FROM s)
SELECT group_a, group_b, p, round(abs(m1 - m2) / sqrt(((n1 - 1) * v1 * (n1 - 1) / n1 + (n2 - 1) * v2 * (n2 - 1) / n2) / (n1 + n2 - 2)), 4) AS cohens_d,
  round(ap, 6) AS adjusted_p, ap < 0.05 AS significant_adjusted FROM z""")
def _(t):
    return cp.pairwise_tests(t.part, "p_retailprice", "p_brand")


@query("compare_two_categories", "STA-17", f"""
WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), y AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
gg AS (SELECT CASE WHEN p_brand IN (FROM b) THEN p_brand ELSE '(Other)' END AS ga, CASE WHEN p_type IN (FROM y) THEN p_type ELSE '(Other)' END AS gb FROM part),
x AS ({_chi('ga', 'gb', 'gg')}), z AS (SELECT *, sqrt(chi2 / (n * (least(nr, nk) - 1))) AS v FROM x)
SELECT n::BIGINT AS n, round({tail.chi2_sf('chi2', 'dof')}, 6) AS chi2_p, round(v, 4) AS cramers_v,
 CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'weak' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS cramers_label,
 {tail.chi2_sf('chi2', 'dof')} < 0.05 AS is_significant FROM z""")
def _(t):
    return cp.compare_pair(t.part, "p_brand", "p_type")["result"]


@query("compare_pair_sample_loss", "STA-18", """
SELECT count(*) AS n_total, count(toxic) AS n_used, count(*) - count(toxic) AS n_dropped, round((count(*) - count(toxic)) / count(*) * 100, 1) AS pct_dropped
FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    return cp.compare_pair(t.documents.join(t.labels, "doc_id", "left"), "lang", "toxic")["sample_loss"]


@query("correlation_findings_orders", "STA-19", f"""
WITH o AS (SELECT o_custkey, count(*)::DOUBLE AS orders, sum(o_totalprice) AS spend, max(o_totalprice) AS biggest, min(o_totalprice) AS smallest FROM orders GROUP BY 1),
u AS (UNPIVOT o ON orders, spend, biggest, smallest INTO NAME name VALUE v),
r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY v) + (count(*) OVER (PARTITION BY name, v) - 1) / 2.0::DOUBLE AS rk FROM u),
mm AS (SELECT name, count(*)::DOUBLE AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS g1, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS g2
  FROM (SELECT *, avg(v) OVER (PARTITION BY name) AS m FROM u) GROUP BY name),
nk AS (SELECT name, exp(-k2 / 2) > 0.05 AS normal FROM ({_K2.format(moments='SELECT * FROM mm')})),
ord AS (SELECT * FROM (VALUES ('orders', 1), ('spend', 2), ('biggest', 3), ('smallest', 4)) v(name, i)),
p AS (SELECT a.name AS col_a, b.name AS col_b, corr(a.v, b.v) AS r, corr(a.rk, b.rk) AS rho, count(*) AS n FROM r a JOIN r b USING (o_custkey)
      JOIN ord oa ON oa.name = a.name JOIN ord ob ON ob.name = b.name WHERE oa.i < ob.i GROUP BY 1, 2),
m AS (SELECT col_a, col_b, n, CASE WHEN na.normal AND nb.normal THEN 'Pearson' ELSE 'Spearman' END AS method,
             CASE WHEN na.normal AND nb.normal THEN r ELSE rho END AS r FROM p JOIN nk na ON na.name = col_a JOIN nk nb ON nb.name = col_b),
q AS (SELECT *, {_pair_p('r', 'n')} AS p FROM m WHERE abs(r) > 0.3),
z AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS c FROM q),
w AS (SELECT *, least(min(p * c / rk) OVER (ORDER BY rk DESC), 1.0) AS ap FROM z)
SELECT col_a, col_b, method, round(r, 4) AS r, n, round(ap, 6) AS adj_p, CASE WHEN abs(r) > 0.7 THEN 'high' ELSE 'medium' END AS severity,
  round(abs(r) * 100, 1) AS confidence, CASE WHEN abs(r) > 0.9 THEN 'very strongly' WHEN abs(r) > 0.7 THEN 'strongly' WHEN abs(r) > 0.5 THEN 'moderately'
  ELSE 'weakly' END AS strength FROM w WHERE ap < 0.05""")
def _(t):
    o = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("spend"), F.max("o_totalprice").alias("biggest"),
        F.min("o_totalprice").alias("smallest"))
    return cor.correlation_findings(o, ["orders", "spend", "biggest", "smallest"])


# --- detectors -----------------------------------------------------------------------------------------------------------

_DOCS = """d AS (SELECT lang, source, n_chars::DOUBLE AS n_chars, length(regexp_replace(text, '[^.]', '', 'g'))::DOUBLE AS dots,
  toxic::VARCHAR AS label FROM documents LEFT JOIN labels USING (doc_id))"""


def _docs(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^.]", "")).cast("double").alias("dots"), F.col("toxic").cast("string").alias("label"))


def _gap_sql(c, n):
    return f"""SELECT '{c}' AS cat_col, '{n}' AS num_col, {c} AS g, count({n})::DOUBLE AS n, avg({n}) AS m, var_samp({n}) AS v FROM d WHERE {c} IS NOT NULL GROUP BY {c}"""


@query("segment_gaps_documents", "STA-20", f"WITH {_DOCS}, g AS ("
       + " UNION ALL ".join(_gap_sql(c, n) for c in ("lang", "source", "label") for n in ("n_chars", "dots")) + f"""),
b AS (SELECT cat_col, num_col, count(*) AS k, arg_max(struct_pack(g := g, n := n, m := m, v := v), (m, g)) AS hi,
             arg_min(struct_pack(g := g, n := n, m := m, v := v), (m, g)) AS lo FROM g WHERE n >= 30 GROUP BY 1, 2),
p AS (SELECT cat_col, num_col, hi.g AS best, lo.g AS worst, hi.n AS n1, hi.m AS m1, hi.v AS v1, lo.n AS n2, lo.m AS m2, lo.v AS v2, hi.m / lo.m AS ratio
      FROM b WHERE k >= 2 AND lo.m <> 0 AND hi.m / lo.m > 1.5),
q AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof,
  (m1 - m2) / sqrt(((n1 - 1) * v1 * (n1 - 1) / n1 + (n2 - 1) * v2 * (n2 - 1) / n2) / (n1 + n2 - 2)) AS d FROM p),
r AS (SELECT *, {tail.t_two_sided('t', 'dof')} AS pv FROM q)
SELECT cat_col, num_col, best, worst, round(ratio, 4) AS ratio, round(d, 4) AS cohens_d, round(pv, 6) AS p_value,
  CASE WHEN ratio > 3 AND abs(d) >= 0.5 THEN 'high' ELSE 'medium' END AS severity, round(least(95, 55 + ratio * 4), 1) AS confidence,
  CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' ELSE 'small' END AS effect FROM r WHERE pv < 0.05""")
def _(t):
    return det.segment_gaps(_docs(t), ["lang", "source", "label"], ["n_chars", "dots"])


@query("binary_rate_gap_labels", "STA-21", """
WITH d AS (SELECT lang, source, quality::VARCHAR AS label, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS size FROM documents JOIN labels USING (doc_id)),
pos AS (SELECT label AS p FROM d GROUP BY 1 ORDER BY count(*), 1 LIMIT 1),
u AS (SELECT 'lang' AS cat_col, lang AS g, label FROM d UNION ALL SELECT 'source', source, label FROM d UNION ALL SELECT 'size', size, label FROM d),
r AS (SELECT cat_col, g, count(*) AS n, avg((label = p)::INT) AS rate FROM u, pos GROUP BY 1, 2 HAVING count(*) >= 20),
b AS (SELECT cat_col, count(*) AS groups, min(n) AS support, arg_max(g, (rate, g)) AS best, arg_min(g, (rate, g)) AS worst, max(rate) - min(rate) AS gap,
             least(max(rate) / greatest(min(rate), 0.01), 99) AS ratio FROM r GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT cat_col, g, label, count(*)::DOUBLE AS o FROM u JOIN r USING (cat_col, g) GROUP BY ALL),
e AS (SELECT *, sum(o) OVER (PARTITION BY cat_col, g) AS rr, sum(o) OVER (PARTITION BY cat_col, label) AS cc, sum(o) OVER (PARTITION BY cat_col) AS nn FROM c),
x0 AS (SELECT cat_col, count(DISTINCT g) AS k, any_value(nn) AS nn, sum(o * o / (rr * cc)) AS q, any_value(abs(o - rr * cc / nn)) AS gap0 FROM e GROUP BY 1),
iv AS (SELECT cat_col, sum(1 / rr) AS ir FROM (SELECT DISTINCT cat_col, g, rr FROM e) GROUP BY 1),
ic AS (SELECT cat_col, sum(1 / cc) AS ic FROM (SELECT DISTINCT cat_col, label, cc FROM e) GROUP BY 1),
x AS (SELECT cat_col, CASE WHEN k = 2 THEN pow(gap0 - least(0.5, gap0), 2) * nn * ir * ic ELSE nn * (q - 1) END AS chi2 FROM x0 JOIN iv USING (cat_col) JOIN ic USING (cat_col))
SELECT 'label' AS target, cat_col, best, worst, round(gap, 4) AS gap, round(ratio, 4) AS ratio, round(chi2, 2) AS chi2, groups,
  CASE WHEN gap >= 0.25 OR ratio >= 5 THEN 'high' ELSE 'medium' END AS severity,
  round(least(95, 45 + gap * 160 + least(ratio, 10) * 2 + least(1.0, support / 200) * 8), 1) AS confidence, true AS is_target_driver
FROM b JOIN x USING (cat_col) WHERE gap >= 0.10 OR ratio > 1.5""")
def _(t):
    d = t.documents.join(t.labels, "doc_id").select(
        "lang", "source", F.col("quality").cast("string").alias("label"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("size"))
    return det.binary_rate_gaps(d, ["label"], ["lang", "source", "size"])


def _uni_sql(c, table):
    return f"""SELECT '{c}' AS "column", sum((v < lo OR v > hi)::INT)::BIGINT AS outliers, count(*) AS n, any_value(sk) AS sk FROM (
  SELECT v, sk, CASE WHEN sk THEN q1 - 3 * (q3 - q1) ELSE m - 3 * sp END AS lo, CASE WHEN sk THEN q3 + 3 * (q3 - q1) ELSE m + 3 * sp END AS hi
  FROM (SELECT {c} AS v FROM {table}), (SELECT abs(skewness({c})) > 1.5 AS sk, avg({c}) AS m, stddev_pop({c}) AS sp, quantile_cont({c}, 0.25) AS q1,
        quantile_cont({c}, 0.75) AS q3 FROM {table}))"""


@query("univariate_anomalies_events", "STA-22", f"""WITH u AS ({_uni_sql('value', 'events')} UNION ALL {_uni_sql('user_id', 'events')}),
p AS (SELECT *, round(outliers / n * 100, 1) AS outlier_pct FROM u WHERE outliers > 0)
SELECT "column", outliers, outlier_pct, CASE WHEN sk THEN 'iqr' ELSE 'zscore' END AS method, CASE WHEN outlier_pct > 5 THEN 'high' ELSE 'medium' END AS severity,
  round(least(97, 75 + outlier_pct * 2), 1) AS confidence FROM p""")
def _(t):
    return det.univariate_anomalies(t.events, ["value", "user_id"])


@query("skewness_findings", "STA-23", """
SELECT 'value' AS "column", round(s, 3) AS skew, CASE WHEN s > 0 THEN 'right' ELSE 'left' END AS direction, round(least(95, 60 + abs(s) * 8), 1) AS confidence
FROM (SELECT skewness(value) AS s FROM events) WHERE abs(s) > 1.5
UNION ALL SELECT 'user_id', round(s, 3), CASE WHEN s > 0 THEN 'right' ELSE 'left' END, round(least(95, 60 + abs(s) * 8), 1) FROM (SELECT skewness(user_id) AS s FROM events) WHERE abs(s) > 1.5""")
def _(t):
    return det.skewness_findings(t.events, ["value", "user_id"])


@query("quality_findings", "STA-24", """
WITH d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT count(*) AS n, count(DISTINCT text) AS ut, count(*) - count(quality) AS mq, count(*) - count(toxic) AS mt, count(DISTINCT quality) AS uq, count(DISTINCT toxic) AS u2 FROM d)
SELECT 'text' AS "column", 'high_cardinality' AS kind, 'low' AS severity, 90.0::DOUBLE AS confidence, ut AS n_unique, 0.0::DOUBLE AS missing_pct FROM s WHERE ut / n > 0.8 AND ut > 50
UNION ALL SELECT 'quality', 'missing', CASE WHEN round(mq / n * 100, 1) > 30 THEN 'high' ELSE 'medium' END, 99.0, uq, round(mq / n * 100, 1) FROM s WHERE round(mq / n * 100, 1) > 5
UNION ALL SELECT 'toxic', 'missing', CASE WHEN round(mt / n * 100, 1) > 30 THEN 'high' ELSE 'medium' END, 99.0, u2, round(mt / n * 100, 1) FROM s WHERE round(mt / n * 100, 1) > 5""")
def _(t):
    return det.quality_findings(t.documents.join(t.labels, "doc_id", "left"))


_MOD = f"""WITH d AS (SELECT lang, source, n_chars::DOUBLE AS n_chars, length(regexp_replace(text, '[^.]', '', 'g'))::DOUBLE AS dots,
  length(regexp_replace(text, '[^ ]', '', 'g'))::DOUBLE AS gaps FROM documents),
p AS (SELECT 0 AS pair, 'n_chars' AS col_a, 'dots' AS col_b UNION ALL SELECT 1, 'n_chars', 'gaps' UNION ALL SELECT 2, 'dots', 'gaps'),
l AS (SELECT 'lang' AS moderator, lang AS grp, n_chars, dots, gaps FROM d UNION ALL SELECT 'source', source, n_chars, dots, gaps FROM d),
g AS (SELECT moderator, grp, count(*) AS n, unnest([0, 1, 2]) AS pair, unnest([corr(n_chars, dots), corr(n_chars, gaps), corr(dots, gaps)]) AS r FROM l GROUP BY 1, 2),
o AS (SELECT unnest([0, 1, 2]) AS pair, unnest([corr(n_chars, dots), corr(n_chars, gaps), corr(dots, gaps)]) AS overall_r FROM d),
v AS (SELECT moderator, grp, pair, n, r, col_a, col_b, overall_r FROM g JOIN o USING (pair) JOIN p USING (pair) WHERE r IS NOT NULL AND NOT isnan(r))"""


def _moderated(t):
    d = t.documents.select("lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
                           F.length(F.regexp_replace("text", "[^.]", "")).cast("double").alias("dots"),
                           F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("gaps"))
    return det.moderated_correlations(d, ["n_chars", "dots", "gaps"], ["lang", "source"])


@query("moderated_correlations_documents", "STA-25 STA-26", f"{_MOD} SELECT moderator, grp, n, col_a, col_b, round(r, 4) AS r, round(overall_r, 4) AS overall_r FROM v")
def _(t):
    return _moderated(t).select("moderator", "grp", "n", "col_a", "col_b", F.round("r", 4).alias("r"), F.round("overall_r", 4).alias("overall_r"))


@query("interaction_effects_documents", "STA-25", f"""{_MOD},
s AS (SELECT pair FROM o WHERE abs(overall_r) > 0.25 ORDER BY abs(overall_r) DESC, pair LIMIT 3),
q AS (SELECT pair, col_a, col_b, moderator, max(r) - min(r) AS rg, arg_max(grp, (r, grp)) AS max_group, arg_min(grp, (r, grp)) AS min_group, any_value(overall_r) AS overall_r
      FROM v WHERE n >= 15 AND pair IN (FROM s) GROUP BY ALL HAVING count(*) >= 2)
SELECT col_a, col_b, moderator, round(rg, 4) AS r_range, max_group, min_group, CASE WHEN rg > 0.5 THEN 'high' ELSE 'medium' END AS severity,
  round(least(90, 60 + rg * 60), 1) AS confidence FROM q WHERE rg > 0.3 ORDER BY abs(overall_r) DESC, moderator LIMIT 3""")
def _(t):
    return det.interaction_effects(_moderated(t), pairs=3, top=3)


_SIMP = """WITH d AS (SELECT l_returnflag AS rf, l_linestatus AS ls, l_quantity AS a, l_quantity * (CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN -1 ELSE 5 END) + l_discount AS b FROM lineitem),
o AS (SELECT corr(a, b) AS overall_r FROM d), l AS (SELECT 'rf' AS moderator, rf AS g, a, b FROM d UNION ALL SELECT 'ls', ls, a, b FROM d),
g AS (SELECT moderator, g, count(*) AS n, corr(a, b) AS r FROM l GROUP BY 1, 2)
SELECT 'a' AS col_a, 'b' AS col_b, moderator, count(*) FILTER (sign(r) * sign(overall_r) < 0) AS flips, round(any_value(overall_r), 4) AS overall_r FROM g, o
WHERE n >= 10 AND abs(overall_r) >= 0.15 GROUP BY moderator HAVING count(*) FILTER (sign(r) * sign(overall_r) < 0) >= 2"""


@query("simpsons_paradox_lineitem", "STA-26", _SIMP)
def _(t):
    sign = F.when(F.col("l_returnflag") == "R", 5).otherwise(-1)
    d = t.lineitem.select(F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_quantity").alias("a"),
                          (F.col("l_quantity") * sign + F.col("l_discount")).alias("b"))
    return det.simpsons_paradox(det.moderated_correlations(d, ["a", "b"], ["rf", "ls"]))


@query("missing_patterns_orders", "STA-27", f"""
WITH d AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 300000 THEN o_custkey END AS c FROM orders),
r AS (SELECT corr((c IS NULL)::INT::DOUBLE, o_totalprice) AS r, corr((c IS NULL)::INT::DOUBLE, o_orderkey) AS r0, count(*) AS n FROM d)
SELECT 'c' AS missing_column, 'o_totalprice' AS "column", round(r, 4) AS r, round({_pair_p('r', 'n')}, 6) AS p_value FROM r WHERE abs(r) > 0.35""")
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_totalprice") < 300000, F.col("o_custkey")).alias("c"))
    return det.missing_patterns(d, ["o_orderkey", "o_totalprice", "c"])


@query("trend_findings_parts", "STA-19 WIN-13", f"""
WITH d AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS revenue, count(*)::DOUBLE AS n,
   date_diff('month', (SELECT min(o_orderdate) FROM orders), date_trunc('month', o_orderdate)) * 2.5 + avg(o_totalprice) / 1e6 AS drift FROM orders GROUP BY 1),
x AS (SELECT *, date_diff('day', (SELECT min(m) FROM d), m)::DOUBLE AS x FROM d),
u AS (SELECT 'drift' AS "column", drift AS v, x FROM x UNION ALL SELECT 'n', n, x FROM x UNION ALL SELECT 'revenue', revenue, x FROM x),
s AS (SELECT "column", count(*)::DOUBLE AS n, regr_slope(v, x) AS sl, corr(v, x) AS r, avg(v) AS m, max(x) - min(x) AS span FROM u GROUP BY 1),
p AS (SELECT *, {_pair_p('r', 'n')} AS p FROM s)
SELECT "column", round(sl, 6) AS slope, round(r * r, 4) AS r2, CASE WHEN sl > 0 THEN 'upward' ELSE 'downward' END AS direction,
  round(abs(sl) * span / greatest(abs(m), 1e-10) * 100, 1) AS pct_change, CASE WHEN r * r > 0.5 THEN 'high' ELSE 'medium' END AS severity,
  round(least(97, r * r * 100), 1) AS confidence FROM p WHERE p < 0.05 AND r * r >= 0.15""")
def _(t):
    first = t.orders.agg(F.min("o_orderdate")).scalar()
    month = F.date_trunc("month", "o_orderdate")
    d = t.orders.withColumn("_f", first).groupBy(month.cast("timestamp_ntz").alias("m"), "_f").agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("a"))
    months = (F.year("m") - F.year("_f")) * 12 + F.month("m") - F.month("_f")
    d = d.withColumn("drift", months * 2.5 + F.col("a") / 1e6)
    return det.trend_findings(d.select("m", "drift", "n", "revenue"), "m", ["drift", "n", "revenue"])


@query("leading_indicator_lags", "WIN-14", """
WITH s AS (SELECT l_shipdate AS d, sum(l_quantity) AS q, count(*)::DOUBLE AS n, avg(l_tax) AS x FROM lineitem GROUP BY 1),
l AS (SELECT q, n, x, unnest([1, 2, 3, 4, 5]) AS lag, unnest([lead(n, 1) OVER w, lead(n, 2) OVER w, lead(n, 3) OVER w, lead(n, 4) OVER w, lead(n, 5) OVER w]) AS n_l,
  unnest([lead(x, 1) OVER w, lead(x, 2) OVER w, lead(x, 3) OVER w, lead(x, 4) OVER w, lead(x, 5) OVER w]) AS x_l FROM s WINDOW w AS (ORDER BY d)),
b AS (SELECT corr(q, n) AS qn, corr(q, x) AS qx, corr(n, x) AS nx FROM s)
SELECT 'q' AS col_a, 'n' AS col_b, lag, round(any_value(qn), 4) AS base_r, round(corr(q, n_l), 4) AS r FROM l, b GROUP BY lag
UNION ALL SELECT 'q', 'x', lag, round(any_value(qx), 4), round(corr(q, x_l), 4) FROM l, b GROUP BY lag
UNION ALL SELECT 'n', 'x', lag, round(any_value(nx), 4), round(corr(n, x_l), 4) FROM l, b GROUP BY lag""")
def _(t):
    s = t.lineitem.groupBy(F.col("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_tax").alias("x"))
    return det.leading_indicators(s.withColumn("id", F.col("d")), "d", "id", ["q", "n", "x"], all_lags=True).withColumn("lag", F.col("lag").cast("bigint"))


@query("vif_lineitem", "STA-28", """
WITH s AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc
  FROM (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
v AS (SELECT 'l_quantity' AS "column", aa * (bb * cc - bc * bc) / det AS v FROM d UNION ALL SELECT 'l_extendedprice', bb * (aa * cc - ac * ac) / det FROM d
      UNION ALL SELECT 'l_discount', cc * (aa * bb - ab * ab) / det FROM d)
SELECT "column", round(v, 4) AS vif, CASE WHEN v > 10 THEN 'high' WHEN v > 5 THEN 'medium' ELSE 'none' END AS severity FROM v""")
def _(t):
    return det.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


# --- outliers --------------------------------------------------------------------------------------------------------------

_OUT = """s AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS sp, skewness(value) AS sk, median(value) AS med, min(value) AS mn, max(value) AS mx,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT *, CASE WHEN abs(sk) > 1 THEN 3.5::DOUBLE ELSE 3.0 END AS zt, CASE WHEN abs(sk) > 1 THEN 3.0::DOUBLE ELSE 1.5 END AS im FROM s),
f AS (SELECT event_id, value, (value - m) / sp AS z, abs((value - m) / sp) > zt AS zf, value < q1 - im * (q3 - q1) OR value > q3 + im * (q3 - q1) AS qf,
  CASE WHEN m <> 0 THEN round((value - m) / m * 100, 1) END AS dev FROM events, b)"""


@query("outlier_explorer_value", "STA-29", f"""WITH {_OUT}
SELECT count(*) AS total, sum(zf::INT)::BIGINT AS zscore, sum(qf::INT)::BIGINT AS iqr, sum((zf OR qf)::INT)::BIGINT AS combined,
  round(sum(zf::INT) / count(*) * 100, 2) AS zscore_pct, round(sum(qf::INT) / count(*) * 100, 2) AS iqr_pct, round(sum((zf OR qf)::INT) / count(*) * 100, 2) AS combined_pct,
  (SELECT round(sk, 3) FROM b) AS skewness, (SELECT zt FROM b) AS z_threshold, (SELECT im FROM b) AS iqr_multiplier,
  (SELECT round(q1 - im * (q3 - q1), 4) FROM b) AS lower_fence, (SELECT round(q3 + im * (q3 - q1), 4) FROM b) AS upper_fence, (SELECT round(med, 4) FROM b) AS median FROM f""")
def _(t):
    return out.method_counts(t.events, "value")


@query("outlier_worst_rows", "STA-29", f"""WITH {_OUT} SELECT event_id, round(value, 4) AS value, round(z, 3) AS z_score, zf AS zscore_flag, qf AS iqr_flag, dev AS pct_deviation
FROM f WHERE zf OR qf ORDER BY abs(z) DESC, event_id LIMIT 100""")
def _(t):
    return out.worst_rows(t.events, "event_id", "value")


@query("outlier_histogram", "STA-29 CHT-02", f"""WITH {_OUT}, k AS (SELECT *, least(20, greatest(8, n // 20)) AS bins FROM b),
h AS (SELECT least(floor((value - mn) / ((mx - mn) / bins)), bins - 1)::BIGINT AS bin, count(*) AS value FROM events, k GROUP BY 1)
SELECT bin, value, round(value / n, 4) AS density, round(sum(value) OVER (ORDER BY bin) / n * 100, 1) AS cumulative_pct,
  mn + (bin + 0.5) * ((mx - mn) / bins) < q1 - im * (q3 - q1) OR mn + (bin + 0.5) * ((mx - mn) / bins) > q3 + im * (q3 - q1) AS is_outlier_bin FROM h, k""")
def _(t):
    return out.outlier_histogram(t.events, "value")
