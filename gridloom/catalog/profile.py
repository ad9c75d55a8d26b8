"""Queries of the profiling and health part."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import query
from gridloom.functions.patterns import DATE_SHAPES, VALUE_PATTERNS
from gridloom.operators import health, profile as pf
from gridloom.operators.filters import distinct_counts

_U = lambda parts: " UNION ALL ".join(parts)


@query("column_profile_base", "PRF-01", _U(
    f"""SELECT '{c}' AS "column", '{k}' AS type, count(*) AS rows, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct,
  count(DISTINCT {c}) AS "unique", round(count(DISTINCT {c}) / count(*) * 100, 1) AS unique_pct FROM documents LEFT JOIN labels USING (doc_id)"""
    for c, k in [("doc_id", "numeric"), ("text", "categorical"), ("lang", "categorical"), ("source", "categorical"), ("n_chars", "numeric"),
                 ("quality", "numeric"), ("toxic", "numeric")]))
def _(t):
    return pf.base_profile(t.documents.join(t.labels, "doc_id", "left"))


def _num(c, table):
    return f"""SELECT '{c}' AS "column", count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std,
  round(min(v), 4) AS min, round(max(v), 4) AS max, round(any_value(q1), 4) AS q25, round(any_value(q3), 4) AS q75, round(skewness(v), 3) AS skewness, round(kurtosis(v), 3) AS kurtosis,
  count(*) FILTER (v = 0) AS zeros, count(DISTINCT v) AS n_unique, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_iqr,
  count(*) FILTER (abs(v - m) > 3 * sp) AS outliers_zscore,
  CASE WHEN count(DISTINCT v) <= 5 AND count(v) > 20 THEN 'low' WHEN count(DISTINCT v) <= 15 AND count(v) > 50 THEN 'medium' ELSE 'high' END AS dtype_confidence
  FROM (SELECT {c}::DOUBLE AS v FROM {table}), (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, avg({c}) AS m, stddev_pop({c}) AS sp FROM {table})"""


@query("column_profile_numeric", "PRF-02 PRF-03", _U(_num(c, "lineitem") for c in ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    return pf.numeric_profile(t.lineitem, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("numeric_profile_events", "PRF-02 PRF-03", _U(_num(c, "events") for c in ["value", "user_id"]))
def _(t):
    return pf.numeric_profile(t.events, ["value", "user_id"])


def _k2(c, table):
    from gridloom.catalog.statistics import _K2, _MOM
    return f"""SELECT '{c}' AS "column", n::BIGINT AS n, round(k2, 4) AS k2, round(exp(-k2 / 2), 4) AS normality_p, exp(-k2 / 2) > 0.05 AS is_normal
FROM ({_K2.format(moments=_MOM.format(v=c, t=table))})"""


@query("normality_flags_customers", "PRF-04", _k2("c_acctbal", "customer"))
def _(t):
    return pf.normality_flags(t.customer, ["c_acctbal"])


_CDF = "0.5 * (1 + sign({z}) * (1 - ((((1.061405429 * ({t}) - 1.453152027) * ({t}) + 1.421413741) * ({t}) - 0.284496736) * ({t}) + 0.254829592) * ({t}) * exp(-pow({z}, 2) / 2)))"


def _cdf(z):
    return _CDF.format(z=f"({z})", t=f"1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2))")


def _ks(c, table):
    return f"""SELECT '{c}' AS "column", * FROM (
 WITH v AS (SELECT {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL), k AS (SELECT v, count(*) AS n FROM v GROUP BY v),
 p AS (SELECT count(*) AS size, avg(v) AS m, stddev_samp(v) AS sd, min(v) AS lo, avg(CASE WHEN v > 0 THEN ln(v) END) AS lm, stddev_samp(CASE WHEN v > 0 THEN ln(v) END) AS lsd FROM v),
 r AS (SELECT v, (sum(n) OVER (ORDER BY v) - n) / size AS f0, sum(n) OVER (ORDER BY v) / size AS f1, p.* FROM k, p),
 c AS (SELECT f0, f1, {_cdf('(v - m) / sd')} AS c1, CASE WHEN lo > 0 THEN {_cdf('(ln(v) - lm) / lsd')} END AS c2,
   CASE WHEN lo > 0 THEN 1 - pow(lo / v, 1 / (lm - ln(lo))) END AS c3, CASE WHEN lo >= 0 THEN 1 - exp(-v / m) END AS c4 FROM r),
 d AS (SELECT max(greatest(c1 - f0, f1 - c1)) AS a, max(CASE WHEN c2 IS NOT NULL THEN greatest(c2 - f0, f1 - c2) END) AS b,
   max(CASE WHEN c3 IS NOT NULL THEN greatest(c3 - f0, f1 - c3) END) AS c, max(CASE WHEN c4 IS NOT NULL THEN greatest(c4 - f0, f1 - c4) END) AS e FROM c)
 SELECT round(a, 4) AS normal, round(b, 4) AS lognormal, round(c, 4) AS pareto, round(e, 4) AS exponential,
  CASE least(a, b, c, e) WHEN a THEN 'normal' WHEN b THEN 'lognormal' WHEN c THEN 'pareto' ELSE 'exponential' END AS best_fit, round(least(a, b, c, e), 4) AS ks_statistic,
  a > least(a, b, c, e) AS transform_hint FROM d)"""


@query("distribution_fit", "PRF-05", _U([_ks("value", "events"), _ks("user_id", "events")]))
def _(t):
    return pf.distribution_fit(t.events, ["value", "user_id"])


def _dt(c, table):
    return f"""SELECT '{c}' AS "column", * FROM (
 WITH a AS (SELECT {c} AS d FROM {table}), s AS (SELECT (epoch_us(d) - epoch_us(lag(d) OVER (ORDER BY d))) / 8.64e10 AS x FROM a),
 u AS (SELECT (epoch_us(d) - epoch_us(lag(d) OVER (ORDER BY d))) / 8.64e10 AS x FROM (SELECT DISTINCT d FROM a)), g AS (SELECT x FROM u WHERE x > 2.5 * (SELECT median(x) FROM u)),
 m AS (SELECT floor(median(x)) AS m FROM s), r AS (SELECT min(d) AS min, max(d) AS max FROM a),
 o AS (SELECT *, floor((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(max)) / 8.64e10)::BIGINT AS ago FROM r)
 SELECT min, max, floor((epoch_us(max) - epoch_us(min)) / 8.64e10)::BIGINT AS range_days,
  CASE WHEN m <= 1 THEN 'daily' WHEN m <= 8 THEN 'weekly' WHEN m <= 32 THEN 'monthly' WHEN m <= 95 THEN 'quarterly' ELSE 'yearly' END AS inferred_frequency,
  (SELECT count(*) FROM g) AS gap_count, coalesce((SELECT max(floor(x)) FROM g), 0)::BIGINT AS largest_gap_days, ago AS most_recent_days_ago,
  CASE WHEN ago <= 7 THEN 'fresh' WHEN ago <= 30 THEN 'recent' WHEN ago <= 180 THEN 'stale' ELSE 'outdated' END AS data_freshness FROM o, m)"""


@query("datetime_profile_events", "PRF-06 PRF-07", _dt("ts", "events"))
def _(t):
    return pf.datetime_profile(t.events, "2024-06-01")


@query("datetime_profile_orders", "PRF-06 PRF-07", _dt("o_orderdate", "orders"))
def _(t):
    return pf.datetime_profile(t.orders, "2024-06-01")


@query("time_gaps_orders", "PRF-07", """
WITH d AS (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderpriority = '1-URGENT'), s AS (SELECT lag(d) OVER (ORDER BY d) AS p, d, date_diff('day', lag(d) OVER (ORDER BY d), d) AS x FROM d)
SELECT 'o_orderdate' AS "column", p AS gap_from, d AS gap_to, x AS gap_days FROM s WHERE x > 2.5 * (SELECT median(x) FROM s)""")
def _(t):
    return pf.time_gaps(t.orders.where("o_orderpriority = '1-URGENT'"), "o_orderdate")


def _cat(c, table):
    return f"""SELECT '{c}' AS "column", * FROM (
 WITH k AS (SELECT {c} AS v, count(*) AS n, any_value(len(regexp_split_to_array(trim({c}), '\\s+'))) AS w FROM {table} WHERE {c} IS NOT NULL GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn FROM k), t AS (SELECT count(*) AS rows FROM {table})
 SELECT count(*) AS "unique", arg_min(v, rn) AS most_common, round(max(n) / any_value(rows) * 100, 1) AS most_common_pct,
   coalesce(sum(n) FILTER (rn > 10), 0)::BIGINT AS other_count, CASE WHEN count(*) / any_value(rows) > 0.3 THEN round(sum(n * w) / sum(n), 1) END AS avg_word_count FROM r, t)"""


@query("column_profile_categorical", "PRF-08", _U(_cat(c, "part") for c in ["p_name", "p_brand", "p_type"]))
def _(t):
    return pf.categorical_profile(t.part, ["p_name", "p_brand", "p_type"])


@query("categorical_profile_customers", "PRF-08", _U(_cat(c, "customer") for c in ["c_name", "c_mktsegment"]))
def _(t):
    return pf.categorical_profile(t.customer, ["c_name", "c_mktsegment"])


@query("top_values_per_column", "PRF-08", _U(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
FROM part GROUP BY {c} QUALIFY rank <= 10""" for c in ["p_name", "p_brand", "p_type"]).replace("SELECT '", "(SELECT '", 0))
def _(t):
    return pf.top_values(t.part, ["p_name", "p_brand", "p_type"])


def _rx(s):
    return s.replace("'", "''")


def _pat(c, table):
    cases = " ".join(f"WHEN round(count(*) FILTER (regexp_matches({c}, '{_rx(rx)}')) / count({c}) * 100, 1) >= 50 THEN struct_pack(p := '{n}', k := count(*) FILTER (regexp_matches({c}, '{_rx(rx)}')))"
                     for n, rx in VALUE_PATTERNS)
    return f"""SELECT '{c}' AS "column", h.p AS pattern, CASE WHEN round(h.k / n * 100, 1) >= 85 THEN 'strong' ELSE 'weak' END AS strength,
  round(h.k / n * 100, 1) AS compliance_pct, n - h.k AS malformed FROM (SELECT count({c}) AS n, CASE {cases} END AS h FROM {table}) WHERE h IS NOT NULL"""


_MIX = """SELECT page_id, url, html, 'user' || page_id || '@example.com' AS mail, CASE WHEN page_id < 1000000 THEN (page_id * 1.5)::DECIMAL(12,1)::VARCHAR || '%' END AS pct,
  '$' || page_id::VARCHAR AS cash FROM pages"""


@query("pattern_rates_pages", "PRF-09", f"WITH d AS ({_MIX}) " + _U(_pat(c, "d") for c in ["url", "html", "mail", "pct", "cash"]))
def _(t):
    d = t.pages.select("url", "html", F.concat(F.lit("user"), "page_id", F.lit("@example.com")).alias("mail"),
                       F.concat((F.col("page_id") * 1.5).cast("decimal(12,1)").cast("string"), F.lit("%")).alias("pct"),
                       F.concat(F.lit("$"), F.col("page_id").cast("string")).alias("cash"))
    return pf.value_patterns(d)


@query("pattern_rates_documents", "PRF-09", _U(_pat(c, "documents") for c in ["text", "lang", "source"]))
def _(t):
    return pf.value_patterns(t.documents, ["text", "lang", "source"])


_FMT = """SELECT CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS mixed, o_orderpriority AS prio FROM orders"""


def _fc(c):
    found = " + ".join(f"(count(*) FILTER (regexp_matches({c}, '{_rx(rx)}')) > 0)::INT" for _, rx in DATE_SHAPES)
    return f"""SELECT '{c}' AS "column", CASE WHEN f >= 2 THEN 'mixed_date_formats' ELSE 'inconsistent_length' END AS issue, lengths, round(top / n * 100, 1) AS top_length_pct FROM
 (SELECT count({c}) AS n, {found} AS f FROM d), (SELECT count(*) AS lengths, max(k) AS top FROM (SELECT count(*) AS k FROM d GROUP BY length({c})))
 WHERE n >= 10 AND (f >= 2 OR (lengths >= 3 AND top / n < 0.7))"""


@query("format_consistency_orders", "PRF-10", f"WITH d AS ({_FMT}) " + _U(_fc(c) for c in ["mixed", "prio"]))
def _(t):
    f = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return pf.format_consistency(t.orders.select(f.alias("mixed"), F.col("o_orderpriority").alias("prio")))


@query("binary_columns_labels", "PRF-11", _U(f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count(*) FILTER ({c} = 0) AS low_count, count(*) FILTER ({c} = 1) AS high_count,
  'No' AS low_label, 'Yes' AS high_label FROM labels""" for c in ["quality", "toxic"]))
def _(t):
    return pf.binary_columns(t.labels)


_PROF_COLS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "categorical"), ("value", "numeric"), ("props", "categorical")]


@query("quality_flags_events", "PRF-12", """
WITH n AS (""" + _U(_num(c, "events") for c in ["event_id", "user_id", "value"]) + "), k AS (" + "SELECT 1" + """),
len AS (SELECT 'event_type' AS c, count(*) AS lengths, max(k) AS top FROM (SELECT count(*) AS k FROM events GROUP BY length(event_type))
        UNION ALL SELECT 'props', count(*), max(k) FROM (SELECT count(*) AS k FROM events GROUP BY length(props))),
nn AS (SELECT 'event_id' AS c, false AS is_normal UNION ALL SELECT 'user_id', false UNION ALL SELECT 'value', false),
g AS (SELECT count(*) FILTER (x > 2.5 * md) AS gaps FROM (SELECT x, median(x) OVER () AS md FROM (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) AS x FROM (SELECT DISTINCT ts FROM events)))),
f AS (
 SELECT "column", list_filter([CASE WHEN outliers_iqr > 0 THEN 'IQR outliers' END, CASE WHEN abs(skewness) > 2 THEN 'highly skewed' END, CASE WHEN NOT is_normal THEN 'non-normal distribution' END], lambda x: x IS NOT NULL) AS l
 FROM n JOIN nn ON nn.c = n."column"
 UNION ALL SELECT 'ts', CASE WHEN gaps > 0 THEN ['time gaps detected'] ELSE [] END FROM g
 UNION ALL SELECT len.c, CASE WHEN lengths >= 3 AND top / (SELECT count(*) FROM events) < 0.7 THEN ['mixed formats detected'] ELSE [] END FROM len)
SELECT "column", array_to_string(l, '; ') AS flags, len(l) AS n_flags FROM f""")
def _(t):
    return pf.quality_flags(pf.full_profile(t.events))


@query("dataset_types_catalogue", "PRF-13", """
WITH p AS (
 SELECT 'orders' AS dataset, 'o_orderkey' AS c, 'numeric' AS k, count(*) AS n, count(DISTINCT o_orderkey) AS u FROM orders UNION ALL SELECT 'orders', 'o_custkey', 'numeric', count(*), count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'orders', 'o_orderstatus', 'categorical', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'orders', 'o_totalprice', 'numeric', count(*), count(DISTINCT o_totalprice) FROM orders
 UNION ALL SELECT 'orders', 'o_orderdate', 'datetime', count(*), count(DISTINCT o_orderdate) FROM orders UNION ALL SELECT 'orders', 'o_orderpriority', 'categorical', count(*), count(DISTINCT o_orderpriority) FROM orders
 UNION ALL SELECT 'labels', 'doc_id', 'numeric', count(*), count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'labels', 'quality', 'numeric', count(*), count(DISTINCT quality) FROM labels
 UNION ALL SELECT 'labels', 'toxic', 'numeric', count(*), count(DISTINCT toxic) FROM labels),
x AS (SELECT *, u / n > 0.9 AND regexp_matches(c, 'id|order|transaction|invoice|receipt|ticket') AS tx FROM p),
s AS (SELECT dataset, sum(CASE WHEN k = 'datetime' AND u / n > 0.5 THEN 3 WHEN k = 'datetime' THEN 1 ELSE 0 END) - 2 * count(*) FILTER (tx) AS timeseries,
  3 * count(*) FILTER (tx) + count(*) FILTER (k = 'numeric' AND regexp_matches(c, 'amount|price|revenue|cost|qty|quantity|total|sale')) AS transactional,
  CASE WHEN count(*) FILTER (k = 'categorical') > 0 AND count(*) FILTER (k = 'categorical' AND u <= 10) / count(*) FILTER (k = 'categorical') > 0.5 THEN 2 ELSE 0 END
  + CASE WHEN bool_or(regexp_matches(c, 'rating|score|response|satisfaction|agree|disagree|rank|feedback|opinion')) THEN 2 ELSE 0 END AS survey FROM x GROUP BY 1),
b AS (SELECT *, greatest(timeseries, transactional, survey) AS best, abs(timeseries) + abs(transactional) + abs(survey) AS sig FROM s)
SELECT dataset, timeseries::BIGINT AS timeseries, transactional::BIGINT AS transactional, survey::BIGINT AS survey,
  CASE WHEN best <= 0 OR sig = 0 THEN 'general' WHEN timeseries = best THEN 'timeseries' WHEN transactional = best THEN 'transactional' ELSE 'survey' END AS dataset_type,
  CASE WHEN best <= 0 OR sig = 0 THEN 40 ELSE round_even(least(95, greatest(40, best / sig * 100 + 40)), 0) END::BIGINT AS confidence FROM b""")
def _(t):
    cat = pf.base_profile(t.orders).withColumn("dataset", F.lit("orders")).unionByName(pf.base_profile(t.labels).withColumn("dataset", F.lit("labels")))
    return health.dataset_type(cat, ("dataset",))


_HEALTH = """
WITH f AS (SELECT count(*) AS n, count(*) * 5 - count(doc_id) - count(text) - count(lang) - count(source) - count(n_chars) AS nulls,
  bool_or(trim(text) <> text OR trim(lang) <> lang OR trim(source) <> source) AS ws FROM documents),
dup AS (SELECT sum(c - 1)::BIGINT AS d FROM (SELECT count(*) AS c FROM documents GROUP BY doc_id, text, lang, source, n_chars)),
q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, abs(skewness(n_chars)) AS s, abs(skewness(doc_id)) AS s2 FROM documents),
o AS (SELECT count(*) AS o FROM documents, q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)),
c AS (SELECT (count(DISTINCT doc_id) <= 1)::INT + (count(DISTINCT text) <= 1)::INT + (count(DISTINCT lang) <= 1)::INT + (count(DISTINCT source) <= 1)::INT + (count(DISTINCT n_chars) <= 1)::INT AS k FROM documents),
z AS (SELECT round(greatest(0, 30 - nulls / (n * 5) * 100 * 1.5), 1) AS completeness, round(greatest(0, 20 - d / n * 100 * 2), 1) AS uniqueness,
  round(20.0::DOUBLE - CASE WHEN ws THEN 2 ELSE 0 END, 1) AS consistency,
  round(15.0::DOUBLE - CASE WHEN o > 0 THEN 2 ELSE 0 END - CASE WHEN s > 2 THEN 1 ELSE 0 END, 1) AS validity,
  round(15.0::DOUBLE - least(k * 2.0, 9.0) - CASE WHEN s > 3 THEN 1.5 ELSE 0 END, 1) AS structure, d AS duplicate_rows, o AS outlier_rows FROM f, dup, q, o, c)
SELECT completeness, uniqueness, consistency, validity, structure, round(completeness + uniqueness + consistency + validity + structure, 1) AS total,
  CASE WHEN round(completeness + uniqueness + consistency + validity + structure, 1) >= 85 THEN 'A' WHEN round(completeness + uniqueness + consistency + validity + structure, 1) >= 70 THEN 'B' ELSE 'C' END AS grade,
  0::BIGINT AS unreliable_rows, 0.0::DOUBLE AS unreliable_pct, duplicate_rows, outlier_rows FROM z"""


@query("health_score_documents", "PRF-14 PRF-16", _HEALTH)
def _(t):
    return health.health_score(t.documents)


def _ch(c, table, numeric):
    if not numeric:
        return f"""SELECT '{c}' AS "column", round(100 - least(40, (count(*) - count({c})) / count(*) * 100 * 1.5), 1) AS score FROM {table}"""
    return f"""SELECT '{c}' AS "column", round(100 - least(40, (count(*) - count(v)) / count(*) * 100 * 1.5) - CASE WHEN any_value(q3 > q1) THEN
   least(20, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(v) * 100 * 2) ELSE 0 END
   - CASE WHEN abs(skewness(v)) > 3 THEN 5 ELSE 0 END - CASE WHEN count(DISTINCT v) <= 1 THEN 20 ELSE 0 END, 1) AS score
 FROM (SELECT {c}::DOUBLE AS v FROM {table}), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})"""


_DL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


@query("column_health_documents", "PRF-15", _U(_ch(c, _DL, k) for c, k in [("doc_id", 1), ("text", 0), ("lang", 0), ("source", 0), ("n_chars", 1), ("quality", 1), ("toxic", 1)]))
def _(t):
    return health.column_health(t.documents.join(t.labels, "doc_id", "left"))


@query("missingness_raw_vs_clean", "PRF-17", f"""
WITH d AS {_DL}, n AS (SELECT count(*) AS n, count(*) - count(quality) AS q, count(*) - count(toxic) AS t FROM d)
SELECT 'quality' AS "column", q AS raw_missing, round(q / n * 100, 1) AS raw_pct, 0::BIGINT AS clean_missing, 0.0::DOUBLE AS clean_pct FROM n
UNION ALL SELECT 'toxic', t, round(t / n * 100, 1), t, round(t / n * 100, 1) FROM n
UNION ALL SELECT c, 0, 0.0, 0, 0.0 FROM (SELECT unnest(['doc_id', 'lang']) AS c)""")
def _(t):
    raw = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")
    return health.missingness(raw, raw.na.fill(0, ["quality"]))


@query("key_columns_events", "PRF-17", """SELECT c AS "column" FROM (SELECT count(*) AS n, count(DISTINCT event_id) AS event_id, count(DISTINCT ts) AS ts, count(DISTINCT user_id) AS user_id,
  count(DISTINCT event_type) AS event_type, count(DISTINCT value) AS value, count(DISTINCT props) AS props FROM events) UNPIVOT (u FOR c IN (event_id, ts, user_id, event_type, value, props)) WHERE u = n""")
def _(t):
    return health.key_columns(t.events)


@query("distinct_counts_lineitem", "SRC-15 PRF-01", _U(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM lineitem""" for c in ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"]))
def _(t):
    return distinct_counts(t.lineitem, ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"])
