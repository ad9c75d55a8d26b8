"""Queries of the semantic layer over a catalogue of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridloom.catalog.base import query
from gridloom.operators import semantic as sem

_TABLES = {
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "text"), ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "text")],
    "events": [("event_id", "integer"), ("ts", "datetime"), ("user_id", "integer"), ("event_type", "text"), ("value", "float"), ("props", "text")],
    "labels": [("doc_id", "integer"), ("quality", "integer"), ("toxic", "integer")],
    "documents": [("doc_id", "integer"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "integer")],
}


def _facts(t):
    parts = [sem.column_facts(getattr(t, n), n) for n in _TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _one(n, i, c, k):
    num = k in ("integer", "float")
    solid = f"count(*) FILTER (trim({c}) <> '')" if k == "text" else f"count({c})"
    pairs = "[['false','true'],['no','yes'],['n','y'],['0','1'],['f','t'],['off','on']]"
    truth = (f"coalesce(list_contains({pairs}, list_sort(list(DISTINCT lower(trim({c}))) FILTER ({c} IS NOT NULL))), false)" if k == "text"
             else f"bool_and({c} IN (0, 1))" if num else "false")
    return f"""SELECT '{n}' AS dataset, '{c}' AS "column", {i} AS ord, '{k}' AS dtype, count(*) AS rows, count({c}) AS filled, {solid} AS solid, count(DISTINCT {c}) AS n_unique,
 {f'avg(length({c}))' if k == 'text' else 'NULL::DOUBLE'} AS avg_len, {f'min({c})::DOUBLE' if num else 'NULL::DOUBLE'} AS lo, {f'max({c})::DOUBLE' if num else 'NULL::DOUBLE'} AS hi,
 count(DISTINCT {c}) <= 2 AND {truth} AS bool_like FROM {n}"""


_W = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_HAS = lambda ws: f"list_has_any(tok, {_W(ws)})"
_FACTS = ("f0 AS (" + " UNION ALL ".join(_one(n, i, c, k) for n, cols in _TABLES.items() for i, (c, k) in enumerate(cols)) + """),
f AS (SELECT *, coalesce(dtype = 'text' AND avg_len >= 30 AND n_unique / filled >= 0.5, false) AS free, regexp_split_to_array(lower("column"), '[_\\s\\-\\.]+') AS tok FROM f0)""")

_ROLE = f"""r AS (SELECT *, CASE
 WHEN list_has_any(tok, {_W(sem.HELPER_WORDS)}) THEN 'helper_artifact' WHEN tok[-1] IN (SELECT unnest({_W(sem.DATE_PARTS)})) THEN 'helper_artifact'
 WHEN dtype = 'datetime' OR {_HAS(sem.TIME_WORDS)} THEN 'time' WHEN {_HAS(sem.TARGET_WORDS)} THEN 'target' WHEN {_HAS(sem.TARGET_GUESS_WORDS)} AND bool_like THEN 'target'
 WHEN bool_like THEN 'boolean_flag' WHEN {_HAS(sem.ID_NEAR_WORDS)} AND {_HAS(sem.TRANSACTION_WORDS)} AND n_unique / filled >= 0.75 THEN 'transaction_id'
 WHEN ({_HAS(sem.ID_WORDS)} OR {_HAS(sem.ENTITY_WORDS)}) AND n_unique / filled >= 0.75 THEN 'entity_id' WHEN free THEN 'free_text' WHEN {_HAS(sem.LEAKAGE_WORDS)} THEN 'leakage_candidate'
 WHEN {_HAS(sem.GEO_WORDS)} THEN 'geographic' WHEN {_HAS(sem.RATE_WORDS)} THEN 'rate_percentage' WHEN {_HAS(sem.MONEY_WORDS)} THEN 'currency_amount'
 WHEN dtype IN ('integer', 'float') THEN 'metric' WHEN dtype = 'text' AND n_unique BETWEEN 2 AND least(50, greatest(2, floor(rows * 0.5))) THEN 'dimension' ELSE 'unknown' END AS role FROM f)"""
_PRINT = f"""p AS (SELECT dataset, max(rows) AS rows, count(*) AS columns, count(*) FILTER (dtype IN ('integer', 'float') AND NOT bool_like) AS "numeric",
  count(*) FILTER (dtype = 'text' AND NOT bool_like AND NOT free) AS categorical, count(*) FILTER (dtype = 'datetime') AS datetime, count(*) FILTER (bool_like) AS boolean,
  count(*) FILTER (free AND NOT bool_like) AS free_text, round(1 - sum(filled) / sum(rows), 6) AS missing_rate, round(sum(solid) / sum(rows), 6) AS density,
  bool_or({_HAS(sem.SHAPE_EVENT)}) AS ev, bool_or({_HAS(sem.SHAPE_ENTITY)}) AS en, bool_or({_HAS(sem.SHAPE_TRANSACTION)}) AS tx, bool_or({_HAS(sem.SHAPE_ENTITY)} AND n_unique / filled >= 0.8) AS eid
 FROM f GROUP BY 1),
fp AS (SELECT * EXCLUDE (ev, en, tx, eid), CASE WHEN datetime >= 1 AND rows >= 5 AND ev THEN 'event_log' WHEN datetime >= 1 AND rows >= 5 AND en THEN 'panel_data'
  WHEN datetime >= 1 AND "numeric" >= 1 AND categorical <= 2 AND rows >= 5 THEN 'time_series' WHEN columns >= 5 AND categorical + boolean >= 4 AND "numeric" <= 2 THEN 'survey'
  WHEN rows >= 5 AND tx THEN 'transactional' WHEN datetime = 0 AND eid THEN 'entity_table' ELSE 'snapshot' END AS shape FROM p)"""


@query("column_roles_catalogue", "PRF-19", f"""WITH {_FACTS}, {_ROLE} SELECT dataset, "column", role, n_unique FROM r""")
def _(t):
    return sem.column_roles(_facts(t)).select("dataset", "column", "role", "n_unique")


@query("fingerprint_catalogue", "PRF-18", f"WITH {_FACTS}, {_PRINT} SELECT * FROM fp")
def _(t):
    return sem.fingerprint(_facts(t))


@query("fingerprint_duplicates", "PRF-18", """SELECT 'documents' AS dataset, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)))::BIGINT AS duplicates FROM documents""")
def _(t):
    return sem.duplicates_of(t.documents.drop("doc_id"), "documents")


def _any_name(words):
    return f"bool_or(list_has_any(tok, {_W(words)}))"


_GRAIN = f"""g AS (SELECT r.dataset, any_value(shape) AS shape, count(*) FILTER (role = 'time') AS t, count(*) FILTER (role = 'transaction_id') AS tx, count(*) FILTER (role = 'entity_id') AS ent,
 {_any_name(sem.GRAIN_EVENT)} AS ev, {", ".join(f"{_any_name(w)} AS n_{l}, bool_or(list_has_any(tok, {_W(w)}) AND role = '{ro}') AS r_{l}" for w, l, ro, _, _ in sem.GRAIN_RULES)}
 FROM r JOIN fp USING (dataset) GROUP BY 1)"""
_GR_CASES = " ".join(
    ("WHEN shape = 'transactional' THEN ('transaction', 0.85) WHEN tx > 0 THEN ('transaction', 0.8) " if l == "transaction" else f"WHEN r_{l} THEN ('{l}', {a}) ")
    + f"WHEN n_{l} THEN ('{l}', {b})" for w, l, ro, a, b in sem.GRAIN_RULES)


@query("grain_catalogue", "PRF-20", f"""WITH {_FACTS}, {_ROLE}, {_PRINT}, {_GRAIN},
k AS (SELECT dataset, CASE WHEN shape = 'survey' THEN ('survey_response', 0.9) WHEN shape = 'time_series' THEN ('time_period', 0.85)
  WHEN t >= 1 AND tx = 0 AND ent = 0 AND NOT (ev OR {" OR ".join(f"n_{r[1]}" for r in sem.GRAIN_RULES if r[1] != "transaction")}) THEN ('time_period', 0.7)
  WHEN shape = 'event_log' THEN ('event', 0.9) WHEN t >= 1 AND ev THEN ('event', 0.75) {_GR_CASES} ELSE ('unknown', 0.0) END AS k FROM g)
SELECT dataset, k[1] AS grain, k[2]::DOUBLE AS grain_confidence FROM k""")
def _(t):
    f = _facts(t)
    return sem.grain(sem.column_roles(f), sem.fingerprint(f))


@query("structural_risks_catalogue", "PRF-21", f"""WITH {_FACTS}, {_ROLE}, {_PRINT},
g AS (SELECT dataset, count(*) AS cols, max(r.rows) AS rows, count(*) FILTER (role IN ('entity_id', 'transaction_id')) AS n_ids,
 coalesce(string_agg("column", ',' ORDER BY ord) FILTER (role IN ('entity_id', 'transaction_id')), '') AS ids,
 coalesce(string_agg("column", ',' ORDER BY ord) FILTER (n_unique <= 1), '') AS const,
 coalesce(string_agg("column", ',' ORDER BY ord) FILTER (role IN ('dimension', 'geographic') AND n_unique > greatest(50, r.rows * 0.5)), '') AS wide,
 count(*) FILTER (role = 'transaction_id') AS tx, count(*) FILTER (role = 'entity_id') AS ent, any_value(shape) AS shape FROM r JOIN fp USING (dataset) GROUP BY 1)
SELECT dataset, 'too_many_id_columns' AS risk, 'medium' AS severity, ids AS columns FROM g WHERE n_ids / cols > 0.2
UNION ALL SELECT dataset, 'very_small_sample', 'high', '' FROM g WHERE rows < 30 UNION ALL SELECT dataset, 'small_sample', 'medium', '' FROM g WHERE rows BETWEEN 30 AND 99
UNION ALL SELECT dataset, 'high_cardinality_dimensions', 'medium', wide FROM g WHERE wide <> '' UNION ALL SELECT dataset, 'constant_columns', 'low', const FROM g WHERE const <> ''
UNION ALL SELECT dataset, 'mixed_grain', 'medium', ids FROM g WHERE tx > 0 AND ent > 0 AND shape = 'snapshot'""")
def _(t):
    f = _facts(t)
    return sem.structural_risks(sem.column_roles(f), sem.fingerprint(f))


_M, _P, _D = "role IN ('metric', 'currency_amount', 'rate_percentage', 'target')", "role IN ('metric', 'currency_amount', 'rate_percentage')", "role IN ('dimension', 'geographic', 'boolean_flag')"


@query("analysis_strategy_catalogue", "PRF-24", f"""WITH {_FACTS}, {_ROLE}, {_PRINT},
g AS (SELECT dataset, count(*) FILTER (role = 'time') AS t, count(*) FILTER ({_M}) AS m, count(*) FILTER ({_P}) AS p, count(*) FILTER ({_D}) AS d, count(*) FILTER (role = 'target') AS y,
  count(*) FILTER (role = 'free_text') AS x, max(r.rows) AS rows, any_value(missing_rate) AS mr, coalesce(string_agg("column", ',' ORDER BY ord) FILTER ({_M}), '') AS ms,
  coalesce(string_agg("column", ',' ORDER BY ord) FILTER ({_D}), '') AS ds, coalesce(string_agg("column", ',' ORDER BY ord) FILTER (role = 'time'), '') AS ts FROM r JOIN fp USING (dataset) GROUP BY 1)
SELECT dataset, concat_ws(',', CASE WHEN y > 0 THEN 'target_analysis' END, CASE WHEN t > 0 AND m > 0 THEN 'trend_analysis' END, CASE WHEN d > 0 AND m > 0 THEN 'segment_comparison' END,
  CASE WHEN p >= 2 THEN 'correlation_analysis' END, CASE WHEN m > 0 AND rows >= 20 THEN 'anomaly_detection' END, CASE WHEN m > 0 THEN 'distribution_analysis' END,
  CASE WHEN mr > 0 THEN 'missingness_analysis' END, CASE WHEN x > 0 THEN 'text_review' END) AS recommended,
 concat_ws(',', CASE WHEN t = 0 THEN 'trend_analysis' END, CASE WHEN d = 0 THEN 'segment_comparison' END, CASE WHEN p < 2 THEN 'correlation_analysis' END, CASE WHEN rows < 20 THEN 'anomaly_detection' END,
  CASE WHEN y = 0 THEN 'target_analysis' END, CASE WHEN x = 0 THEN 'text_review' END) AS deprioritised, ms AS metric_columns, ds AS dimension_columns, ts AS time_columns FROM g""")
def _(t):
    f = _facts(t)
    return sem.analysis_strategy(sem.column_roles(f), sem.fingerprint(f))


_LIKE = lambda ws: "regexp_matches(norm, '" + "|".join(ws) + "')"
_DOM = list(sem.DOMAIN_WORDS)


@query("table_domains_catalogue", "PRF-22", f"""WITH {_FACTS},
c AS (SELECT dataset, "column", ord, lower("column") AS norm, CASE WHEN regexp_matches(lower("column"), '(date|timestamp|_at$|_on$)|(^|_)(time|month|year|quarter|week|day)(_|$)') THEN 'time'
  WHEN regexp_matches(lower("column"), '(^|_)(id|key|num|code|ref|uid|uuid|hash|ticker|symbol)($|_)') OR (n_unique / rows >= 0.98 AND dtype = 'text') THEN 'ignore' ELSE 'active' END AS use FROM f),
h AS (SELECT dataset, {", ".join(f"count(*) FILTER ({_LIKE(w)}) AS {k}" for k, w in sem.DOMAIN_WORDS.items())}, string_agg(norm, ' ' ORDER BY ord) AS alln FROM c GROUP BY 1),
b AS (SELECT *, greatest({", ".join(_DOM)}) AS best, list_reverse_sort([{", ".join(_DOM)}]) AS o FROM h),
k AS (SELECT dataset, CASE WHEN best = 0 THEN 'generic' {" ".join(f"WHEN {k} = best THEN '{k}'" for k in _DOM)} END AS kind, best AS hits,
  CASE WHEN best >= 5 THEN least(0.95, 0.8 + (best - 5) * 0.02) WHEN best >= 3 THEN 0.6 + (best - 3) * 0.1 WHEN best >= 1 THEN 0.4 + (best - 1) * 0.1 ELSE 0.35 END AS cf, best >= 1 AND o[1] - o[2] <= 1 AS close,
  CASE {" ".join(f"WHEN regexp_matches(alln, '{'|'.join(w)}') THEN '{l}'" for l, w in sem.COARSE_DOMAINS)} ELSE 'General' END AS coarse_domain FROM b),
t AS (SELECT c.*, use = 'active' AND ({" OR ".join(f"(kind = '{k}' AND {_LIKE(w)})" for k, w in sem.TARGET_METRICS.items() if w)} OR {_LIKE(sem.TARGET_METRICS['sales'])}) AS tgt FROM c JOIN k USING (dataset)),
l AS (SELECT dataset, coalesce(string_agg("column", ',' ORDER BY ord) FILTER (tgt), '') AS target_metrics,
  coalesce(string_agg("column", ',' ORDER BY ord) FILTER (use = 'active' AND NOT tgt AND {_LIKE(sem.DIMENSION_WORDS)}), '') AS dimensions,
  coalesce(string_agg("column", ',' ORDER BY ord) FILTER (use = 'time'), '') AS time_columns, coalesce(string_agg("column", ',' ORDER BY ord) FILTER (use = 'ignore'), '') AS ignored FROM t GROUP BY 1)
SELECT dataset, kind, hits, round(CASE WHEN close THEN greatest(0.35, cf - 0.15) ELSE cf END, 3)::DOUBLE AS confidence, coarse_domain, target_metrics, dimensions, time_columns, ignored,
  CASE kind {" ".join(f"WHEN '{k}' THEN '{e}'" for k, e in sem.DOMAIN_ENTITY.items())} END AS entity FROM k JOIN l USING (dataset)""")
def _(t):
    f = _facts(t)
    cat = f.select("dataset", "column", "ord", "dtype", (F.col("n_unique") / F.col("rows")).alias("unique_pct"), (1 - F.col("filled") / F.col("rows")).alias("missing_pct"))
    return sem.classify_tables(cat)


@query("finance_context_catalogue", "PRF-23", """
WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l, (SELECT count(*) FROM labels) AS b, (SELECT count(*) FROM customer) AS c)
SELECT 'orders' AS dataset, true AS time_axis, 0::BIGINT AS ohlc, 0.0::DOUBLE AS snapshot_score, 'generic_tabular' AS context, 1.0::DOUBLE AS confidence FROM n
UNION ALL SELECT 'prices', true, 2, 0.04, CASE WHEN l > 0 THEN 'financial_markets_timeseries' ELSE 'generic_tabular' END, 0.9 FROM n
UNION ALL SELECT 'market', false, 0, 0.77, CASE WHEN c > 0 THEN 'financial_markets_snapshot' ELSE 'generic_tabular' END, 0.77 FROM n
UNION ALL SELECT 'labels', false, 0, 0.0, 'generic_tabular', 1.0 FROM n""")
def _(t):
    prices = t.lineitem.groupBy(F.col("l_partkey").alias("Ticker"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Price Date")).agg(
        F.avg("l_extendedprice").alias("Close"), F.max("l_extendedprice").alias("High"))
    market = t.customer.select(F.col("c_name").alias("shortName"), F.col("c_mktsegment").alias("asset class"), F.col("c_acctbal").alias("ytd_return"),
                               F.abs("c_acctbal").alias("Volatility 1Y"), F.col("c_acctbal").alias("sharpe_1y"), F.col("c_acctbal").alias("pct%"), F.col("c_custkey").alias("Ticker Symbol"))
    market = market.drop("shortName", "Ticker Symbol").withColumn("symbol", F.lit("x"))

    def rows(d, name):
        from gridloom.operators.cleaning import parse_dates
        f = sem.column_facts(d, name).select("dataset", "column", "dtype", "rows")
        texts = [c for c, k in d.dtypes if k == "string"]
        if not texts:
            return f.withColumn("date_share", F.lit(0.0))
        from gridloom.plans.stacked import wide_to_rows
        s = wide_to_rows(d, texts, {"date_share": lambda c: F.avg(parse_dates(c).isNotNull().cast("int"))})
        return f.join(s, "column", "left").na.fill(0.0, ["date_share"]).select("dataset", "column", "dtype", "rows", "date_share")
    parts = [rows(t.orders, "orders"), rows(prices, "prices"), rows(market, "market"), rows(t.labels, "labels")]
    return sem.finance_context(reduce(lambda a, b: a.unionByName(b), parts))
