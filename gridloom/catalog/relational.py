"""Queries of the relational part: filters, paging, joins, aggregates, pivots, cohorts, comparison, ad-hoc SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gridloom.catalog.base import query
from gridloom.operators import adhoc, aggregates as agg, comparison as cmp, filters as flt, joins as jn


# --- segment statistics and pivots -------------------------------------------------------------------------------

@query("segment_stats_returnflag", "AGG-01", """
SELECT l_returnflag AS segment, count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean,
       round(quantile_cont(l_quantity, 0.5), 4) AS median, round(stddev_samp(l_quantity), 4) AS std,
       round(min(l_quantity), 4) AS min, round(max(l_quantity), 4) AS max
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def _(t):
    return agg.segment_stats(t.lineitem, "l_returnflag", "l_quantity")


def _pivot_sql(expr):
    def cell(f):
        return f"coalesce(round({expr} FILTER ({f}), 4), 0.0)::DOUBLE"
    cols = ", ".join(f"""{cell(f"o_orderstatus = '{s}'")} AS "{s}\"""" for s in "FOP")
    return f"""
SELECT coalesce(o_orderpriority, 'Grand Total') AS o_orderpriority, {cols},
       coalesce(round({expr}, 4), 0.0)::DOUBLE AS "Grand Total"
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())"""


for _name, _fn, _expr in [
    ("sum", "sum", "sum(o_totalprice)"), ("mean", "mean", "avg(o_totalprice)"), ("count", "count", "count(o_totalprice)"),
    ("min", "min", "min(o_totalprice)"), ("max", "max", "max(o_totalprice)"), ("std", "std", "stddev_samp(o_totalprice)"),
    ("median", "median", "median(o_totalprice)"),
]:
    def _run(t, fn=_fn):
        df = t.orders
        if fn == "sum":  # cents are summed exactly, so both engines agree to the last digit
            df = df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
        return agg.pivot(df, ["o_orderpriority"], ["o_orderstatus"], "o_totalprice", fn)
    query(f"pivot_priority_status_{_name}", "AGG-02", _pivot_sql(_expr))(_run)


@query("pivot_topn_nation_segment", "AGG-03 SET-03", """
WITH j AS (SELECT n_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
     top AS (SELECT n_name FROM j GROUP BY 1 ORDER BY round(avg(c_acctbal), 4) DESC, n_name LIMIT 10),
     cells AS (
       SELECT n_name, c_mktsegment, round(avg(c_acctbal), 4) AS v FROM j
       GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), (c_mktsegment), ()))
SELECT coalesce(n_name, 'Grand Total') AS n_name,
  coalesce(max(v) FILTER (c_mktsegment = 'AUTOMOBILE'), 0.0) AS "AUTOMOBILE",
  coalesce(max(v) FILTER (c_mktsegment = 'BUILDING'), 0.0) AS "BUILDING",
  coalesce(max(v) FILTER (c_mktsegment = 'FURNITURE'), 0.0) AS "FURNITURE",
  coalesce(max(v) FILTER (c_mktsegment = 'HOUSEHOLD'), 0.0) AS "HOUSEHOLD",
  coalesce(max(v) FILTER (c_mktsegment = 'MACHINERY'), 0.0) AS "MACHINERY",
  coalesce(max(v) FILTER (c_mktsegment IS NULL), 0.0) AS "Grand Total"
FROM cells WHERE n_name IS NULL OR n_name IN (SELECT n_name FROM top) GROUP BY 1""")
def _(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.pivot(j, ["n_name"], ["c_mktsegment"], "c_acctbal", "mean", top_n=10)


@query("append_total_row", "SET-03", """
SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS revenue FROM orders GROUP BY 1
UNION ALL
SELECT 'Grand Total', count(*), round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) FROM orders""")
def _(t):
    g = t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    out = agg.append_total(g, "o_orderstatus", ["n_orders", "revenue"])
    return out.withColumn("revenue", F.round(F.col("revenue").cast("double"), 2))


# --- cohorts ------------------------------------------------------------------------------------------------------

_RFM = """
base AS (
  SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS recency_days,
         count(*) AS frequency, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS monetary
  FROM orders GROUP BY 1),
e AS (SELECT quantile_cont(recency_days::DOUBLE, [0, .2, .4, .6, .8, 1]) AS r,
             quantile_cont(frequency::DOUBLE, [0, .2, .4, .6, .8, 1]) AS f,
             quantile_cont(monetary, [0, .2, .4, .6, .8, 1]) AS m FROM base),
s AS (
  SELECT o_custkey, recency_days, frequency, round(monetary, 2) AS monetary,
    CASE WHEN len(list_distinct(r)) < 6 THEN 3 ELSE 5 - len(list_filter(r[2:5], lambda x: x < recency_days)) END AS r_score,
    CASE WHEN len(list_distinct(f)) < 6 THEN 3 ELSE 1 + len(list_filter(f[2:5], lambda x: x < frequency)) END AS f_score,
    CASE WHEN len(list_distinct(m)) < 6 THEN 3 ELSE 1 + len(list_filter(m[2:5], lambda x: x < monetary)) END AS m_score
  FROM base, e),
seg AS (
  SELECT *, r_score + f_score + m_score AS rfm_score,
    CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions' WHEN f_score >= 4 AND r_score >= 3 THEN 'Loyal'
         WHEN r_score >= 4 AND f_score = 1 THEN 'New Customer' WHEN r_score >= 4 AND f_score <= 3 THEN 'Potential Loyalist'
         WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost'
         ELSE 'Promising' END AS segment
  FROM s)"""


def _cents(orders):
    return orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


def _rfm(t):
    base = agg.rfm_base(_cents(t.orders), "o_custkey", "o_orderdate", "o_totalprice")
    return base.withColumn("monetary", F.col("monetary").cast("double"))


@query("rfm_base", "AGG-04", f"WITH {_RFM} SELECT o_custkey, recency_days, frequency, round(monetary, 2) AS monetary FROM base")
def _(t):
    return _rfm(t).withColumn("monetary", F.round("monetary", 2))


@query("rfm_scores", "AGG-05 AGG-06", f"WITH {_RFM} SELECT * FROM seg")
def _(t):
    return agg.rfm_scores(_rfm(t), "o_custkey")


@query("rfm_segments", "AGG-06", f"""WITH {_RFM}
SELECT segment, count(*) AS count, round(avg(monetary), 2) AS avg_monetary, round(avg(frequency), 2) AS avg_frequency,
       round(avg(recency_days), 1) AS avg_recency_days, round(sum(monetary::DECIMAL(18,2))::DOUBLE, 2) AS total_revenue
FROM seg GROUP BY 1""")
def _(t):
    return agg.rfm_segment_stats(agg.rfm_scores(_rfm(t), "o_custkey"))


@query("retention_by_month", "AGG-07", """
WITH e AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS period FROM events),
     c AS (SELECT user_id, min(period) AS cohort FROM e GROUP BY 1),
     s AS (SELECT cohort, count(*) AS cohort_size FROM c GROUP BY 1)
SELECT cohort, period, count(*) AS active, any_value(cohort_size) AS cohort_size,
       round(count(*) / any_value(cohort_size), 4) AS rate
FROM e JOIN c USING (user_id) JOIN s USING (cohort) GROUP BY 1, 2""")
def _(t):
    e = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("period")).distinct()
    c = e.groupBy("user_id").agg(F.min("period").alias("cohort"))
    return agg.retention(e.join(c, "user_id"), "cohort", "period", "user_id")


@query("retention_matrix_by_type", "AGG-07", """
WITH s AS (SELECT event_type AS cohort, count(DISTINCT user_id) AS cohort_size FROM events GROUP BY 1),
     a AS (SELECT event_type AS cohort, dayname(ts) AS d, count(DISTINCT user_id) AS active FROM events GROUP BY 1, 2)
SELECT s.cohort, cohort_size,
  max(round(active / cohort_size, 4)) FILTER (d = 'Monday') AS "Mon", max(round(active / cohort_size, 4)) FILTER (d = 'Tuesday') AS "Tue",
  max(round(active / cohort_size, 4)) FILTER (d = 'Wednesday') AS "Wed", max(round(active / cohort_size, 4)) FILTER (d = 'Thursday') AS "Thu",
  max(round(active / cohort_size, 4)) FILTER (d = 'Friday') AS "Fri", max(round(active / cohort_size, 4)) FILTER (d = 'Saturday') AS "Sat",
  max(round(active / cohort_size, 4)) FILTER (d = 'Sunday') AS "Sun"
FROM s JOIN a USING (cohort) GROUP BY 1, 2""")
def _(t):
    e = t.events.select(F.col("event_type").alias("cohort"), F.date_format("ts", "E").alias("period"), "user_id")
    return agg.retention_matrix(e, "cohort", "period", "user_id")


# --- duplicates, keys, concentration, cross tables -------------------------------------------------------------------

@query("duplicates_exact_documents", "AGG-12", """
SELECT min(doc_id) OVER w AS first_id, doc_id AS row_id, count(*) OVER w AS copies FROM documents
WINDOW w AS (PARTITION BY text, lang) QUALIFY count(*) OVER w > 1""")
def _(t):
    return agg.exact_duplicates(t.documents, "doc_id", ["text", "lang"])


@query("duplicate_summary_documents", "AGG-12", """
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text)
SELECT sum(n)::BIGINT AS total_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows,
       round((sum(n) - count(*)) / sum(n) * 100, 2) AS duplicate_pct, count(*) FILTER (n > 1) AS duplicate_groups FROM g""")
def _(t):
    return agg.duplicate_summary(t.documents, ["text"])


_CONV = ["conv_id", "turn", "role", "text"]


def _key_sql(cols) -> str:
    names = ",".join(cols)
    distinct = f"count(DISTINCT ({names}))" if len(cols) > 1 else f"count(DISTINCT {names})"
    return f"SELECT '{names}' AS columns, {len(cols)}::BIGINT AS n_columns, {distinct} AS n_distinct, true AS is_key FROM conversations HAVING {distinct} = count(*) AND " + " AND ".join(f"count({c}) = count(*)" for c in cols)


@query("natural_keys_conversations", "AGG-13", " UNION ALL ".join(_key_sql(k) for k in [*[(c,) for c in _CONV], *combinations(_CONV, 2)]))
def _(t):
    return agg.natural_keys(t.conversations.select(*_CONV)).where("is_key")


@query("concentration_balances", "AGG-14", """
WITH u AS (SELECT 'c_acctbal' AS "column", c_acctbal AS v FROM customer WHERE c_acctbal > 0
           UNION ALL SELECT 's_acctbal', s_acctbal FROM supplier WHERE s_acctbal > 0
           UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders WHERE o_totalprice > 0),
r AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v DESC) AS rn,
             count(*) OVER (PARTITION BY "column") AS n FROM u)
SELECT "column", max(n) AS n,
  round(sum(v) FILTER (rn <= greatest(n // 10, 1)) / sum(v), 4) AS top10_share,
  round(sum(v) FILTER (rn <= greatest(n // 5, 1)) / sum(v), 4) AS top20_share FROM r GROUP BY 1""")
def _(t):
    parts = [(t.customer, "c_acctbal"), (t.supplier, "s_acctbal"), (t.orders, "o_totalprice")]
    outs = [agg.concentration(d.where(F.col(c) > 0), [c]) for d, c in parts]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("dominance_entropy_orders", "AGG-15", """
WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS p FROM c)
SELECT "column", count(*) AS levels, round(max(p), 4) AS top_share, max(p) > 0.7 AS dominant,
       round(-sum(p * log2(p)), 4) AS entropy FROM p GROUP BY 1""")
def _(t):
    return agg.dominance_and_entropy(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("crosstab_part_brand_type", "AGG-17", """
WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
     y AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
     g AS (SELECT CASE WHEN p_brand IN (FROM b) THEN p_brand ELSE '(Other)' END AS row,
                  CASE WHEN p_type IN (FROM y) THEN p_type ELSE '(Other)' END AS col FROM part),
     c AS (SELECT row, col, count(*) AS value FROM g GROUP BY 1, 2),
     f AS (SELECT row, col, coalesce(value, 0) AS value
           FROM (SELECT DISTINCT row FROM c) CROSS JOIN (SELECT DISTINCT col FROM c) LEFT JOIN c USING (row, col))
SELECT row, col, value, round(value / sum(value) OVER (PARTITION BY row) * 100, 1) AS row_pct FROM f""")
def _(t):
    return agg.crosstab(t.part, "p_brand", "p_type")


# --- dashboard over a run table (orders as runs of a customer's project) and an audit table (events) ------------------

@query("activity_funnel", "AGG-16", """
SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("activity_rates", "AGG-16", """
WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS first_view,
                  min(ts) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY 1)
SELECT count(*) AS users, count(first_purchase) AS activated,
       round(count(first_purchase) / count(*), 4) AS activation_rate,
       round(avg(epoch_us(first_purchase) - epoch_us(first_view)) / 3.6e9, 2) AS mean_hours_to_event
FROM u""")
def _(t):
    u = t.events.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("v"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("p"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return u.agg(
        F.count(F.lit(1)).alias("users"), F.count("p").alias("activated"),
        F.round(F.count("p") / F.count(F.lit(1)), 4).alias("activation_rate"),
        F.round(F.avg(us("p") - us("v")) / 3.6e9, 2).alias("mean_hours_to_event"))


@query("dashboard_counts", "AGG-16", """
SELECT (SELECT count(*) FROM customer) AS total_projects, (SELECT count(*) FROM lineitem) AS total_files,
       (SELECT count(*) FROM orders) AS total_analyses,
       (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS ready_projects""")
def _(t):
    n = F.count(F.lit(1))
    return t.orders.agg(
        n.alias("total_analyses"),
        F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("ready_projects"),
    ).select("*", t.customer.agg(n).scalar().alias("total_projects"), t.lineitem.agg(n).scalar().alias("total_files"))


@query("run_detail", "AGG-18", """
SELECT event_id AS run_id, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'health_result') AS has_health,
       round(date_diff('microsecond', date_trunc('day', ts), ts) / 1e6, 3) AS duration_seconds FROM events""")
def _(t):
    keys = F.json_object_keys("props")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.events.select(
        F.col("event_id").alias("run_id"), F.array_contains(keys, "k").alias("has_k"),
        F.array_contains(keys, "health_result").alias("has_health"),
        F.round((us(F.col("ts")) - us(F.date_trunc("day", "ts"))) / 1e6, 3).alias("duration_seconds"))


# --- filters, search, paging, features --------------------------------------------------------------------------------

@query("column_filters_orders", "FLT-01", """
SELECT * FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice >= 150000 AND contains(lower(o_orderpriority), 'high')
  AND o_custkey IS NOT NULL AND o_orderkey != 7 AND o_totalprice < 450000.5""")
def _(t):
    return flt.apply_filters(t.orders, [
        {"col": "o_orderstatus", "op": "eq", "value": "f"}, {"col": "o_totalprice", "op": "gte", "value": "150000"},
        {"col": "o_orderpriority", "op": "contains", "value": "HIGH"}, {"col": "o_custkey", "op": "not_null"},
        {"col": "o_orderkey", "op": "neq", "value": "7"}, {"col": "o_totalprice", "op": "lt", "value": "450000.5"},
        {"col": "o_totalprice", "op": "gt", "value": "not a number"}, {"col": "missing", "op": "eq", "value": "1"}])


@query("search_parts", "FLT-02", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""")
def _(t):
    return flt.search(t.part, " RING ").select("p_partkey", "p_name", "p_brand", "p_type")


_META = lambda table, cols: " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) / count(*) * 100, 1) AS null_pct, count(DISTINCT {c}) AS n_unique,
        {f'min({c})::DOUBLE' if k in ('integer', 'float') else 'NULL::DOUBLE'} AS min,
        {f'max({c})::DOUBLE' if k in ('integer', 'float') else 'NULL::DOUBLE'} AS max,
        {f'round(avg({c}), 4)' if k in ('integer', 'float') else 'NULL::DOUBLE'} AS mean FROM {table}"""
    for c, k in cols)


@query("column_metadata_orders", "FLT-03 SRC-15", _META("orders", [
    ("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "text"), ("o_totalprice", "float"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "text")]))
def _(t):
    return flt.column_metadata(t.orders)


@query("derived_column_orders", "FLT-04 FUN-03 FUN-04", """
SELECT o_orderkey, round(ln(1 + o_totalprice) / (o_custkey + 1), 6) AS f1,
       floor(sqrt(o_totalprice)) + ceil(o_custkey / 7.0::DOUBLE) AS f2,
       round(abs(sin(o_custkey)) * log2(o_totalprice), 4) AS f3 FROM orders""")
def _(t):
    d = flt.reapply(t.orders, [
        ("f1", "round(log1p(o_totalprice) / (o_custkey + 1), 6)"),
        ("f2", "floor(sqrt(o_totalprice)) + ceil(o_custkey / 7)"),
        ("f3", "round(abs(sin(o_custkey)) * log2(o_totalprice), 4)")])
    return d.select("o_orderkey", "f1", F.col("f2").cast("double").alias("f2"), "f3")


@query("derived_column_stats", "FLT-04", """
WITH f AS (SELECT l_extendedprice * (1 - l_discount) / l_quantity AS unit FROM lineitem)
SELECT count(*) - count(unit) AS null_count, round(avg(unit), 4) AS mean, round(stddev_samp(unit), 4) AS std,
       round(min(unit), 4) AS min, round(max(unit), 4) AS max FROM f""")
def _(t):
    return flt.feature_stats(flt.derive(t.lineitem, "unit", "l_extendedprice * (1 - l_discount) / l_quantity"), "unit")


@query("feature_suggestions_lineitem", "FLT-05", """
SELECT * FROM (VALUES
 ('l_quantity_per_l_extendedprice', 'l_quantity / (l_extendedprice + 1e-9)', 'ratio'),
 ('l_extendedprice_per_l_quantity', 'l_extendedprice / (l_quantity + 1e-9)', 'ratio')) AS v(name, formula, category)
WHERE (SELECT count(*) FILTER (l_extendedprice = 0) / count(*) < 0.1 AND avg(l_extendedprice) != 0 FROM lineitem)
  AND name = 'l_quantity_per_l_extendedprice'
UNION ALL SELECT 'l_shipdate_month', 'month(l_shipdate)', 'datetime'
UNION ALL SELECT 'l_shipdate_dayofweek', 'dayofweek(l_shipdate)', 'datetime'""")
def _(t):
    return flt.suggest_features(t.lineitem.select("l_quantity", "l_extendedprice", "l_shipdate"))


@query("calendar_features_orders", "FLT-06 FUN-02", """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_day_of_week,
  quarter(o_orderdate) AS o_orderdate_quarter, (isodow(o_orderdate) >= 6)::BIGINT AS o_orderdate_is_weekend FROM orders""")
def _(t):
    return flt.calendar_features(t.orders.select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@query("id_like_columns", "FLT-07", """
SELECT "column", round(u / n * 100, 2) AS unique_pct, contains(lower("column"), 'id') AND u / n > 0.95 AS id_like FROM (
  SELECT count(*) AS n, count(DISTINCT event_id) AS event_id, count(DISTINCT ts) AS ts, count(DISTINCT user_id) AS user_id,
    count(DISTINCT event_type) AS event_type, count(DISTINCT value) AS value, count(DISTINCT props) AS props FROM events)
UNPIVOT (u FOR "column" IN (event_id, ts, user_id, event_type, value, props))""")
def _(t):
    return flt.id_like(t.events)


@query("range_validity_discount", "FLT-08", """
SELECT count(*) FILTER (l_discount BETWEEN 0.01 AND 0.08) AS valid, count(*) FILTER (NOT l_discount BETWEEN 0.01 AND 0.08) AS excluded,
       round(avg(l_discount) FILTER (l_discount BETWEEN 0.01 AND 0.08), 4) AS mean_valid FROM lineitem""")
def _(t):
    return flt.within_range(t.lineitem, "l_discount", 0.01, 0.08)


@query("sorted_customers", "SRT-01", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def _(t):
    return flt.sort_rows(t.customer, "c_acctbal", "c_custkey", descending=True).select("c_custkey", "c_acctbal")


@query("data_table_filter_page", "SRT-02 FLT-01", """
WITH f AS (SELECT * FROM orders WHERE o_totalprice > 200000), n AS (SELECT count(*) AS n FROM f)
SELECT o_orderkey, o_totalprice, n AS total_rows, ceil(n / 50.0)::BIGINT AS total_pages, 3::BIGINT AS page FROM (
  SELECT * FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100), n""")
def _(t):
    rows = flt.apply_filters(t.orders, [{"col": "o_totalprice", "op": "gt", "value": "200000"}])
    return flt.page(rows, "o_totalprice", "o_orderkey", 3, 50, descending=True).select(
        "o_orderkey", "o_totalprice", "total_rows", "total_pages", "page")


@query("top_customers", "SRT-03 SRT-04", """
SELECT trim(c_name) AS label, c_acctbal AS value FROM customer WHERE c_acctbal IS NOT NULL AND trim(c_name) <> ''
ORDER BY c_acctbal DESC, c_name LIMIT 10""")
def _(t):
    from gridloom.operators.charts import leaderboard
    return leaderboard(t.customer, "c_name", "c_acctbal", 10)


@query("top_values_and_other", "SRT-06", """
WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn FROM c)
SELECT CASE WHEN rn <= 8 THEN v ELSE 'Other' END AS label, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def _(t):
    from gridloom.operators.charts import top_values
    return top_values(t.part, "p_brand", 8)


@query("hash_sample_orders", "SRT-05", """
SELECT * FROM orders WHERE CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT)""")
def _(t):
    from gridloom.operators.sampling import hash_sample
    return hash_sample(t.orders, "o_orderkey", 0.2, seed=42)


@query("preview_rows", "SRC-14", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def _(t):
    return t.part.orderBy("p_partkey").limit(10)


@query("table_summary_documents", "SRC-16", """
SELECT count(*) AS rows, 5::BIGINT AS columns, 2::BIGINT AS numeric_columns, 3::BIGINT AS categorical_columns,
  0::BIGINT AS datetime_columns,
  round((count(*) * 5 - count(doc_id) - count(text) - count(lang) - count(source) - count(n_chars)) / (count(*) * 5) * 100, 2) AS missing_pct
FROM documents""")
def _(t):
    return flt.table_summary(t.documents)


@query("column_kinds_events", "SRC-17", """
SELECT c AS "column", c IN ('event_id', 'user_id', 'value') AS numeric, c IN ('event_type', 'props', 'day_text') AS categorical,
  c = 'ts' OR (c = 'day_text' AND (SELECT count(try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')) / count(*) >= 0.6 FROM events)) AS datetime
FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'day_text']) AS c)""")
def _(t):
    return flt.column_kinds(t.events.withColumn("day_text", F.date_format("ts", "yyyy-MM-dd")))


# --- joins and sets ------------------------------------------------------------------------------------------------------

@query("join_null_safe_left", "JOIN-01", """
SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey""")
def _(t):
    return jn.join_tables(t.customer, t.orders, "c_custkey", "o_custkey", "left").select(
        "c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query("join_outer_suffix", "JOIN-01", """
SELECT c.conv_id, c.turn, c.role, md5(c.text) AS text_left, d.doc_id, md5(d.text) AS text_right, d.lang
FROM conversations c FULL JOIN documents d ON c.conv_id IS NOT DISTINCT FROM d.doc_id""")
def _(t):
    j = jn.join_tables(t.conversations, t.documents, "conv_id", "doc_id", "outer")
    return j.select("conv_id", "turn", "role", F.md5("text_left").alias("text_left"), "doc_id",
                    F.md5("text_right").alias("text_right"), "lang")


@query("join_shared_key_inner", "JOIN-01", """
SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def _(t):
    return jn.join_tables(t.documents.drop("text", "n_chars"), t.labels, "doc_id", "doc_id")


@query("join_right_status_nulls", "JOIN-01", """
WITH l AS (SELECT nullif(lang, 'en') AS k, count(*) AS docs FROM documents GROUP BY 1),
     r AS (SELECT nullif(lang, 'en') AS k, source FROM documents)
SELECT l.k AS k_left, docs, r.k AS k_right, source FROM l RIGHT JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def _(t):
    k = F.nullif("lang", F.lit("en"))
    l = t.documents.groupBy(k.alias("k_left")).agg(F.count(F.lit(1)).alias("docs"))
    return jn.join_tables(l, t.documents.select(k.alias("k_right"), "source"), "k_left", "k_right", "right")


@query("join_key_suggestions", "JOIN-02", """
SELECT 'doc_id' AS "column", count(*) AS left_values, count(r.doc_id) AS matched, round(count(r.doc_id) / count(*) * 100, 2) AS overlap_pct
FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) r USING (doc_id)""")
def _(t):
    return jn.suggest_keys(t.labels, t.documents)


_OVERLAP = """
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
     b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
     i AS (FROM a INTERSECT FROM b)"""


def _sides(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return [pairs.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AR"]


@query("row_overlap_shared_cols", "JOIN-03", f"""{_OVERLAP}
SELECT (SELECT count(*) FROM i) AS overlap, (SELECT count(*) FROM a) AS distinct_a,
       round((SELECT count(*) FROM i) / (SELECT count(*) FROM a) * 100, 2) AS pct_of_a""")
def _(t):
    return jn.row_overlap(*_sides(t))


@query("row_intersection", "SET-02", f"{_OVERLAP} FROM i")
def _(t):
    return jn.shared_rows(*_sides(t), ["l_partkey", "l_suppkey"])


@query("schema_set_difference", "SET-01", """
WITH a AS (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS c), b AS (SELECT unnest(['conv_id', 'turn', 'role', 'text']) AS c)
SELECT coalesce(a.c, b.c) AS "column", CASE WHEN b.c IS NULL THEN 'only_a' WHEN a.c IS NULL THEN 'only_b' ELSE 'shared' END AS side
FROM a FULL JOIN b ON a.c = b.c""")
def _(t):
    return jn.schema_sets(flt.distinct_counts(t.documents, t.documents.columns),
                          flt.distinct_counts(t.conversations, t.conversations.columns))


@query("latest_run_join", "JOIN-04", """
SELECT c_custkey, max(o_orderdate) AS latest_run_at, max(o_orderkey) AS latest_run_id
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def _(t):
    return jn.latest_per_owner(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "o_orderkey", "o_orderdate")


_DIFF_SIDES = """
WITH a AS (SELECT DISTINCT lower(trim(p_name)) AS key FROM part WHERE p_type = 'ECONOMY'),
     b AS (SELECT DISTINCT lower(trim(p_name)) AS key FROM part WHERE p_type = 'SMALL')"""


@query("finding_diff", "JOIN-05", f"""{_DIFF_SIDES}
SELECT key, 'new' AS state FROM b WHERE key NOT IN (FROM a) UNION ALL SELECT key, 'resolved' FROM a WHERE key NOT IN (FROM b)
UNION ALL SELECT key, 'unchanged' FROM b WHERE key IN (FROM a)""")
def _(t):
    return jn.finding_diff(t.part.where("p_type = 'ECONOMY'"), t.part.where("p_type = 'SMALL'"), "p_name")


@query("profile_column_diff", "JOIN-06", """
WITH a AS (SELECT count(DISTINCT text) AS text, count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM documents),
     b AS (SELECT count(DISTINCT text) AS text, count(DISTINCT role) AS role FROM conversations)
SELECT 'lang' AS "column", 'removed' AS state, NULL AS fields UNION ALL SELECT 'source', 'removed', NULL
UNION ALL SELECT 'role', 'added', NULL
UNION ALL SELECT 'text', CASE WHEN a.text = b.text THEN 'same' ELSE 'changed' END, CASE WHEN a.text = b.text THEN '' ELSE 'n_unique' END FROM a, b""")
def _(t):
    def side(d, cols):
        return flt.column_metadata(d.select(*cols)).select("column", "dtype", "null_pct", "n_unique")
    return jn.profile_diff(side(t.documents, ["text", "lang", "source"]), side(t.conversations, ["text", "role"]),
                           ["dtype", "null_pct", "n_unique"])


# --- two-table comparison ------------------------------------------------------------------------------------------------

def _halves(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return (t.lineitem.where("l_shipdate < timestamp_ntz'2000-01-01'").select(*cols),
            t.lineitem.where("l_shipdate >= timestamp_ntz'2000-01-01'").select(*cols))


def _cmp_sql(c):
    return f"""SELECT '{c}' AS "column", round(am, 4) AS a_mean, round(asd, 4) AS a_std, round(amed, 4) AS a_median,
      round(bm, 4) AS b_mean, round(bsd, 4) AS b_std, round(bmed, 4) AS b_median,
      round((bm - am) / abs(am) * 100, 2) AS mean_diff_pct,
      CASE WHEN am = 0 THEN 'no_data' WHEN abs(round((bm - am) / abs(am) * 100, 2)) > 20 THEN 'significant'
           WHEN abs(round((bm - am) / abs(am) * 100, 2)) >= 5 THEN 'notable' ELSE 'stable' END AS change_flag
    FROM (SELECT avg({c}) FILTER (a) AS am, stddev_samp({c}) FILTER (a) AS asd, median({c}) FILTER (a) AS amed,
                 avg({c}) FILTER (NOT a) AS bm, stddev_samp({c}) FILTER (NOT a) AS bsd, median({c}) FILTER (NOT a) AS bmed
          FROM (SELECT *, l_shipdate < '2000-01-01' AS a FROM lineitem))"""


@query("compare_columns_by_period", "AGG-08 AGG-10",
       " UNION ALL ".join(_cmp_sql(c) for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    return cmp.compare_columns(*_halves(t))


@query("aligned_histograms", "AGG-09", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT 'l_extendedprice' AS "column", (least(floor((l_extendedprice - lo) / ((hi - lo) / 11)), 10) + 1)::BIGINT AS bin,
  count(*) FILTER (l_shipdate < '2000-01-01') AS a_count, count(*) FILTER (l_shipdate >= '2000-01-01') AS b_count
FROM lineitem, s GROUP BY 2""")
def _(t):
    return cmp.aligned_histograms(*_halves(t), ["l_extendedprice"])


@query("comparison_cautions", "AGG-10", """
WITH v AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS b FROM orders),
r AS (SELECT (b - a) / a * 100 AS d FROM v)
SELECT 'large_volume_drop' AS kind, 'high' AS severity, NULL::VARCHAR AS "column", 0::BIGINT AS rank FROM r WHERE d < -20
UNION ALL SELECT 'large_volume_spike', 'medium', NULL, 1 FROM r WHERE d > 50
UNION ALL SELECT 'low_row_overlap', 'medium', NULL, 1
UNION ALL SELECT 'columns_removed', 'high', NULL, 0 UNION ALL SELECT 'columns_added', 'low', NULL, 2
UNION ALL SELECT 'significant_metric_shift', 'medium', 'o_totalprice', 1 FROM (
  SELECT avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS b FROM orders)
  WHERE abs(round((b - a) / a * 100, 2)) > 20""")
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").drop("o_orderpriority")
    b = t.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_orderstatus", "status").drop("o_orderpriority")
    n = F.count(F.lit(1))
    ids = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    volume = jn.row_overlap(a, b, ids).select(
        F.col("pct_of_a").alias("overlap_pct"), a.agg(n).scalar().alias("count_a"), b.agg(n).scalar().alias("count_b"))
    names = lambda d: flt.distinct_counts(d, d.columns)
    health = volume.select(F.lit(90.0).alias("score_a"), F.lit(90.0).alias("score_b"))
    deltas = cmp.compare_columns(a.select("o_totalprice"), b.select("o_totalprice"))
    return cmp.caution_flags(volume, deltas, jn.schema_sets(names(a), names(b)), health)


@query("run_metric_deltas", "AGG-11", """
WITH m AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS rows, round(avg(o_totalprice), 2) AS mean_price,
                  count(DISTINCT o_custkey)::DOUBLE AS customers FROM orders GROUP BY 1),
u AS (UNPIVOT m ON rows, mean_price, customers INTO NAME name VALUE v),
d AS (SELECT a.name, a.v AS a, b.v AS b, round(b.v - a.v, 2) AS delta FROM u a JOIN u b USING (name) WHERE a.s = 'F' AND b.s = 'O')
SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'unchanged' END AS direction FROM d""")
def _(t):
    def run(status):
        m = t.orders.where(F.col("o_orderstatus") == status).agg(
            F.count(F.lit(1)).cast("double").alias("rows"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"),
            F.count_distinct("o_custkey").cast("double").alias("customers"))
        return m.unpivot([], ["rows", "mean_price", "customers"], "name", "value")
    return cmp.metric_deltas(run("F"), run("O"))


# --- ad-hoc SQL and scalar functions ---------------------------------------------------------------------------------------

@query("adhoc_sql", "QRY-01", """
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mon, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, strftime(mon, '%Y-%m') AS month, v::DOUBLE AS v, rank() OVER (PARTITION BY mon ORDER BY v DESC) AS rk FROM m
QUALIFY rk = 1""")
def _(t):
    return adhoc.run_sql(t.orders, """
      WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mon, sum(cast(o_totalprice AS decimal(18,2))) AS v
                 FROM data GROUP BY ALL)
      SELECT o_custkey, month, v, rk FROM (
        SELECT o_custkey, date_format(mon, 'yyyy-MM') AS month, cast(v AS double) AS v,
               cast(rank() OVER (PARTITION BY mon ORDER BY v DESC) AS bigint) AS rk FROM m)
      WHERE rk = 1""", view="data")


@query("string_functions", "FUN-01", """
SELECT doc_id, lower(source) AS lo, upper(lang) AS up, trim('  ' || lang || ' ') AS tr, contains(text, 'the') AS has,
  starts_with(source, 'src1') AS st, length(source) AS len, string_split(source, 'c')[2] AS part,
  regexp_matches(source, '^src[0-9]$') AS rx, regexp_replace(source, '[0-9]+', '#', 'g') AS rr, md5(source) AS h FROM documents""")
def _(t):
    c = F.col("source")
    return t.documents.select(
        "doc_id", F.lower(c).alias("lo"), F.upper("lang").alias("up"), F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("tr"),
        F.col("text").contains("the").alias("has"), c.startswith("src1").alias("st"), F.length(c).cast("bigint").alias("len"),
        F.split(c, "c")[1].alias("part"), c.rlike("^src[0-9]$").alias("rx"), F.regexp_replace(c, "[0-9]+", "#").alias("rr"),
        F.md5(c).alias("h"))
