"""Queries of ranking, domain packs and charts. Findings and charts are derived from the orders of each customer (a run)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import query
from gridloom.operators import charts as ch, insights, ranking as rk, snapshot as sn

_TYPE = {"1-URGENT": "anomaly", "2-HIGH": "correlation", "3-MEDIUM": "segment", "4-NOT SPECIFIED": "trend", "5-LOW": "data_quality"}
_SEV = {"F": "high", "O": "medium", "P": "low"}


def _findings(t):
    o = t.orders
    month = F.date_format("o_orderdate", "MM")
    typ, sev = rk._pick(F.col("o_orderpriority"), _TYPE, "x"), rk._pick(F.col("o_orderstatus"), _SEV, "low")
    price = F.col("o_orderstatus") == "F"
    cols = F.when(typ == "correlation", F.array(F.when(price, F.lit("Open")).otherwise(F.concat(F.lit("m"), month)), F.lit("day_high"))).otherwise(
        F.array(F.concat(F.lit("m"), month)))
    return o.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), typ.alias("type"), sev.alias("severity"), F.round(F.col("o_totalprice") / 5000, 2).alias("confidence"),
        F.concat_ws(" ", typ, F.lit("in"), month).alias("title"), F.when(typ == "correlation", F.array(F.when(price, F.lit("Open")).otherwise(F.concat(F.lit("m"), month)), F.lit("dayHigh"))).otherwise(
            F.array(F.concat(F.lit("m"), month))).alias("columns"), (F.col("o_totalprice") > 400000).alias("is_target_driver"), F.lit(None).cast("string").alias("domain"))


_F = """f AS (SELECT o_custkey AS run_id, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'anomaly' WHEN '2-HIGH' THEN 'correlation' WHEN '3-MEDIUM' THEN 'segment' WHEN '4-NOT SPECIFIED' THEN 'trend' ELSE 'data_quality' END AS type,
 CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS severity, round(o_totalprice / 5000, 2) AS confidence, strftime(o_orderdate, '%m') AS m, o_orderstatus = 'F' AS price, o_totalprice > 400000 AS is_target_driver FROM orders),
g AS (SELECT *, type || ' in ' || m AS title, CASE WHEN type = 'correlation' THEN CASE WHEN price THEN 'dayhigh|open' ELSE 'dayhigh|m' || m END ELSE 'm' || m END AS key,
 least(1.0, CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END::DOUBLE * 0.5 + confidence / 100 * 0.25 + CASE WHEN is_target_driver THEN 0.3 ELSE 0 END::DOUBLE * 0.25)::DOUBLE AS score FROM f)"""


@query("insight_rank_cap", "RNK-02 RNK-03", f"""WITH {_F}, u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY run_id, type, key ORDER BY score DESC, seq) = 1)
SELECT run_id, seq, title, round(score, 6) AS score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq) AS rank FROM u QUALIFY rank <= 15""")
def _(t):
    return rk.rank_findings(_findings(t), limit=rk.CAP).select("run_id", "seq", "title", F.round("score", 6).alias("score"), "rank")


@query("insight_dedupe", "RNK-02", f"WITH {_F} SELECT run_id, seq, type FROM g QUALIFY row_number() OVER (PARTITION BY run_id, type, key ORDER BY seq) = 1")
def _(t):
    return rk.deduplicate(_findings(t)).select("run_id", "seq", "type")


@query("insight_suppression_finance", "RNK-01", f"""WITH {_F},
gone AS (SELECT *, type = 'correlation' AND price AS overlap FROM g), c AS (SELECT run_id, count(*) FILTER (overlap) AS n, max(seq) + 1 AS seq FROM gone GROUP BY 1 HAVING count(*) FILTER (overlap) >= 2)
SELECT run_id, seq, type, title FROM gone WHERE NOT overlap AND type <> 'trend' UNION ALL SELECT run_id, seq, 'multicollinearity', 'Price fields are highly overlapping' FROM c""")
def _(t):
    return rk.suppress_redundant(_findings(t), rk.SNAPSHOT).select("run_id", "seq", "type", "title")


@query("insight_rank_snapshot", "RNK-03 RNK-01", f"""WITH {_F},
s AS (SELECT *, CASE WHEN type = 'correlation' THEN 4 ELSE 3 END AS tier, CASE WHEN type = 'correlation' THEN score * 0.52 ELSE score END AS sc FROM g),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run_id, type, key ORDER BY seq) = 1)
SELECT run_id, seq, round(sc, 6) AS score, row_number() OVER (PARTITION BY run_id ORDER BY tier, sc DESC, seq) AS rank FROM u QUALIFY rank <= 45""")
def _(t):
    return rk.rank_findings(_findings(t), rk.SNAPSHOT, rk.CANDIDATES).select("run_id", "seq", F.round("score", 6).alias("score"), "rank")


def _plan(t):
    runs = t.orders.select(F.col("o_custkey").alias("run_id")).distinct()
    return runs.select("run_id", F.explode(F.array(
        F.struct(F.lit("m01").alias("column"), F.lit("ignore").alias("use")), F.struct(F.lit("M 02").alias("column"), F.lit("ignore").alias("use")),
        F.struct(F.lit("ship").alias("column"), F.lit("time").alias("use")))).alias("s")).select("run_id", "s.*")


def _dated(t):
    f = _findings(t)
    part = F.array(F.when(F.col("type") == "segment", "ship_month").when(F.col("type") == "trend", "ship_week"))
    return f.withColumn("columns", F.when(F.col("type").isin("segment", "trend"), F.concat("columns", part)).otherwise(
        F.transform("columns", lambda c: F.regexp_replace(c, "m02", "m_02"))))


_PEN = f"""WITH {_F}, p AS (SELECT *, CASE WHEN type = 'anomaly' AND m IN ('01', '02') OR type = 'data_quality' AND m IN ('01', '02') THEN 'ignored_column'
  WHEN type IN ('segment', 'trend') THEN 'date_part_feature' END AS penalty FROM g),
q AS (SELECT *, confidence * CASE penalty WHEN 'ignored_column' THEN 0.4 WHEN 'date_part_feature' THEN 0.35 ELSE 1 END::DOUBLE AS c2 FROM p),
z AS (SELECT *, least(1.0, CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END::DOUBLE * 0.5 + c2 / 100 * 0.25 + CASE WHEN is_target_driver THEN 0.3 ELSE 0 END::DOUBLE * 0.25)::DOUBLE AS s2 FROM q)"""


@query("insight_plan_penalties", "RNK-04", f"{_PEN} SELECT run_id, seq, penalty, round(c2, 4) AS confidence, penalty IS NOT NULL AS suppressed FROM z")
def _(t):
    return rk.plan_penalties(_dated(t), _plan(t)).select("run_id", "seq", "penalty", F.round("confidence", 4).alias("confidence"), "suppressed")


def _penalised(t):
    return rk.plan_penalties(_dated(t), _plan(t))


@query("insight_rerank", "RNK-04", f"{_PEN} SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY (penalty IS NOT NULL)::INT, s2 DESC, seq) AS rank FROM z QUALIFY rank <= 15")
def _(t):
    return rk.rerank(_penalised(t), limit=rk.CAP).select("run_id", "seq", "rank")


def _risks(t):
    runs = t.orders.select(F.col("o_custkey").alias("run_id")).distinct()
    rows = [("m03", "constant_columns"), ("m04", "high_cardinality_dimensions"), ("m05", "possible_leakage"), ("m05", "target_leakage_risk"), ("dayHigh", "date_part_artifacts")]
    return runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("risk")) for c, r in rows])).alias("s")).select("run_id", "s.*")


_PROF = f"""WITH {_F}, p AS (SELECT *, (CASE WHEN m = '03' AND NOT (type = 'correlation' AND price) THEN 0.3 ELSE 1 END * CASE WHEN m = '04' AND type = 'segment' THEN 0.5 ELSE 1 END
 * CASE WHEN m = '05' AND NOT (type = 'correlation' AND price) THEN 0.25 ELSE 1 END * CASE WHEN type = 'correlation' THEN 0.35 ELSE 1 END)::DOUBLE AS fac FROM g)"""


@query("insight_profile_penalties", "RNK-04", f"{_PROF} SELECT run_id, seq, fac < 1 AS profile_suppressed, round(confidence * fac, 8) AS new_confidence FROM p")
def _(t):
    return rk.profile_penalties(_findings(t), _risks(t)).select("run_id", "seq", "profile_suppressed", F.round("new_confidence", 8).alias("new_confidence"))


@query("insight_penalty_gate", "RNK-05", f"""{_PROF}, h AS (SELECT run_id, count(*) AS findings, count(*) FILTER (fac < 1) AS penalised, max(confidence - confidence * fac) AS d FROM p GROUP BY 1)
SELECT run_id, findings, penalised, round(penalised / findings, 4) AS share, round(d, 8) AS largest_drop,
 CASE WHEN penalised / findings >= 0.5 THEN 'too_many_penalised' WHEN d >= 60 THEN 'drop_too_large' ELSE 'ok' END AS verdict FROM h""")
def _(t):
    return rk.penalty_gate(rk.profile_penalties(_findings(t), _risks(t))).withColumn("largest_drop", F.round("largest_drop", 8))


_RR = f"{_PEN}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (penalty IS NOT NULL)::INT, s2 DESC, seq) AS rank FROM z QUALIFY rank <= 15)"


@query("insight_executive_split", "RNK-06", f"""{_RR}, e AS (SELECT * FROM r WHERE penalty IS NULL AND c2 >= 50),
s AS (SELECT run_id, rank, title, 'opportunity' AS side, 4 AS room FROM e WHERE type IN ('correlation', 'segment', 'trend') AND severity <> 'low'
 UNION ALL SELECT run_id, rank, title, 'risk', 4 FROM e WHERE type IN ('anomaly', 'data_quality') AND severity <> 'low' UNION ALL SELECT run_id, rank, title, 'action', 5 FROM e)
SELECT run_id, side, row_number() OVER (PARTITION BY run_id, side ORDER BY rank) AS place, title FROM s QUALIFY place <= room""")
def _(t):
    return rk.executive_split(rk.rerank(_penalised(t), limit=rk.CAP))


@query("insight_selection_counters", "RNK-07", f"""{_RR}, a AS (SELECT run_id, count(*) AS candidates, count(*) FILTER (penalty IS NOT NULL) AS suppressed_candidates FROM z GROUP BY 1)
SELECT run_id, any_value(candidates) AS candidates, any_value(suppressed_candidates) AS suppressed_candidates, count(*) AS visible, count(*) FILTER (penalty IS NOT NULL) AS suppressed_visible,
 count(*) FILTER (penalty IS NULL AND c2 >= 50) AS eligible_visible FROM r JOIN a USING (run_id) GROUP BY 1""")
def _(t):
    p = _penalised(t)
    return rk.selection_counters(p, rk.rerank(p, limit=rk.CAP))


_IDS = f"""{_RR}, i AS (SELECT *, CASE WHEN type = 'correlation' THEN CASE WHEN price THEN 'Open|dayHigh' ELSE 'dayHigh|m' || CASE WHEN m = '02' THEN '_02' ELSE m END END
  WHEN type = 'segment' THEN 'm' || m || '|ship_month' WHEN type = 'trend' THEN 'm' || m || '|ship_week' ELSE 'm' || CASE WHEN m = '02' THEN '_02' ELSE m END END AS ck FROM r),
k AS (SELECT *, md5(type || ':' || ck || ':' || title)[1:12] AS bid FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY run_id, bid ORDER BY seq) AS rn FROM k),
d AS (SELECT *, CASE WHEN rn = 1 THEN bid ELSE bid || '_' || rn END AS insight_id, severity <> 'low' AND round(c2 / 100, 4) >= 0.6 AND type <> 'data_quality' AND penalty IS NULL AS report_safe FROM n)"""


@query("insight_ids", "RNK-07", f"{_IDS} SELECT run_id, seq, insight_id, report_safe FROM d")
def _(t):
    return rk.finding_ids(rk.rerank(_penalised(t), limit=rk.CAP)).select("run_id", "seq", "insight_id", "report_safe")


@query("insight_default_selection", "RNK-07", f"""{_IDS}, c AS (SELECT *, count(*) FILTER (report_safe) OVER w AS ns, count(*) FILTER (type <> 'data_quality' AND severity <> 'low') OVER w AS ng FROM d WINDOW w AS (PARTITION BY run_id)),
t AS (SELECT *, CASE WHEN ns > 0 AND report_safe THEN 0 WHEN type <> 'data_quality' AND severity <> 'low' THEN 1 WHEN ns > 0 AND severity <> 'low' THEN 2 ELSE 3 END AS tier,
  CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS sv FROM c)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY tier, CASE WHEN tier IN (0, 3) THEN 0 ELSE sv END, rank) AS place, insight_id FROM t
QUALIFY place <= CASE WHEN ns > 0 THEN greatest(least(ns, 5), 3) WHEN ng = 0 THEN 5 ELSE greatest(least(ng, 5), 3) END""")
def _(t):
    return rk.default_selection(rk.finding_ids(rk.rerank(_penalised(t), limit=rk.CAP)))


# --- snapshot pack: parts as assets -----------------------------------------------------------------------------------------

_SNAP = """a AS (SELECT p_partkey AS id, p_name AS shortName, p_brand AS asset_class, p_type AS sector, r.ret AS ytd_return, r.vol AS volatility_1y, r.ret / r.vol AS sharpe_1y, r.up AS analyst_upside_pct, r.pos AS pct_of_52w_high
 FROM part JOIN (SELECT l_partkey, round(max(l_discount) - min(l_tax), 4) AS ret, stddev_samp(l_extendedprice) AS vol, avg(l_tax) AS up, max(l_quantity) / min(l_quantity) / 40 AS pos FROM lineitem GROUP BY 1 HAVING count(*) > 1) r ON p_partkey = l_partkey)"""


def _snap(t):
    r = t.lineitem.groupBy("l_partkey").agg(
        F.round(F.max("l_discount") - F.min("l_tax"), 4).alias("ytd_return"), F.stddev_samp("l_extendedprice").alias("volatility_1y"), F.avg("l_tax").alias("analyst_upside_pct"),
        (F.max("l_quantity") / F.min("l_quantity") / 40).alias("pct_of_52w_high"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("shortName"), F.col("p_brand").alias("asset_class"), F.col("p_type").alias("sector"))
    return p.join(r, F.col("id") == F.col("l_partkey")).drop("l_partkey").withColumn("sharpe_1y", F.col("ytd_return") / F.col("volatility_1y"))


def _ext(title, col, order):
    return f"""SELECT * FROM (SELECT '{title}' AS title, shortName AS asset, round({col}, 4) AS value, round(CASE WHEN (SELECT max(abs({col})) FROM a) <= 1 THEN {col} * 100 ELSE {col} END, 1) AS percent
 FROM a WHERE {col} IS NOT NULL ORDER BY {col} {order}, id LIMIT 3)"""


@query("snapshot_extremes", "DOM-01", f"WITH {_SNAP} " + " UNION ALL ".join([
    _ext("Top return leaders", "ytd_return", "DESC"), _ext("Largest return laggards", "ytd_return", "ASC"), _ext("Highest volatility assets", "volatility_1y", "DESC"),
    _ext("Best risk-adjusted performers", "sharpe_1y", "DESC"), _ext("Highest analyst-implied upside", "analyst_upside_pct", "DESC")]))
def _(t):
    return sn.snapshot_extremes(_snap(t), "id")


for _n, _c in [("class", "asset_class"), ("sector", "sector")]:
    query(f"snapshot_{_n}_returns", "DOM-02", f"""WITH {_SNAP} SELECT {_c} AS grp, count(*) AS count, round(avg(ytd_return), 4) AS average_return, round(median(ytd_return), 4) AS median_return FROM a GROUP BY 1 HAVING count(*) >= 3""")(
        lambda t, c=_c: sn.group_returns(_snap(t), c, "ytd_return"))


@query("snapshot_position_extremes", "DOM-03 FLT-08", f"""WITH {_SNAP}, s AS (SELECT CASE WHEN avg((pct_of_52w_high BETWEEN 0 AND 1)::INT) >= 0.85 OR max(pct_of_52w_high) <= 1.001 THEN 1.0 ELSE 100.0 END AS hi FROM a),
v AS (SELECT a.* FROM a, s WHERE pct_of_52w_high BETWEEN 0 AND hi), b AS (SELECT count(*) AS excluded FROM a, s WHERE NOT pct_of_52w_high BETWEEN 0 AND hi)
SELECT * FROM (SELECT 'near_high' AS title, shortName AS asset, round(pct_of_52w_high, 4) AS value FROM v ORDER BY pct_of_52w_high DESC, id LIMIT 3), b
UNION ALL SELECT * FROM (SELECT 'low_position', shortName, round(pct_of_52w_high, 4) FROM v ORDER BY pct_of_52w_high, id LIMIT 3), b""")
def _(t):
    return sn.position_extremes(_snap(t), "pct_of_52w_high", "shortName", "id")


# --- charts ---------------------------------------------------------------------------------------------------------------------

@query("chart_line_points", "CHT-01", """WITH p AS (SELECT date_trunc('day', ts) AS date, avg(value) AS y FROM events GROUP BY 1), s AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, median(y) AS med FROM p)
SELECT date, round(y, 4) AS y, abs(y - m) > 2 * sd AS is_anomaly, round(m, 4) AS mean, round(med, 4) AS median FROM (SELECT date::TIMESTAMP AS date, y FROM p), s""")
def _(t):
    return ch.line_points(t.events, "ts", "value")


@query("chart_histogram", "CHT-02", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
b AS (SELECT *, CASE WHEN n > 500 THEN 12 WHEN n > 120 THEN 10 ELSE 8 END AS k FROM s), h AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS value FROM lineitem, b GROUP BY 1)
SELECT bin, value, round(value / n, 4) AS density, lo + (bin + 0.5) * ((hi - lo) / k) < q1 - 1.5 * (q3 - q1) OR lo + (bin + 0.5) * ((hi - lo) / k) > q3 + 1.5 * (q3 - q1) AS is_anomaly_bin FROM h, b""")
def _(t):
    return ch.histogram(t.lineitem, "l_extendedprice")


@query("chart_category_bar", "CHT-03 SRT-06", """WITH c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn FROM c)
SELECT CASE WHEN rn <= 12 THEN v ELSE 'Other' END AS label, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def _(t):
    return ch.top_values(t.part, "p_name", 12)


@query("chart_pie", "CHT-03", """SELECT coalesce(toxic::VARCHAR, '(missing)') AS name, count(*) AS value, round(count(*) / (SELECT count(*) FROM documents) * 100, 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    return ch.shares(t.documents.join(t.labels, "doc_id", "left"), "toxic", 8)


@query("chart_scatter_sample", "CHT-04", """
WITH d AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / count(*)) AS sd FROM d)
SELECT row_id, x, y, round(y - a - b * x, 4) AS residual, sd > 1e-10 AND abs(y - a - b * x) > 2 * sd AS is_anomaly
FROM d, f ORDER BY md5('42:' || row_id), row_id LIMIT 300""")
def _(t):
    d = t.lineitem.withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return ch.scatter_sample(d, "row_id", "l_quantity", "l_extendedprice")


@query("chart_box_whiskers", "CHT-05", """WITH q AS (SELECT event_type AS name, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT q.*, value AS v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM events JOIN q ON event_type = name)
SELECT name, any_value(n) AS n, round(min(v) FILTER (v >= lo), 4) AS min, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3, round(max(v) FILTER (v <= hi), 4) AS max,
 least(20, count(*) FILTER (v < lo OR v > hi)) AS n_outliers, round(min(v) FILTER (v < lo OR v > hi), 4) AS lowest_outlier FROM j GROUP BY 1""")
def _(t):
    return ch.box_whiskers(t.events, "event_type", "value", ch.MAX_BOX_OUTLIERS)


_H = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("chart_heat_map", "CHT-06", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 3) AS value FROM lineitem" for a in _H for b in _H))
def _(t):
    return ch.heat_map(t.lineitem, _H)


@query("chart_finance_category_means", "CHT-07", f"WITH {_SNAP} SELECT trim(asset_class) AS label, count(*) AS count, round(avg(ytd_return), 4) AS value FROM a GROUP BY 1")
def _(t):
    return ch.category_means(_snap(t), "asset_class", "ytd_return")


@query("chart_finance_leaderboard", "CHT-07 SRT-04", """SELECT trim(c_name) AS label, c_acctbal AS value FROM customer ORDER BY c_acctbal, c_name LIMIT 10""")
def _(t):
    return ch.leaderboard(t.customer, "c_name", "c_acctbal", 10, descending=False)


@query("chart_pooled_return_histogram", "CHT-07", """WITH p AS (SELECT l_partkey AS s, l_shipdate AS d, avg(l_extendedprice / l_quantity) AS px FROM lineitem GROUP BY 1, 2),
r AS (SELECT ln(px / lag(px) OVER (PARTITION BY s ORDER BY d)) AS r FROM p), z AS (SELECT min(r) AS lo, max(r) AS hi FROM r)
SELECT least(floor((r - lo) / ((hi - lo) / 12)), 11)::BIGINT AS bin, count(*) AS value FROM r, z WHERE r IS NOT NULL GROUP BY 1""")
def _(t):
    from gridloom.operators import panel as pn
    d = t.lineitem.groupBy("l_partkey", "l_shipdate").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    r = pn.with_returns(pn.panel(d, "l_partkey", "l_shipdate", "px"))
    return ch.pooled_histogram(r.withColumn("ret", F.ln(F.col("ret") + 1)), "ret")


def _charts(t):
    typ = rk._pick(F.col("o_orderpriority"), {"1-URGENT": "line", "2-HIGH": "histogram", "3-MEDIUM": "bar", "4-NOT SPECIFIED": "pie"}, "boxplot")
    month = F.concat(F.lit("m"), F.date_format("o_orderdate", "MM"))
    return t.orders.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), typ.alias("type"), F.concat_ws(" of ", typ, month).alias("title"), month.alias("x_label"),
        F.when(typ == "line", F.lit("revenue")).otherwise(F.lit("Count")).alias("y_label"), rk._pick(typ, ch.BASE_SCORES, 5.0).alias("score"))


def _chart_plan(t):
    runs = t.orders.select(F.col("o_custkey").alias("run_id")).distinct()
    uses = [("m01", "ignore"), ("m02", "target"), ("m03", "dimension"), ("revenue", "target"), ("m04", "time")]
    return runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(u).alias("use")) for c, u in uses])).alias("s")).select("run_id", "s.*")


_CH = """c AS (SELECT o_custkey AS run_id, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'line' WHEN '2-HIGH' THEN 'histogram' WHEN '3-MEDIUM' THEN 'bar' WHEN '4-NOT SPECIFIED' THEN 'pie' ELSE 'boxplot' END AS type, 'm' || strftime(o_orderdate, '%m') AS x FROM orders),
s AS (SELECT *, CASE type WHEN 'line' THEN 9.0 WHEN 'histogram' THEN 8.0 WHEN 'bar' THEN 6.0 WHEN 'pie' THEN 5.0 ELSE 7.0 END::DOUBLE AS b, type = 'line' OR x = 'm02' AS tg FROM c),
z AS (SELECT *, CASE WHEN x = 'm01' AND type <> 'line' THEN b * 0.4 ELSE b + CASE WHEN tg AND x = 'm03' THEN 1.5 WHEN tg AND x = 'm04' THEN 1.2 WHEN tg THEN 0.8 WHEN x = 'm03' THEN 0.3 ELSE 0 END END::DOUBLE AS score FROM s)"""


@query("chart_candidates_ranked", "CHT-08", f"""WITH {_CH}, u AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY run_id, type, x ORDER BY score DESC, seq) = 1)
SELECT run_id, seq, type, round(score, 4) AS score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq) AS rank FROM u QUALIFY rank <= 10""")
def _(t):
    return ch.rank_charts(ch.chart_scores(_charts(t), _chart_plan(t)), ch.MAX_CHARTS).select("run_id", "seq", "type", F.round("score", 4).alias("score"), "rank")


# --- findings of real tables ---------------------------------------------------------------------------------------------


def _labelled(t):
    return t.documents.join(t.labels, "doc_id", "left").withColumn("stops", F.length(F.regexp_replace("text", "[^.]", "")).cast("bigint"))


_NUMS, _CATS = ["n_chars", "quality", "toxic", "stops"], ["quality", "toxic", "lang", "source"]


def _single(c):
    """Outlier, skewness and concentration findings of one number."""
    return f"""SELECT 'anomaly' AS type, CASE WHEN pct > 5 THEN 'high' ELSE 'medium' END AS severity, round(least(97, 75 + pct * 2), 1) AS confidence, 'Anomalies in {c}' AS title FROM (
  SELECT round(count(*) FILTER (v < lo OR v > hi) / count(*) * 100, 1) AS pct, count(*) FILTER (v < lo OR v > hi) AS k FROM (
    SELECT v, CASE WHEN sk THEN q1 - 3 * (q3 - q1) ELSE m - 3 * sp END AS lo, CASE WHEN sk THEN q3 + 3 * (q3 - q1) ELSE m + 3 * sp END AS hi
    FROM (SELECT {c}::DOUBLE AS v FROM d WHERE {c} IS NOT NULL), (SELECT abs(skewness({c})) > 1.5 AS sk, avg({c}) AS m, stddev_pop({c}) AS sp, stddev_samp({c}) AS sd,
      quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM d) WHERE n >= 10 AND CASE WHEN sk THEN q3 > q1 ELSE sd >= 1e-10 END)) WHERE k > 0
UNION ALL SELECT 'distribution', 'medium', round(least(95, 60 + abs(s) * 8), 1), 'Skewed distribution: {c}' FROM (SELECT skewness({c}) AS s, count({c}) AS n FROM d) WHERE n >= 20 AND abs(s) > 1.5
UNION ALL SELECT 'concentration', CASE WHEN p > 70 THEN 'high' ELSE 'medium' END, round(least(95, 60 + p * 0.4), 1), 'Concentration risk in {c}' FROM (
  SELECT round(sum(v) FILTER (i <= greatest(n // 10, 1)) / sum(v), 4) * 100 AS p, min(v) AS low, any_value(n) AS n FROM (
    SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c} DESC) AS i, count(*) OVER () AS n FROM d WHERE {c} IS NOT NULL)) WHERE n >= 20 AND low >= 0 AND p > 50"""


_SINGLE = """WITH d AS (SELECT documents.*, quality, toxic, length(regexp_replace(text, '[^.]', '', 'g')) AS stops FROM documents LEFT JOIN labels USING (doc_id)),
""" + "f AS (" + " UNION ALL ".join(_single(c) for c in _NUMS) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT 'concentration', 'medium', 90.0, 'Category dominance: {c}' FROM (SELECT count(*) AS k, max(n) AS top FROM (SELECT count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c}))
 WHERE k >= 2 AND top > 0.7 * (SELECT count(*) FROM d)""" for c in _CATS) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT 'data_quality', CASE WHEN p > 30 THEN 'high' ELSE 'medium' END, 99.0, 'Missing data in {c}' FROM (SELECT round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 1) AS p FROM d) WHERE p > 5
 UNION ALL SELECT 'data_quality', 'low', 90.0, 'High-cardinality column: {c}' FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS k FROM d) WHERE '{c}' IN ('text', 'lang', 'source') AND k / n > 0.8 AND k > 50
 UNION ALL SELECT 'data_quality', 'medium', 100.0, 'Constant column: {c}' FROM (SELECT count({c}) AS n, {f"stddev_samp({c})" if c in _NUMS else "NULL"} AS s FROM d) WHERE n >= 5 AND s < 1e-6"""
    for c in ["text", "lang", "source", "n_chars", "quality", "toxic", "stops"]) + ")"


@query("findings_collected_columns", "STA-22 STA-23 STA-24 AGG-14 AGG-15", f"{_SINGLE} SELECT type, severity, confidence::DOUBLE AS confidence, title FROM f")
def _(t):
    return insights.collect_findings(_labelled(t), "doc_id", nums=_NUMS, cats=_CATS).where("size(columns) = 1").select("type", "severity", "confidence", "title")


@query("findings_ranked_documents", "RNK-02 RNK-03")
def _(t):
    f = insights.collect_findings(_labelled(t), "doc_id")
    return rk.rank_findings(f, limit=rk.CAP).withColumn("score", F.round("score", 6))


@query("findings_executive_orders", "RNK-04 RNK-06 RNK-07")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.max("l_discount").alias("discount"))
    f = insights.collect_findings(t.orders.join(lines, "o_orderkey"), "o_orderkey", "o_orderdate")
    ranked = rk.rerank(rk.plan_penalties(rk.deduplicate(f), f.sparkSession.createDataFrame([(0, "o_custkey", "ignore"), (0, "o_orderdate", "time")], "run_id int, column string, use string")))
    return rk.executive_split(ranked)
