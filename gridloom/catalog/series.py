"""Queries of the time-series and panel part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.catalog import sqltails as tail
from gridloom.catalog.base import query
from gridloom.operators import holt, panel as pn, sampling, series as ts

_P = "p AS (SELECT o_orderdate AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM p)"


def _pts(t, how="mean"):
    return ts.points(t.orders, "o_orderdate", "o_totalprice", how)


for _how, _fn in [("mean", "avg"), ("median", "median"), ("max", "max"), ("count", "count")]:
    query(f"ts_aggregate_{_how}", "WIN-01", f"SELECT o_orderdate AS date, round({_fn}(o_totalprice), 6)::DOUBLE AS value FROM orders GROUP BY 1")(
        lambda t, how=_how: _pts(t, how).withColumn("value", F.round("value", 6)))

_STEP = """e AS (SELECT DISTINCT event_type, date_trunc('minute', ts) AS date FROM events),
d AS (SELECT *, lag(date) OVER (PARTITION BY event_type ORDER BY date) AS prev, epoch(date) - epoch(lag(date) OVER (PARTITION BY event_type ORDER BY date)) AS diff_s FROM e),
m AS (SELECT event_type, median(diff_s) AS median_s FROM d GROUP BY 1)"""


def _minutes(t):
    return t.events.select("event_type", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("date"), F.lit(1.0).alias("value")).distinct()


@query("ts_frequency_by_event", "WIN-02", f"""WITH {_STEP} SELECT event_type, median_s, median_s * 2.5 AS gap_threshold_s,
  CASE WHEN median_s <= 120 THEN 'minutely' WHEN median_s <= 7200 THEN 'hourly' WHEN median_s <= 129600 THEN 'daily' ELSE 'weekly' END AS frequency FROM m""")
def _(t):
    return ts.frequency(_minutes(t), ["event_type"])


@query("ts_gaps_by_event", "WIN-03", f"""WITH {_STEP} SELECT event_type, prev AS gap_from, date AS gap_to, round(diff_s / 86400, 2) AS gap_days
FROM d JOIN m USING (event_type) WHERE diff_s > median_s * 2.5""")
def _(t):
    return ts.gaps(_minutes(t), ["event_type"])


@query("ts_gaps_dear_orders", "WIN-03", """
WITH p AS (SELECT DISTINCT o_orderdate AS date FROM orders WHERE o_totalprice > (SELECT 0.95 * max(o_totalprice) FROM orders)),
d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev, epoch(date) - epoch(lag(date) OVER (ORDER BY date)) AS s FROM p)
SELECT prev AS gap_from, date AS gap_to, round(s / 86400, 2) AS gap_days FROM d WHERE s > 2.5 * (SELECT median(s) FROM d)""")
def _(t):
    most = t.orders.agg(0.95 * F.max("o_totalprice")).scalar()
    dear = t.orders.withColumn("_m", most).where(F.col("o_totalprice") > F.col("_m"))
    return ts.gaps(ts.points(dear, "o_orderdate", "o_totalprice"))


@query("ts_daily_gaps", "WIN-03 PRF-07", """
WITH p AS (SELECT DISTINCT o_orderdate AS date FROM orders), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev, epoch(date) - epoch(lag(date) OVER (ORDER BY date)) AS s FROM p)
SELECT prev AS gap_from, date AS gap_to, round(s / 86400, 2) AS gap_days FROM d WHERE s > 2.5 * (SELECT median(s) FROM d)""")
def _(t):
    return ts.gaps(_pts(t))


@query("ts_moving_average", "WIN-04", f"""WITH {_P}
SELECT date, round(avg(value) OVER (ORDER BY pos ROWS 6 PRECEDING), 4) AS rolling_short, round(avg(value) OVER (ORDER BY pos ROWS 13 PRECEDING), 4) AS rolling_long FROM s""")
def _(t):
    return ts.moving_averages(_pts(t)).select("date", F.round("rolling_short", 4).alias("rolling_short"), F.round("rolling_long", 4).alias("rolling_long"))


@query("ts_trend", "WIN-05", f"""WITH {_P}, r AS (SELECT count(*) AS n, regr_slope(value, pos - 1) AS sl, regr_intercept(value, pos - 1) AS ic, corr(value, pos - 1) AS r FROM s)
SELECT n, round(sl, 6) AS slope, round(ic, 4) AS intercept, round(r * r, 4) AS r2, round({tail.t_two_sided('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')}, 4) AS p_value,
  CASE WHEN sl > 0 THEN 'up' ELSE 'down' END AS trend FROM r""")
def _(t):
    return ts.trend(_pts(t))


_DEC = f"""{_P}, t AS (SELECT *, avg(value) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM s),
se AS (SELECT (pos - 1) % 7 AS ph, avg(value - trend) AS seasonal FROM t GROUP BY 1),
dec AS (SELECT date, value, trend, seasonal, value - trend - seasonal AS residual FROM t JOIN se ON ph = (pos - 1) % 7)"""


@query("ts_decompose", "WIN-06", f"WITH {_DEC} SELECT date, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(residual, 4) AS residual FROM dec")
def _(t):
    return ts.decompose(_pts(t), 7).select("date", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "residual")])


@query("ts_mad_anomalies", "WIN-07", f"""WITH {_DEC}, m AS (SELECT median(residual) AS med FROM dec), a AS (SELECT median(abs(residual - med)) AS mad FROM dec, m)
SELECT date, round(residual, 4) AS residual, abs(residual - med) / (1.4826 * mad) > 3 AS is_anomaly FROM dec, m, a""")
def _(t):
    return ts.robust_anomalies(ts.decompose(_pts(t), 7), "residual").select("date", F.round("residual", 4).alias("residual"), "is_anomaly")


_LEVEL = """WITH s AS (SELECT row_number() OVER (ORDER BY day) AS pos, count(*) OVER () AS n, day AS date, v AS value FROM (
  SELECT date_trunc('day', ts) AS day, CASE WHEN date_trunc('day', ts) >= '2024-01-15' THEN 1000.0 * 25 ELSE 0 END + avg(value) AS v FROM events GROUP BY 1))"""


@query("ts_change_points_spike", "WIN-08", f"""{_LEVEL.replace("date_trunc('day', ts) >= '2024-01-15'", "date_trunc('day', ts) = '2024-01-15'")},
w AS (SELECT *, greatest(3, n // 15) AS w, stddev_samp(value) OVER () AS sd FROM s),
c AS (SELECT a.pos - 1 - (a.w - 1) // 2 AS i, (a.value - b.value) / a.w AS step, a.sd, a.w, a.n FROM w a JOIN w b ON b.pos = a.pos - a.w),
h AS (SELECT c.*, w.date FROM c JOIN w ON w.pos - 1 = c.i WHERE abs(step) > 1.5 * c.sd AND i >= c.w AND i < c.n - c.w)
SELECT i::BIGINT AS "index", date, round(abs(step), 4) AS magnitude, CASE WHEN step > 0 THEN 'up' ELSE 'down' END AS direction, round(abs(step) / sd, 2) AS sigma FROM h""")
def _(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    d = t.events.groupBy(day.alias("d")).agg(F.avg("value").alias("v"))
    spike = F.when(F.col("d") == F.lit("2024-01-15").cast("timestamp_ntz"), 25000.0).otherwise(0.0)
    return ts.change_points(ts.points(d.select("d", (F.col("v") + spike).alias("v")), "d", "v"))


@query("ts_change_points", "WIN-08", f"""{_LEVEL},
w AS (SELECT *, greatest(3, n // 15) AS w, stddev_samp(value) OVER () AS sd FROM s),
c AS (SELECT a.pos - 1 - (a.w - 1) // 2 AS i, (a.value - b.value) / a.w AS step, a.sd, a.w, a.n FROM w a JOIN w b ON b.pos = a.pos - a.w),
h AS (SELECT c.*, w.date FROM c JOIN w ON w.pos - 1 = c.i WHERE abs(step) > 1.5 * c.sd AND i >= c.w AND i < c.n - c.w)
SELECT i::BIGINT AS "index", date, round(abs(step), 4) AS magnitude, CASE WHEN step > 0 THEN 'up' ELSE 'down' END AS direction, round(abs(step) / sd, 2) AS sigma
FROM h QUALIFY row_number() OVER (ORDER BY round(abs(step), 4) DESC, i) = 1""")
def _(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    d = t.events.groupBy(day.alias("d")).agg(F.avg("value").alias("v"))
    d = d.withColumn("v", F.when(F.col("d") >= F.lit("2024-01-15").cast("timestamp_ntz"), 25000.0).otherwise(0.0) + F.col("v"))
    return ts.change_points(ts.points(d, "d", "v"))


@query("ts_seasonality", "WIN-09", f"""WITH {_P}, l AS (SELECT value, lag(value, 7) OVER (ORDER BY pos) AS l FROM s), r AS (SELECT corr(value, l) AS r FROM l)
SELECT 7::BIGINT AS lag, round(r, 4) AS autocorr, abs(r) > 0.3 AS detected, CASE WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM r""")
def _(t):
    return ts.seasonality(_pts(t), 7)


@query("ts_stationarity", "WIN-10", f"""WITH {_P}, v AS (SELECT var_samp(value) FILTER (pos <= n // 2) AS v1, var_samp(value) FILTER (pos > n // 2) AS v2 FROM s)
SELECT round(v1, 4) AS var_first, round(v2, 4) AS var_second, abs(v1 - v2) / greatest(v1 + v2, 1e-9) < 0.5 AS is_stationary FROM v""")
def _(t):
    return ts.stationarity(_pts(t))


@query("ts_drift_forecast", "WIN-11", f"""WITH {_P}, l AS (SELECT arg_max(value, pos) AS last, arg_max(value, pos) FILTER (pos < n) AS prev, stddev_samp(value) AS sd, any_value(n) AS n FROM s),
f AS (SELECT unnest(range(1, least(30, greatest(7, n // 4)) + 1)) AS step, last, prev, sd FROM l)
SELECT step, round(last + (last - prev) * step, 4) AS forecast, round(last + (last - prev) * step - 1.28 * sd, 4) AS lower_80, round(last + (last - prev) * step + 1.28 * sd, 4) AS upper_80 FROM f""")
def _(t):
    return ts.drift_forecast(_pts(t))


_HOLT = """WITH RECURSIVE p AS (SELECT o_orderstatus AS k, date_trunc('week', CAST(o_orderdate AS DATE)) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
s AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY date) AS pos, count(*) OVER (PARTITION BY k) AS n FROM p),
grid AS (SELECT a, b, phi FROM unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) t(a), unnest([0.01, 0.05, 0.1, 0.3, 0.5]) u(b), unnest([0.8, 0.9, 0.98]) v(phi)),
h AS (SELECT x.k, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(phi AS DOUBLE) AS phi, CAST(1 AS BIGINT) AS pos, x.n, x.value AS level, y.value - x.value AS trend, CAST(0 AS DOUBLE) AS sse, CAST(0 AS DOUBLE) AS es
  FROM s x JOIN s y ON x.k = y.k AND x.pos = 1 AND y.pos = 2, grid WHERE x.n >= 10
  UNION ALL SELECT h.k, a, b, phi, s.pos, h.n, level + phi * trend + a * (s.value - level - phi * trend),
    b * (phi * trend + a * (s.value - level - phi * trend)) + (1 - b) * phi * trend, sse + pow(s.value - level - phi * trend, 2), es + s.value - level - phi * trend
  FROM h JOIN s ON s.k = h.k AND s.pos = h.pos + 1),
best AS (SELECT k, arg_min({'a': a, 'b': b, 'phi': phi, 'n': n, 'level': level, 'trend': trend, 'sse': sse, 'es': es}, sse) AS f FROM h WHERE pos = n GROUP BY k),
fits AS (SELECT k, f.*, sqrt((f.sse - f.es * f.es / (f.n - 1)) / (f.n - 2)) AS sd FROM best)"""


def _weekly(t):
    return ts.points(t.orders.withColumn("week", F.date_trunc("week", "o_orderdate").cast("date")), "week", "o_totalprice", "mean", ["o_orderstatus"])


@query("ts_holt_fit_by_status", "WIN-11", _HOLT + """ SELECT k AS o_orderstatus, n, a AS alpha, b AS beta, phi, round(level, 2) AS level, round(trend, 2) AS trend, round(sd, 2) AS deviation FROM fits""")
def _(t):
    f = holt.fit_holt(_weekly(t), ["o_orderstatus"])
    return f.select("o_orderstatus", "n", "alpha", "beta", "phi", *[F.round(c, 2).alias(c) for c in ("level", "trend", "deviation")])


@query("ts_holt_forecast_by_status", "WIN-11", _HOLT + """, x AS (SELECT *, unnest(range(1, least(30, greatest(7, n // 4)) + 1)) AS step FROM fits),
y AS (SELECT *, level + trend * phi * (1 - pow(phi, step)) / (1 - phi) AS forecast FROM x)
SELECT k AS o_orderstatus, step, round(forecast, 4) AS forecast, round(forecast - 1.28 * sd * sqrt(step), 4) AS lower_80, round(forecast + 1.28 * sd * sqrt(step), 4) AS upper_80, 'damped_holt' AS model_used FROM y""")
def _(t):
    return holt.holt_forecast(_weekly(t), ["o_orderstatus"])


@query("ts_drift_forecast_by_status", "WIN-11", """WITH p AS (SELECT o_orderstatus AS k, o_orderdate AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS pos, count(*) OVER (PARTITION BY k) AS n FROM p),
l AS (SELECT k, arg_max(value, pos) AS last, arg_max(value, pos) FILTER (pos < n) AS prev, stddev_samp(value) AS sd, any_value(n) AS n FROM s GROUP BY k),
f AS (SELECT k, unnest(range(1, least(30, greatest(7, n // 4)) + 1)) AS step, last, prev, sd FROM l)
SELECT k AS o_orderstatus, step, round(last + (last - prev) * step, 4) AS forecast, round(last + (last - prev) * step - 1.28 * sd, 4) AS lower_80, round(last + (last - prev) * step + 1.28 * sd, 4) AS upper_80 FROM f""")
def _(t):
    return ts.drift_forecast(ts.points(t.orders, "o_orderdate", "o_totalprice", "mean", ["o_orderstatus"]), ["o_orderstatus"])


@query("ts_summary", "WIN-12", f"""WITH {_P}, a AS (SELECT count(*) AS n, arg_min(value, pos) AS f, arg_max(value, pos) AS l, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM s)
SELECT n, round(f, 4) AS first_value, round(l, 4) AS last_value, round((l - f) / f * 100, 2) AS change_pct, round(sd / m, 4) AS volatility, round(m, 4) AS mean, round(sd, 4) AS std,
  round(lo, 4) AS min, round(hi, 4) AS max FROM a""")
def _(t):
    return ts.summary(_pts(t))


# --- panels: parts as symbols, ship dates as trading days -------------------------------------------------------------------

_PAN = """p AS (SELECT l_partkey::VARCHAR AS symbol, l_shipdate AS date, avg(l_extendedprice / l_quantity) AS px, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, px / lag(px) OVER w - 1 AS ret, row_number() OVER w AS pos, max(px) OVER w AS peak FROM p WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT symbol, count(*) AS n_obs, date_diff('day', min(date), max(date)) AS span_days, arg_max(px, date) / arg_min(px, date) - 1 AS total_return,
  stddev_samp(ret) * sqrt(252) AS vol_ann, min(px / peak - 1) AS max_drawdown, sum(vol) AS volume_sum, regr_slope(ln(px), pos - 1) AS trend_slope_log FROM r GROUP BY 1)"""


def _panel(t):
    d = t.lineitem.groupBy("l_partkey", "l_shipdate").agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.sum("l_quantity").alias("vol"))
    return pn.panel(d, "l_partkey", "l_shipdate", "px", "vol")


_ROUND = "symbol, n_obs, span_days, round(total_return, 6) AS total_return, round(vol_ann, 6) AS vol_ann, round(max_drawdown, 6) AS max_drawdown, round(volume_sum, 6) AS volume_sum, round(trend_slope_log, 6) AS trend_slope_log"


@query("panel_metrics_by_part", "WIN-15 WIN-16 WIN-17", f"WITH {_PAN} SELECT {_ROUND} FROM m WHERE n_obs >= 2")
def _(t):
    return pn.rounded(pn.symbol_metrics(_panel(t)))


@query("panel_daily_returns", "WIN-15 WIN-16", f"WITH {_PAN} SELECT symbol, date, round(ret, 6) AS ret, round(peak, 8) AS peak FROM r")
def _(t):
    return pn.with_returns(_panel(t)).select("symbol", "date", F.round("ret", 6).alias("ret"), F.round("peak", 8).alias("peak"))


@query("panel_incomplete_histories", "WIN-18", f"""WITH {_PAN}, q AS (SELECT * FROM m WHERE n_obs >= 8), z AS (SELECT median(n_obs) AS o, median(span_days) AS s FROM q)
SELECT symbol, n_obs, span_days FROM q, z WHERE n_obs < greatest(8, 0.72 * o) OR span_days < greatest(1, 0.72 * s)""")
def _(t):
    return pn.incomplete_histories(pn.symbol_metrics(_panel(t)))


@query("panel_largest_move", "WIN-19", f"WITH {_PAN} SELECT symbol, date, round(ret, 8) AS ret FROM r WHERE ret IS NOT NULL ORDER BY abs(ret) DESC, symbol DESC LIMIT 1")
def _(t):
    return pn.largest_move(_panel(t))


_RANK = lambda i, title, kind, sev, conf, col, order, where="true": f"""
SELECT '{title}' AS title, '{kind}' AS type, '{sev}' AS severity, {conf}::DOUBLE AS confidence, row_number() OVER (ORDER BY {col} {order}, symbol) AS rank, symbol, round({col}, 6) AS value
FROM q WHERE {col} IS NOT NULL AND {where} QUALIFY rank <= 3"""


@query("panel_findings", "DOM-04", f"WITH {_PAN}, q AS (SELECT * FROM m WHERE n_obs >= 8) " + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in [
    _RANK(0, "Top performers by total return", "segment", "medium", 84, "total_return", "DESC"),
    _RANK(1, "Worst performers by total return", "segment", "medium", 84, "total_return", "ASC"),
    _RANK(2, "Highest volatility symbols", "concentration", "medium", 82, "vol_ann", "DESC"),
    _RANK(3, "Largest drawdowns", "concentration", "medium", 82, "max_drawdown", "ASC"),
    _RANK(4, "Highest volume symbols", "concentration", "low", 80, "volume_sum", "DESC", "volume_sum > 0"),
    _RANK(5, "Strongest trend symbols", "segment", "low", 78, "trend_slope_log", "DESC")]))
def _(t):
    return pn.panel_findings(pn.symbol_metrics(_panel(t)))


@query("latest_rows_per_symbol", "WIN-20", """
SELECT l_partkey, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_extendedprice) AS rn FROM lineitem) WHERE rn <= 5""")
def _(t):
    return sampling.latest_per_key(t.lineitem.select("l_partkey", "l_shipdate", "l_extendedprice"), "l_partkey", "l_shipdate", "l_extendedprice", 5)


@query("indexed_price_lines", "WIN-21", f"""WITH {_PAN}, lead5 AS (SELECT symbol FROM p GROUP BY 1 ORDER BY sum(vol) DESC, 1 LIMIT 5),
d AS (SELECT symbol, date, px FROM p WHERE symbol IN (FROM lead5)), b AS (SELECT symbol, arg_min(px, date) AS base FROM d GROUP BY 1),
g AS (SELECT * FROM (SELECT DISTINCT date FROM d) CROSS JOIN lead5), f AS (SELECT g.symbol, g.date, last_value(px IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date) AS f FROM g LEFT JOIN d USING (symbol, date)),
k AS (SELECT DISTINCT date FROM d ORDER BY date DESC LIMIT 200)
SELECT symbol, date, round(f / base * 100, 4) AS indexed FROM f JOIN b USING (symbol) JOIN k USING (date) WHERE f IS NOT NULL""")
def _(t):
    return pn.indexed_lines(_panel(t))


@query("latest_run_per_project", "WIN-22", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus <> 'P' THEN 1 ELSE 2 END, o_orderkey DESC) = 1""")
def _(t):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") != "P", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(rank, F.desc("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", "o_orderstatus").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
