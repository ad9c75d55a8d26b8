"""Time series. Points are ``keys…, date, value`` (one per date and key); ``pos`` is their position in the series.

A series of any length is spread over many tasks: positions come from date blocks, moving windows from bounded
neighbourhoods, and cumulative values from block summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import correlation_of
from gridloom.functions.tails import t_two_sided
from gridloom.session import settle
from gridloom.plans.ordered import grouped_quantiles, neighbourhood, with_position, with_previous

# Seasonal lag and decomposition period per frequency.
SEASONAL_LAG = {"minutely": 60, "hourly": 24, "daily": 7, "weekly": 4, "monthly": 12, "quarterly": 4, "yearly": 1}
PERIOD = {"minutely": 60, "hourly": 24, "daily": 7, "weekly": 4, "monthly": 12, "quarterly": 4, "yearly": 1}
# Upper limits in seconds of the median distance per frequency.
FREQUENCY_LIMITS = [
    (120, "minutely"), (7200, "hourly"), (129600, "daily"), (691200, "weekly"), (2764800, "monthly"), (8208000, "quarterly"),
]
Z_80 = 1.28


def points(df: DataFrame, date: str, value: str, how: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """One value per date (and key) from the rows of that date."""
    rows = df.select(*keys, F.col(date).alias("date"), F.col(value).alias("value")).where(
        F.col("date").isNotNull() & F.col("value").isNotNull())
    if how == "median":
        return grouped_quantiles(rows, [*keys, "date"], "value", {"v": 0.5}).select(*keys, "date", F.col("v").alias("value"))
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}.get(how, F.avg)
    return rows.groupBy(*keys, "date").agg(fn("value").cast("double").alias("value"))


def _with_size(pts: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    if not keys:
        return pts.withColumn("n", pts.agg(n).scalar())
    return pts.join(pts.groupBy(*keys).agg(n.alias("n")), list(keys))


def seconds_between(later: Column, earlier: Column) -> Column:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(later) - us(earlier)) / 1e6


def steps(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points with the previous date and the distance in seconds."""
    return with_previous(pts, keys, "date").withColumn("diff_s", seconds_between(F.col("date"), F.col("prev")))


def frequency_label(seconds: Column) -> Column:
    out = F.when(seconds.isNull(), "unknown")
    for limit, label in FREQUENCY_LIMITS:
        out = out.when(seconds <= limit, label)
    return out.otherwise("yearly")


def frequency(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median distance, gap threshold and frequency label per series."""
    q = grouped_quantiles(steps(pts, keys), keys, "diff_s", {"median_s": 0.5}).drop("n")
    return q.select(*keys, "median_s", (F.col("median_s") * 2.5).alias("gap_threshold_s"), frequency_label(F.col("median_s")).alias("frequency"))


def gaps(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distances of more than 2.5 times the median distance."""
    s = steps(pts, keys).where("prev IS NOT NULL")
    f = frequency(pts, keys)
    if keys:
        j = s.join(f.select(*keys, "gap_threshold_s"), list(keys))
    else:
        j = s.withColumn("gap_threshold_s", f.select("gap_threshold_s").scalar())
    return j.where("diff_s > gap_threshold_s").select(
        *keys, F.col("prev").alias("gap_from"), F.col("date").alias("gap_to"), F.round(F.col("diff_s") / 86400, 2).alias("gap_days"))


def moving_averages(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Short and long trailing means; their widths (3..7 and 5..14) follow from the series length."""
    placed = with_position(_with_size(pts, keys), keys, "date")
    short = F.least(F.lit(7), F.greatest(F.lit(3), F.floor(F.col("n") / 5)))
    long = F.least(F.lit(14), F.greatest(F.lit(5), F.floor(F.col("n") / 3)))

    def pick(frame, width, sizes):
        return F.coalesce(*[F.when(width == w, F.avg("value").over(frame(-(w - 1), 0))) for w in sizes])

    return neighbourhood(placed, keys, lambda frame: {
        "rolling_short": pick(frame, short, range(3, 8)), "rolling_long": pick(frame, long, range(5, 15)),
    }, before=13, after=0)


def trend(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the value over the position (from 0)."""
    placed = with_position(pts, keys, "date").withColumn("x", F.col("pos") - 1.0)
    g = placed.groupBy(*keys) if keys else placed
    m = g.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"),
              correlation_of("value", "x").alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    m = m.withColumn("_t", t).withColumn("_dof", (F.col("n") - 2).cast("double")).withColumn("_p", t_two_sided("_t", "_dof"))
    return m.select(*keys, "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                    F.round(F.col("r") * F.col("r"), 4).alias("r2"), F.round("_p", 4).alias("p_value"),
                    F.when(F.col("slope") > 0, "up").otherwise("down").alias("trend"))


def _centred(width: int) -> tuple[int, int]:
    right = (width - 1) // 2
    return -(width - 1 - right), right


def decompose(pts: DataFrame, period: int, keys: Sequence[str] = ()) -> DataFrame:
    """Trend (centred moving mean), seasonal (mean of the detrended values per phase) and residual.

    Series shorter than two periods, or a period below two, keep their values as trend.
    """
    placed = with_position(_with_size(pts, keys), keys, "date")
    lo, hi = _centred(max(period, 1))
    t = neighbourhood(placed, keys, lambda frame: {"_t": F.avg("value").over(frame(lo, hi))}, before=-lo, after=hi)
    short = (F.col("n") < 2 * period) | F.lit(period < 2)
    t = t.withColumn("phase", (F.col("pos") - 1) % max(period, 1)).withColumn("trend", F.when(short, F.col("value")).otherwise(F.col("_t")))
    season = t.groupBy(*keys, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("seasonal"))
    return t.drop("_t").join(season, [*keys, "phase"]).withColumn(
        "residual", F.col("value") - F.col("trend") - F.col("seasonal")).drop("phase")


def robust_anomalies(rows: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Flag of |x - median| / (1.4826 MAD) > 3; with a zero MAD, |x - mean| > 2.5 std."""
    keys, rows = list(keys), settle(rows)
    med = grouped_quantiles(rows, keys, col, {"_med": 0.5}).drop("n")
    with_med = rows.join(med, keys) if keys else rows.withColumn("_med", med.select("_med").scalar())
    with_med = with_med.withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    mad = grouped_quantiles(with_med, keys, "_dev", {"_mad": 0.5}).drop("n")
    g = rows.groupBy(*keys) if keys else rows
    mom = g.agg(F.avg(col).alias("_mean"), F.stddev_samp(col).alias("_std"))
    if keys:
        out = with_med.join(mad, keys).join(mom, keys)
    else:
        out = with_med.withColumn("_mad", mad.select("_mad").scalar()).withColumn("_m", mom.select(F.struct("_mean", "_std")).scalar()).select(
            "*", "_m.*").drop("_m")
    flag = F.when(F.col("_mad") >= 1e-10, F.col("_dev") / (1.4826 * F.col("_mad")) > 3).when(
        F.col("_std") >= 1e-10, F.abs(F.col(col) - F.col("_mean")) / F.col("_std") > 2.5).otherwise(False)
    return out.withColumn("is_anomaly", flag).drop("_med", "_dev", "_mad", "_mean", "_std")


def change_points(pts: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Jumps of the centred rolling mean above 1.5 standard deviations, merged within the window: all, or the first ``limit``.

    The step of a rolling mean of width w is (v[j] - v[j - w]) / w, so each point only meets the one w places before.
    At most 4 n / (2.25 w^2) points can pass, a few dozen per series, and only those are folded in order.
    """
    keys = list(keys)
    placed = with_position(_with_size(pts, keys), keys, "date").withColumn(
        "w", F.greatest(F.lit(3), F.floor(F.col("n") / 15)).cast("bigint"))
    g = placed.groupBy(*keys) if keys else placed
    sd = g.agg(F.stddev_samp("value").alias("sd"))
    placed = placed.join(sd, keys) if keys else placed.withColumn("sd", sd.scalar())
    off = F.floor((F.col("w") - 1) / 2)
    here = placed.withColumn("i", F.col("pos") - 1 - off).withColumn("_back", F.col("pos") - F.col("w"))
    back = placed.select(*keys, F.col("pos").alias("_back"), F.col("value").alias("v0"))
    dates = placed.select(*keys, (F.col("pos") - 1).alias("i"), F.col("date").alias("at"))
    step = (F.col("value") - F.col("v0")) / F.col("w")
    hits = here.join(back, [*keys, "_back"]).withColumn("step", step).where(
        (F.abs("step") > 1.5 * F.col("sd")) & (F.col("sd") >= 1e-10) & (F.col("n") >= 3 * F.col("w"))
        & (F.col("i") >= F.col("w")) & (F.col("i") < F.col("n") - F.col("w")))
    hits = hits.select(*keys, "i", "w", "sd", "step").join(dates, [*keys, "i"])
    cell = F.struct(F.col("i").cast("bigint").alias("index"), F.col("at").alias("date"), F.round(F.abs("step"), 4).alias("magnitude"),
                    F.when(F.col("step") > 0, "up").otherwise("down").alias("direction"),
                    F.round(F.abs("step") / F.col("sd"), 2).alias("sigma"), "w")
    lists = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("c")) if keys else hits.agg(F.array_sort(F.collect_list(cell)).alias("c"))

    def fold(acc, x):
        last = F.element_at(acc, -1)
        far = (F.size(acc) == 0) | (x["index"] - F.try_element_at(acc, F.lit(-1))["index"] >= x["w"])
        better = x["magnitude"] > F.try_element_at(acc, F.lit(-1))["magnitude"]
        return F.when(far, F.concat(acc, F.array(x))).when(
            better, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))).otherwise(acc)

    merged = lists.withColumn("c", F.aggregate("c", F.slice(F.col("c"), 1, 0), fold))
    return merged.select(*keys, F.inline("c" if limit is None else F.slice("c", 1, limit))).drop("w")


def seasonality(pts: DataFrame, lag: int, keys: Sequence[str] = ()) -> DataFrame:
    """Autocorrelation at the seasonal lag with its strength."""
    placed = with_position(pts, keys, "date")
    l = neighbourhood(placed, keys, lambda frame: {"_l": F.lag("value", lag).over(frame(None, None))}, before=lag, after=0)
    g = l.groupBy(*keys) if keys else l
    r = g.agg(F.count(F.lit(1)).alias("n"), correlation_of(F.when(F.col("_l").isNotNull(), F.col("value")), F.col("_l")).alias("r")).withColumn(
        "r", F.when(F.col("n") >= 2 * lag, F.col("r")))
    a = F.abs("r")
    return r.select(*keys, F.lit(lag).cast("bigint").alias("lag"), F.round("r", 4).alias("autocorr"), F.coalesce(a > 0.3, F.lit(False)).alias("detected"),
                    F.when(a > 0.6, "strong").when(a > 0.3, "moderate").when(a.isNotNull(), "weak").alias("strength"))


def stationarity(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Variances of the two halves and whether they differ by less than half of their sum."""
    placed = with_position(_with_size(pts, keys), keys, "date")
    first = F.col("pos") <= F.floor(F.col("n") / 2)
    g = placed.groupBy(*keys) if keys else placed
    v = g.agg(F.var_samp(F.when(first, F.col("value"))).alias("v1"), F.var_samp(F.when(~first, F.col("value"))).alias("v2"))
    ratio = F.abs(F.col("v1") - F.col("v2")) / F.greatest(F.col("v1") + F.col("v2"), F.lit(1e-9))
    return v.select(*keys, F.round("v1", 4).alias("var_first"), F.round("v2", 4).alias("var_second"), (ratio < 0.5).alias("is_stationary"))


def last_two(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series: last value, the one before it, std and length (map tasks keep two points per series)."""
    g = pts.groupBy(*keys) if keys else pts
    top = F.max_by("value", "date")
    one = g.agg(top.alias("last"), F.max("date").alias("last_date"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))
    if keys:
        j = pts.join(one.select(*keys, "last_date"), list(keys))
        prev = j.where(F.col("date") < F.col("last_date")).groupBy(*keys).agg(F.max_by("value", "date").alias("before_last"))
        return one.join(prev, list(keys))
    prev = pts.where(F.col("date") < pts.agg(F.max("date")).scalar()).agg(F.max_by("value", "date"))
    return one.withColumn("before_last", prev.scalar())


def drift_forecast(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last value plus last step, with an 80 % band; 7 to 30 steps by length."""
    t = last_two(pts, keys).where("n >= 2")
    horizon = F.least(F.lit(30), F.greatest(F.lit(7), F.floor(F.col("n") / 4))).cast("int")
    t = t.withColumn("step", F.explode(F.sequence(F.lit(1), horizon)))
    f = F.col("last") + (F.col("last") - F.col("before_last")) * F.col("step")
    return t.select(*keys, F.col("step").cast("bigint").alias("step"), F.round(f, 4).alias("forecast"),
                    F.round(f - Z_80 * F.col("std"), 4).alias("lower_80"), F.round(f + Z_80 * F.col("std"), 4).alias("upper_80"))


def summary(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g = pts.groupBy(*keys) if keys else pts
    s = g.agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "date").alias("f"), F.max_by("value", "date").alias("l"),
              F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return s.select(
        *keys, "n", F.round("f", 4).alias("first_value"), F.round("l", 4).alias("last_value"),
        F.when(F.col("f") != 0, F.round((F.col("l") - F.col("f")) / F.col("f") * 100, 2)).alias("change_pct"),
        F.when(F.col("m") != 0, F.round(F.col("s") / F.col("m"), 4)).alias("volatility"),
        F.round("m", 4).alias("mean"), F.round("s", 4).alias("std"), F.round("lo", 4).alias("min"), F.round("hi", 4).alias("max"))


def run_timeseries(df: DataFrame, date: str, value: str, how: str = "mean") -> dict[str, DataFrame]:
    """All result tables of one series; the frequency (one label) is read first to fix lag and period."""
    from gridloom.operators.holt import holt_forecast

    pts = points(df, date, value, how)
    freq = frequency(pts)
    label = freq.first()["frequency"]
    n = pts.count()
    if n < 4:
        raise ValueError(f"a time series needs at least 4 points, got {n}")
    parts = decompose(pts, min(PERIOD.get(label, 7), n // 2))
    return {
        "frequency": freq, "gaps": gaps(pts), "moving_averages": moving_averages(pts), "trend": trend(pts),
        "decomposition": robust_anomalies(parts, "residual"), "change_points": change_points(pts),
        "seasonality": seasonality(pts, SEASONAL_LAG.get(label, 7)), "stationarity": stationarity(pts),
        "forecast": holt_forecast(pts), "summary": summary(pts),
    }
