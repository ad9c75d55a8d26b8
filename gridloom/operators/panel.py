"""Panels of priced symbols: returns, risk, coverage and the ranked findings over them.

Rows are ``symbol, date, px, vol``. A symbol's history may be of any length: previous prices, running peaks and
positions are all taken block-wise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.ordered import grouped_quantiles, neighbourhood, running, with_position
from gridloom.plans.stacked import stack_numbers
from gridloom.session import settle

TRADING_DAYS = 252.0
MIN_SYMBOLS, MIN_OBS, TOP = 3, 8, 3
INCOMPLETE_SHARE = 0.72


def panel(df: DataFrame, symbol: str, date: str, price: str, volume: str | None = None) -> DataFrame:
    return df.select(
        F.trim(F.col(symbol).cast("string")).alias("symbol"), F.col(date).alias("date"), F.col(price).cast("double").alias("px"),
        (F.col(volume).cast("double") if volume else F.lit(None).cast("double")).alias("vol"),
    ).where("symbol <> '' AND date IS NOT NULL AND px IS NOT NULL")


def with_returns(p: DataFrame) -> DataFrame:
    """Position, daily return and the running price peak of every row."""
    placed = with_position(p, ["symbol"], "date")
    r = neighbourhood(placed, ["symbol"], lambda frame: {"_prev": F.lag("px").over(frame(None, None))}, before=1, after=0)
    r = r.withColumn("ret", F.col("px") / F.nullif("_prev", F.lit(0.0)) - 1).drop("_prev")
    return running(r, ["symbol"], "px", "max", "peak")


def symbol_metrics(p: DataFrame) -> DataFrame:
    """One row per symbol with two or more rows: observations, span, return, volatility, drawdown, volume, log trend."""
    r = with_returns(p)
    return r.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_obs"), F.datediff(F.max("date"), F.min("date")).cast("bigint").alias("span_days"),
        (F.max_by("px", "date") / F.nullif(F.min_by("px", "date"), F.lit(0.0)) - 1).alias("total_return"),
        (F.stddev_samp("ret") * TRADING_DAYS ** 0.5).alias("vol_ann"),
        F.min(F.col("px") / F.greatest("peak", F.lit(1e-12)) - 1).alias("max_drawdown"),
        F.coalesce(F.sum("vol"), F.lit(0.0)).alias("volume_sum"),
        F.regr_slope(F.ln(F.greatest("px", F.lit(1e-12))), F.col("pos") - 1.0).alias("trend_slope_log"),
    ).where("n_obs >= 2")


def rounded(m: DataFrame, digits: int = 6) -> DataFrame:
    return m.select("symbol", "n_obs", "span_days", *[
        F.round(c, digits).alias(c) for c in ("total_return", "vol_ann", "max_drawdown", "volume_sum", "trend_slope_log")])


def incomplete_histories(metrics: DataFrame) -> DataFrame:
    """Symbols below 72 % of the peers' median row count or calendar span."""
    q = settle(metrics.where(F.col("n_obs") >= MIN_OBS))
    med = grouped_quantiles(stack_numbers(q, ["n_obs", "span_days"]), ["column"], "value", {"m": 0.5}, few_keys=True)
    pair = med.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in ("n_obs", "span_days")])).scalar()
    d = q.withColumn("_m", pair).select("*", F.col("_m.n_obs").alias("_o"), F.col("_m.span_days").alias("_s")).where("_o > 0 AND _s > 0")
    need_obs = F.greatest(F.lit(float(MIN_OBS)), INCOMPLETE_SHARE * F.col("_o"))
    need_span = F.greatest(F.lit(1.0), INCOMPLETE_SHARE * F.col("_s"))
    return d.where((F.col("n_obs") < need_obs) | (F.col("span_days") < need_span)).select("symbol", "n_obs", "span_days")


def largest_move(p: DataFrame) -> DataFrame:
    """The row with the largest absolute daily return of the whole panel."""
    r = with_returns(p).where("ret IS NOT NULL")
    return r.agg(F.max_by(F.struct("symbol", "date", F.round("ret", 8).alias("ret")), F.struct(F.abs("ret"), F.col("symbol"))).alias("s")).select("s.*")


def panel_findings(metrics: DataFrame) -> DataFrame:
    """Top three symbols per metric (8 observations up, three symbols at least), in long form."""
    q = metrics.where(F.col("n_obs") >= MIN_OBS)
    kinds = [
        ("Top performers by total return", "total_return", -1, "segment", "medium", 84.0, F.lit(True)),
        ("Worst performers by total return", "total_return", 1, "segment", "medium", 84.0, F.lit(True)),
        ("Highest volatility symbols", "vol_ann", -1, "concentration", "medium", 82.0, F.lit(True)),
        ("Largest drawdowns", "max_drawdown", 1, "concentration", "medium", 82.0, F.lit(True)),
        ("Highest volume symbols", "volume_sum", -1, "concentration", "low", 80.0, F.col("volume_sum") > 0),
        ("Strongest trend symbols", "trend_slope_log", -1, "segment", "low", 78.0, F.lit(True)),
    ]
    from pyspark.sql import Window

    long = q.select("symbol", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(t).alias("title"), F.lit(kind).alias("type"), F.lit(sev).alias("severity"),
                 F.lit(conf).alias("confidence"), F.when(ok, F.col(m)).alias("value"), (F.lit(float(sign)) * F.col(m)).alias("key"))
        for i, (t, m, sign, kind, sev, conf, ok) in enumerate(kinds)
    ])).alias("s")).select("symbol", "s.*").where("value IS NOT NULL")
    sizes = long.groupBy("ord").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_SYMBOLS)
    w = Window.partitionBy("ord").orderBy("key", "symbol")
    top = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)
    return top.join(F.broadcast(sizes), "ord").select(
        "title", "type", "severity", "confidence", F.col("rank").cast("bigint").alias("rank"), "symbol", F.round("value", 6).alias("value"))


def indexed_lines(p: DataFrame, top: int = 5, dates: int = 200) -> DataFrame:
    """Price lines indexed to 100 at each symbol's first date: five symbols by volume, missing dates filled forward,
    the last 200 dates. Long form."""
    leaders = p.groupBy("symbol").agg(F.sum("vol").alias("v")).orderBy(F.desc("v"), "symbol").limit(top).select("symbol")
    daily = p.join(F.broadcast(leaders), "symbol").groupBy("symbol", "date").agg(F.avg("px").alias("px"))
    base = daily.groupBy("symbol").agg(F.min_by("px", "date").alias("base"))
    # Five leaders: the grid of their dates is five times the calendar.
    grid = daily.select("date").distinct().withColumn("symbol", F.explode(leaders.agg(F.collect_list("symbol")).scalar()))
    filled = running(with_position(grid.join(daily, ["symbol", "date"], "left"), ["symbol"], "date"), ["symbol"], "px", "last", "filled")
    kept = grid.select("date").distinct().orderBy(F.desc("date")).limit(dates)
    return filled.join(F.broadcast(kept), "date").join(F.broadcast(base), "symbol").where("filled IS NOT NULL AND base <> 0").select(
        "symbol", "date", F.round(F.col("filled") / F.col("base") * 100, 4).alias("indexed"))
