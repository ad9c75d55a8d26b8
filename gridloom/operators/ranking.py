"""Ranking, suppression, penalties and selection over a table of findings keyed by ``run_id``.

Findings: ``run_id, seq, type, severity, confidence (0..100), title, columns array<string>, is_target_driver, domain``.
Whole run histories are handled at once; per-run lists are cut by ranks that map tasks apply before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.semantic import FINANCE_NAMES, normal_name

CAP, CANDIDATES = 15, 45
SNAPSHOT, TIMESERIES = "financial_markets_snapshot", "financial_markets_timeseries"
OVERLAP_TITLE = "Price fields are highly overlapping"
# Headline titles in their order.
HEADLINES = {
    SNAPSHOT: ["Top return leaders", "Largest return laggards", "Highest volatility assets", "Best risk-adjusted performers",
               "Asset classes show different return profiles", "Sectors show different return profiles", "Highest analyst-implied upside",
               "Assets cluster at different 52-week positions"],
    TIMESERIES: ["Top performers by total return", "Worst performers by total return", "Highest volatility symbols", "Largest drawdowns",
                 "Highest volume symbols", "Strongest trend symbols", "Symbols with incomplete histories", "Unusual price movement days"],
}
# Weights and boosts of the composite score.
SEVERITY = {"high": 1.0, "medium": 0.6, "low": 0.2}
TARGET_BONUS, BOOST_HEADLINE, BOOST_DOMAIN, BOOST_CAVEAT, CORRELATION_FACTOR = 0.30, 0.17, 0.11, 0.035, 0.52
BOOST_RECOMMENDED, BOOST_DEPRIORITISED = 0.05, -0.03
# Finding types served by each analysis type.
ANALYSIS_TYPES = {
    "trend_analysis": ["trend"], "segment_comparison": ["segment"], "correlation_analysis": ["correlation", "multicollinearity", "interaction"],
    "anomaly_detection": ["anomaly"], "distribution_analysis": ["distribution", "concentration", "simpsons_paradox"],
    "target_analysis": ["trend", "correlation", "leading_indicator"],
}
# Price columns that move together, beside the open-high-low-close names.
PRICE_NAMES = ["open", "daylow", "dayhigh", "currentprice", "previousclose", "regularmarketprice", "fiftytwoweeklow", "fiftytwoweekhigh", "fiftydayaverage",
               "twohundreddayaverage", "pricelatest", "sma50", "sma200", "pricevssma50pct", "pricevssma200pct"] + FINANCE_NAMES["ohlc_price"]
IDENTIFIER_NAMES = ["ticker", "symbol", "shortname", "longname", "fundsymbol"]
OPPORTUNITY = ["correlation", "segment", "leading_indicator", "concentration", "trend", "interaction"]
RISK = ["anomaly", "data_quality", "multicollinearity", "simpsons_paradox", "missing_pattern"]


def _pick(col: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def safe_confidence(c: str = "confidence") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(50.0)), F.lit(50.0))))


def strategy_boost(recommended: list[str], deprioritised: list[str]) -> Column:
    types = lambda names: sorted({t for n in names for t in ANALYSIS_TYPES.get(n, [])})
    good, bad = types(recommended), types(deprioritised)
    return F.when(F.col("type").isin(good), BOOST_RECOMMENDED).when(F.col("type").isin(bad), BOOST_DEPRIORITISED).otherwise(0.0)


def composite_score(context: str | None = None, recommended: list[str] | None = None, deprioritised: list[str] | None = None) -> Column:
    """Half severity, a quarter confidence, a quarter target bonus, plus domain and strategy boosts, at most 1."""
    base = _pick(F.col("severity"), SEVERITY, 0.2) * 0.5 + safe_confidence() / 100 * 0.25 + F.when(F.col("is_target_driver"), TARGET_BONUS).otherwise(0.0) * 0.25
    domain = F.coalesce("domain", F.lit(""))
    bonus = F.lit(0.0)
    for d in [context] if context else [SNAPSHOT, TIMESERIES]:
        own = F.when(F.col("title") == OVERLAP_TITLE, BOOST_CAVEAT).when(F.col("title").isin(HEADLINES.get(d, [])), BOOST_HEADLINE).otherwise(BOOST_DOMAIN)
        bonus = F.when(domain == d, own).otherwise(bonus)
    score = F.least(F.lit(1.0), base + bonus + strategy_boost(recommended or [], deprioritised or []))
    if context in HEADLINES:
        score = F.when((F.col("type") == "correlation") & (domain != context), score * CORRELATION_FACTOR).otherwise(score)
    return score


def column_key() -> Column:
    """Finding identity: its normalised columns, or its title where it names none."""
    cols = F.array_sort(F.array_distinct(F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))))
    return F.when(F.size(cols) > 0, F.array_join(cols, "|")).otherwise(F.lower("title"))


def deduplicate(findings: DataFrame, order: Column | None = None) -> DataFrame:
    """The first finding per (run, type, columns) in order; combined before the shuffle."""
    d = findings.withColumn("_key", column_key()).withColumn("_ord", order if order is not None else F.struct("seq"))
    row = F.struct(*findings.columns)
    return d.groupBy("run_id", "type", "_key").agg(F.min_by(row, "_ord").alias("_r")).select("_r.*")


def place(context: str | None) -> Column:
    """(tier, order within the tier): headlines, other domain findings, caveat, generic ones, correlations."""
    if context not in HEADLINES:
        return F.struct(F.lit(0).alias("tier"), F.lit(0).alias("at"))
    own = F.coalesce(F.col("domain") == context, F.lit(False))
    order = F.lit(0)
    for i, t in enumerate(HEADLINES[context]):
        order = F.when(F.col("title") == t, i).otherwise(order)
    head = own & F.col("title").isin(HEADLINES[context])
    tier = (F.when(head, 0).when(own & (F.col("title") == OVERLAP_TITLE), 2).when(own, 1).when(F.col("type") == "correlation", 4).otherwise(3))
    return F.struct(tier.alias("tier"), F.when(head, order).otherwise(0).alias("at"))


def rank_findings(findings: DataFrame, context: str | None = None, limit: int | None = None) -> DataFrame:
    """Deduplicated findings of every run with score and rank: all, or the first ``limit``."""
    scored = findings.withColumn("score", composite_score(context)).withColumn("_p", place(context))
    order = F.struct(F.col("_p.tier"), F.col("_p.at"), -F.col("score"), F.col("seq"))
    unique = deduplicate(scored, F.struct("seq") if context in HEADLINES else order)
    w = Window.partitionBy("run_id").orderBy("_p.tier", "_p.at", F.desc("score"), "seq")
    return unique.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit if limit is not None else F.lit(True)).withColumn("rank", F.col("rank").cast("bigint")).drop("_p")


def suppress_redundant(findings: DataFrame, context: str) -> DataFrame:
    """Findings of finance runs without trends, price-only structure and identifier columns; one caveat per run when two or
    more price overlaps were removed."""
    if context not in HEADLINES:
        return findings
    own = F.coalesce(F.col("domain").isin(SNAPSHOT, TIMESERIES), F.lit(False))
    cols = F.coalesce("columns", F.array().cast("array<string>"))
    price = lambda c: normal_name(c).isin(PRICE_NAMES)
    hits = F.size(F.filter(cols, price))
    overlap = ~own & (
        ((F.col("type") == "correlation") & (F.size(cols) == 2) & (hits == 2))
        | ((F.col("type") == "multicollinearity") & (hits * 2 > F.size(cols))))
    last = F.try_element_at(cols, F.lit(-1))
    single = F.col("type").isin("anomaly", "concentration") & (F.size(cols) == 1) & (hits == 1)
    gap = (F.col("type") == "segment") & (F.size(cols) == 2) & F.coalesce(price(last), F.lit(False))
    identifier = (F.col("type") == "data_quality") & F.exists(cols, lambda c: normal_name(c).isin(IDENTIFIER_NAMES)) & F.col("title").startswith("High-cardinality")
    gone = ~own & ((F.col("type") == "trend") | single | gap | identifier)
    marked = findings.withColumn("_overlap", F.coalesce(overlap, F.lit(False))).withColumn("_gone", F.coalesce(gone, F.lit(False)))
    kept = marked.where("NOT _overlap AND NOT _gone").drop("_overlap", "_gone")
    named = marked.where("_overlap").withColumn("_c", F.explode(F.filter(cols, price)))
    # The affected names come from the fixed price list.
    caveat = marked.groupBy("run_id").agg(F.count_if("_overlap").alias("_n"), F.max("seq").alias("_last")).where("_n >= 2").join(
        named.groupBy("run_id").agg(F.array_sort(F.collect_set("_c")).alias("columns")), "run_id").select(
        "run_id", (F.col("_last") + 1).alias("seq"), F.lit("multicollinearity").alias("type"), F.lit("medium").alias("severity"), F.lit(85.0).alias("confidence"),
        F.lit(OVERLAP_TITLE).alias("title"), "columns", F.lit(False).alias("is_target_driver"), F.lit(context).alias("domain"))
    return kept.unionByName(caveat)


DATE_PART = r"_(month|quarter|year|week|weekday|day|dayofweek|weekend|is_weekend|wday)$"
REAL_DATE = r"(date|time|timestamp|_at$|_on$)"


def _norm(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def plan_penalties(findings: DataFrame, plan: DataFrame) -> DataFrame:
    """Confidence cut by 0.40 where all columns are ignored ones and by 0.35 for date parts of a time column.

    ``plan``: ``run_id, column, use`` with use ``time`` or ``ignore``. Findings meet their run's plan column by column.
    """
    cols = findings.select("run_id", "seq", "type", F.explode_outer(F.array_distinct(F.transform(F.coalesce("columns", F.array().cast("array<string>")), _norm))).alias("col"))
    cols = cols.withColumn("base", F.when(F.col("col").rlike(DATE_PART), F.regexp_replace("col", DATE_PART, "")))
    p = plan.select(F.col("run_id").alias("_run"), _norm("column").alias("_c"), "use").distinct()
    ign, tim = p.where("use = 'ignore'").drop("use"), p.where("use = 'time'").drop("use")
    j = cols.join(ign, (F.col("run_id") == F.col("_run")) & (F.col("col") == F.col("_c")), "left").select(*cols.columns, F.col("_c").isNotNull().alias("ign"))
    j = j.join(tim, (F.col("run_id") == F.col("_run")) & (F.col("base") == F.col("_c")), "left").select(*j.columns, F.col("_c").isNotNull().alias("part"))
    f = j.where("col IS NOT NULL").groupBy("run_id", "seq", "type").agg(
        F.bool_and("ign").alias("all_ignored"), F.bool_or("part").alias("any_part"), F.bool_or(~F.col("part") & F.col("col").rlike(REAL_DATE)).alias("real"))
    out = findings.join(f.drop("type"), ["run_id", "seq"], "left")
    ignored = F.coalesce("all_ignored", F.lit(False))
    part = F.coalesce("any_part", F.lit(False)) & ~((F.col("type") == "trend") & F.coalesce("real", F.lit(False)))
    return out.withColumn("penalty", F.when(ignored, "ignored_column").when(part, "date_part_feature")).withColumn(
        "confidence", safe_confidence() * F.when(ignored, 0.40).when(part, 0.35).otherwise(1.0)).withColumn(
        "suppressed", F.col("penalty").isNotNull()).drop("all_ignored", "any_part", "real")


# Confidence factor per structural risk.
RISK_FACTORS = {"date_part_artifacts": 0.35, "high_cardinality_dimensions": 0.50, "possible_leakage": 0.25, "target_leakage_risk": 0.25, "constant_columns": 0.30}


def profile_penalties(findings: DataFrame, risks: DataFrame) -> DataFrame:
    """Confidence cut by every structural risk among a finding's columns. ``risks``: ``run_id, column, risk``."""
    cols = findings.select("run_id", "seq", "type", F.explode(F.transform(F.coalesce("columns", F.array().cast("array<string>")), _norm)).alias("col"))
    r = risks.select("run_id", _norm("column").alias("col"), "risk").distinct()
    hit = cols.join(r, ["run_id", "col"]).where((F.col("risk") != "high_cardinality_dimensions") | F.col("type").isin("segment", "segment_comparison", "comparison", "distribution"))
    group = F.when(F.col("risk").isin("possible_leakage", "target_leakage_risk"), "leakage").otherwise(F.col("risk"))
    once = hit.select("run_id", "seq", group.alias("g"), _pick(F.col("risk"), RISK_FACTORS, 1.0).alias("f")).distinct()
    factor = once.groupBy("run_id", "seq").agg(F.product("f").alias("factor"))
    return findings.join(factor, ["run_id", "seq"], "left").withColumn("profile_suppressed", F.col("factor").isNotNull()).withColumn(
        "new_confidence", safe_confidence() * F.coalesce("factor", F.lit(1.0))).drop("factor")


def penalty_gate(penalised: DataFrame, max_share: float = 0.50, max_drop: float = 60.0) -> DataFrame:
    """Per run: penalised share, largest confidence drop and whether both stay below their limits."""
    g = penalised.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("profile_suppressed").alias("penalised"),
        F.max(safe_confidence() - F.col("new_confidence")).alias("drop"))
    share = F.col("penalised") / F.col("findings")
    return g.select("run_id", "findings", "penalised", F.round(share, 4).alias("share"), F.col("drop").alias("largest_drop"),
                    F.when(share >= max_share, "too_many_penalised").when(F.col("drop") >= max_drop, "drop_too_large").otherwise("ok").alias("verdict"))


def rerank(penalised: DataFrame, recommended: list[str] | None = None, deprioritised: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Suppressed findings below the others, then by score, then in the old order: all, or the first ``limit``."""
    s = penalised.withColumn("score", composite_score(None, recommended, deprioritised))
    w = Window.partitionBy("run_id").orderBy(F.col("suppressed").cast("int"), F.desc("score"), "seq")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit if limit is not None else F.lit(True)).withColumn("rank", F.col("rank").cast("bigint"))


def eligible(min_confidence: float = 50.0) -> Column:
    return ~F.coalesce(F.col("suppressed"), F.lit(False)) & (safe_confidence() >= min_confidence)


def executive_split(findings: DataFrame) -> DataFrame:
    """Up to four opportunities, four risks and five actions per run from the eligible findings, in rank order."""
    strong = F.col("severity").isin("high", "medium")
    sides = F.array_compact(F.array(
        F.when(F.col("type").isin(OPPORTUNITY) & strong, F.struct(F.lit("opportunity").alias("side"), F.lit(4).alias("room"))),
        F.when(F.col("type").isin(RISK) & strong, F.struct(F.lit("risk").alias("side"), F.lit(4).alias("room"))),
        F.struct(F.lit("action").alias("side"), F.lit(5).alias("room"))))
    long = findings.where(eligible()).select("run_id", "rank", "title", F.inline(sides))
    w = Window.partitionBy("run_id", "side").orderBy("rank")
    return long.withColumn("place", F.row_number().over(w)).where("place <= 5 AND place <= room").select(
        "run_id", "side", F.col("place").cast("bigint").alias("place"), "title")


def finding_ids(findings: DataFrame) -> DataFrame:
    """Stable 12-digit ids from type, columns and title (``_2``, ``_3`` on collision) and the report-safe flag."""
    key = F.concat(F.col("type"), F.lit(":"), F.array_join(F.array_sort(F.coalesce("columns", F.array().cast("array<string>"))), "|"), F.lit(":"), F.col("title"))
    d = findings.withColumn("_id", F.substring(F.md5(key), 1, 12))
    w = Window.partitionBy("run_id", "_id").orderBy("seq")
    n = F.row_number().over(w)
    conf = F.round(safe_confidence() / 100, 4)
    safe = F.col("severity").isin("high", "medium") & (conf >= 0.6) & ~F.col("type").isin("data_quality", "missing_pattern") & ~F.coalesce(F.col("suppressed"), F.lit(False))
    return d.withColumn("_n", n).withColumn("insight_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_n").cast("string")))).withColumn(
        "report_safe", safe).drop("_id", "_n")


def default_selection(findings: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """The default report pick of each run: report-safe findings first (five at most), topped up to three."""
    sev = _pick(F.lower("severity"), {"high": 0, "medium": 1, "low": 2}, 3)
    dq = F.col("type").isin("data_quality", "missing_pattern")
    strong = F.col("severity").isin("high", "medium")
    safe = F.col("report_safe")
    runs = findings.groupBy("run_id").agg(F.count_if(safe).alias("n_safe"), F.count_if(~dq & strong).alias("n_good"))
    d = findings.join(runs, "run_id")
    any_safe = F.col("n_safe") > 0
    tier = (F.when(any_safe & safe, 0).when(~dq & strong, 1).when(any_safe & strong, 2).otherwise(3))
    inner = F.when((tier == 0) | (tier == 3), 0).otherwise(sev)
    w = Window.partitionBy("run_id").orderBy(tier, inner, "rank")
    room = F.when(any_safe, F.greatest(F.least("n_safe", F.lit(high)), F.lit(low))).otherwise(
        F.when(F.col("n_good") == 0, F.lit(high)).otherwise(F.greatest(F.least("n_good", F.lit(high)), F.lit(low))))
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= high).where(F.col("_n") <= room).select(
        "run_id", F.col("_n").cast("bigint").alias("place"), "insight_id")


def selection_counters(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    a = candidates.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("suppressed").alias("suppressed_candidates"))
    b = visible.groupBy("run_id").agg(F.count(F.lit(1)).alias("visible"), F.count_if("suppressed").alias("suppressed_visible"), F.count_if(eligible()).alias("eligible_visible"))
    return a.join(b, "run_id", "left").na.fill(0)


