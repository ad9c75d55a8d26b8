"""Cleaning steps. Each step is a function from a table to a table; facts about all columns come from one aggregate.

Rows are identified by an explicit ``row_id`` column; "first" always means the smallest id.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import correlation_of, skew_g1
from gridloom.functions.patterns import (
    CURRENCY, DATE_FORMATS, FALSE_WORDS, NAME_WORDS, PERCENT, PLACEHOLDERS, PRESERVE_OUTLIERS, PROTECTED, SEMANTIC_EMAIL,
    SEMANTIC_IP, SEMANTIC_PHONE, SEMANTIC_ZIP, TRUE_WORDS,
)
from gridloom.operators.aggregates import category_counts
from gridloom.operators.filters import distinct_counts
from gridloom.plans.ordered import grouped_quantiles, neighbourhood, with_position
from gridloom.plans.stacked import numeric_columns, stack_numbers, stack_text, text_columns, wide_to_rows


# --- text and structure -------------------------------------------------------------------------------------------

def is_placeholder(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c)).isin(PLACEHOLDERS), F.lit(False))


def placeholders_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or text_columns(df))
    return df.withColumns({c: F.when(~is_placeholder(c), F.col(c)) for c in cols}) if cols else df


def placeholder_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return wide_to_rows(df, list(cols or text_columns(df)), {"replaced": lambda c: F.count_if(is_placeholder(c))})


def drop_empty(df: DataFrame, row_id: str) -> DataFrame:
    """Without rows and columns that hold no value at all (``row_id`` aside)."""
    cols = [c for c in df.columns if c != row_id]
    filled = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    keep = [c for c in cols if filled[c] > 0]
    return df.select(row_id, *keep).na.drop("all", subset=keep)


def drop_duplicate_rows(df: DataFrame, row_id: str) -> DataFrame:
    """One row per distinct content, with the smallest id; copies are combined before the shuffle."""
    cols = [c for c in df.columns if c != row_id]
    return df.groupBy(*cols).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def duplicate_columns(df: DataFrame, row_id: str) -> list[tuple[str, str]]:
    """(later, earlier) pairs of columns with identical values: a row-wise hash sum first, then an exact comparison."""
    kinds = {c: t for c, t in df.dtypes if c != row_id}
    sums = df.agg(*[F.sum(F.xxhash64(F.col(c), F.col(row_id)).cast("decimal(38,0)")).alias(c) for c in kinds]).first()
    cols = list(kinds)
    pairs = [(b, a) for i, a in enumerate(cols) for b in cols[i + 1:] if kinds[a] == kinds[b] and sums[a] == sums[b]]
    if not pairs:
        return []
    same = df.agg(*[F.bool_and(F.col(b).eqNullSafe(F.col(a))).alias(f"_{i}") for i, (b, a) in enumerate(pairs)]).first()
    out, gone = [], set()
    for i, (b, a) in enumerate(pairs):
        if same[f"_{i}"] and a not in gone and b not in gone:
            out.append((b, a))
            gone.add(b)
    return out


def drop_duplicate_columns(df: DataFrame, row_id: str) -> DataFrame:
    return df.drop(*[b for b, _ in duplicate_columns(df, row_id)])


def snake_case(name: str) -> str:
    text = re.sub(r"\s+", "_", name.strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "_", text)).strip("_")


def unique_names(names: Sequence[str]) -> list[str]:
    """Names with a running number where one repeats: ``age, age_1``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, -1) + 1
        seen[n] = k
        out.append(n if k == 0 else f"{n}_{k}")
    return out


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([snake_case(c) for c in df.columns]))


def trim_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or text_columns(df))
    return df.withColumns({c: F.trim(c) for c in cols}) if cols else df


def is_upper(c: str) -> Column:
    """Cased text without a lower-case letter."""
    return (F.col(c) == F.upper(c)) & (F.col(c) != F.lower(c))


def text_facts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column: values a trim would change and the share of ALL-CAPS values."""
    return wide_to_rows(df, list(cols or text_columns(df)), {
        "untrimmed": lambda c: F.count_if(F.trim(c) != F.col(c)),
        "upper_share": lambda c: F.coalesce(F.round(F.avg(is_upper(c).cast("int")), 4), F.lit(0.0)),
    })


def titled(c: str | Column) -> Column:
    """Every run of letters starts upper-case and goes on lower-case."""
    runs = F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def title_case(df: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Columns of which more than 70 % of the values are ALL-CAPS become Title Case."""
    cols = [c for c in text_columns(df) if c not in protected]
    if not cols:
        return df
    share = df.agg(*[F.avg(is_upper(c).cast("int")).alias(c) for c in cols]).first()
    change = [c for c in cols if (share[c] or 0) > 0.7]
    return df.withColumns({c: titled(c) for c in change}) if change else df


# --- semantic columns ------------------------------------------------------------------------------------------------

def _has_word(name: str, words: Sequence[str]) -> bool:
    return bool(set(re.split(r"[_\s]+", name)) & set(words))


def parse_dates(c: str | Column, formats: Sequence[tuple[str, str]] = tuple(DATE_FORMATS)) -> Column:
    """First format that fits, in the fixed order of precedence; a text is only parsed where its shape fits."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*[F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(f))) for f, shape in formats]).cast("timestamp_ntz")


def semantic_columns(df: DataFrame) -> dict[str, str]:
    """Semantic type of the columns that need care, from names first and value rates (all rows) second."""
    texts = text_columns(df)
    low = {c: c.lower() for c in df.columns}
    idish = [c for c in df.columns if _has_word(low[c], NAME_WORDS["id"]) or low[c].endswith("id") or low[c].startswith("id_")]
    out: dict[str, str] = {}
    undecided = []
    for c in df.columns:
        hit = next((k for k in ("email", "phone", "postal", "sku", "account_number") if _has_word(low[c], NAME_WORDS[k])), None)
        if hit:
            out[c] = hit
        else:
            undecided.append(c)
    probe_ids = [c for c in undecided if c in idish]
    if probe_ids:
        rows = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in probe_ids]).first()
        for r in distinct_counts(df, probe_ids).collect():
            if rows[r["column"]] >= 5 and r["n_unique"] / max(rows["n"], 1) > 0.85:
                out[r["column"]] = "id"
    for c in undecided:
        if c not in out and _has_word(low[c], NAME_WORDS["revenue"]):
            out[c] = "revenue"
    rest = [c for c in texts if c not in out]
    if rest:
        rules = [("email", SEMANTIC_EMAIL, 0.7), ("phone", SEMANTIC_PHONE, 0.7), ("postal", SEMANTIC_ZIP, 0.7), ("ip_address", SEMANTIC_IP, 0.8)]
        rates = df.agg(*[
            F.struct(F.avg(parse_dates(c).isNotNull().cast("int")).alias("date"),
                     *[F.avg(F.when(F.col(c).isNotNull(), F.col(c).rlike(rx).cast("int"))).alias(k) for k, rx, _ in rules]).alias(c)
            for c in rest]).first()
        for c in rest:
            if (rates[c]["date"] or 0) >= 0.8:
                continue
            hit = next((k for k, _, lim in rules if (rates[c][k] or 0) >= lim), None)
            if hit:
                out[c] = hit
    return out


# --- types ---------------------------------------------------------------------------------------------------------------

#: Every text that can be cast to a double, and few others: a cast that fails costs more than all other tests together.
READABLE = r"^[\x00-\x20]*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?[dDfF]?|0[xX]\S*|[iInN]\S*)[\x00-\x20]*$"


def read_double(text: Column) -> Column:
    return F.when(text.rlike(READABLE), text.try_cast("double"))


def currency_value(c: str) -> Column:
    return read_double(F.regexp_replace(c, r"[€$£¥₹,\s()]", ""))


def percent_value(c: str) -> Column:
    return read_double(F.regexp_replace(c, r"\s*%", ""))


def type_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Shares of each text column's values that read as currency, percent, number or date (any format, and per format).

    All columns are stacked, so every test is one expression and every format is parsed once per value.
    """
    cols = list(cols or text_columns(df))
    v = stack_text(df, cols).where("value IS NOT NULL")
    fits = {f"f{i}": parse_dates("value", [fmt]).isNotNull() for i, fmt in enumerate(DATE_FORMATS)}
    v = v.select("column", "value", *[c.alias(k) for k, c in fits.items()])
    share = lambda cond: F.avg(cond.cast("int"))
    any_date = reduce(lambda a, b: a | b, [F.col(k) for k in fits])
    frequent = reduce(lambda a, b: a + b, [F.when(share(F.col(k)) > 0.5, 1).otherwise(0) for k in fits])
    found = v.groupBy("column").agg(
        F.count(F.lit(1)).alias("filled"), share(F.col("value").rlike(CURRENCY)).alias("currency"),
        share(currency_value("value").isNotNull()).alias("currency_read"), share(F.col("value").rlike(r"[€$£¥₹,]")).alias("symbol"),
        share(F.col("value").rlike(PERCENT)).alias("percent"), share(percent_value("value").isNotNull()).alias("percent_read"),
        share(read_double(F.trim("value")).isNotNull()).alias("number"), share(any_date).alias("any_date"), frequent.alias("date_formats"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(found, "column", "left").na.fill(0)


def type_decisions(rates: DataFrame) -> DataFrame:
    """Target type per text column; ``currency`` is only named so when a symbol or separator occurs."""
    money = (F.col("currency") >= 0.95) & (F.col("currency_read") > 0.95)
    target = (
        F.when(F.col("filled") == 0, "text").when(money & (F.col("symbol") > 0), "currency").when(money, "number")
        .when((F.col("percent") >= 0.9) & (F.col("percent_read") > 0.9), "percent").when(F.col("number") > 0.9, "number")
        .when((F.col("date_formats") >= 2) & (F.col("any_date") > 0.8), "mixed_dates").when(F.col("any_date") > 0.9, "date").otherwise("text"))
    return rates.select("column", target.alias("target"), "filled")


def retype(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """All retyped columns in one projection."""
    how = {"currency": currency_value, "percent": percent_value, "number": lambda c: read_double(F.regexp_replace(F.trim(c), ",", "")),
           "mixed_dates": parse_dates, "date": parse_dates}
    new = {c: how[t](c) for c, t in targets.items() if t in how}
    return df.withColumns(new) if new else df


def boolean_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Text columns whose values are all words for true or false, of both kinds of spelling that need unifying."""
    cols = list(cols or text_columns(df))
    words = TRUE_WORDS + FALSE_WORDS
    if not cols:
        return []
    v = {c: F.lower(F.trim(c)) for c in cols}
    # The collected set only ever holds words of the fixed list.
    facts = df.agg(*[F.struct(F.bool_and(v[c].isin(words)).alias("all"), F.collect_set(F.when(v[c].isin(words), v[c])).alias("set")).alias(c)
                     for c in cols]).first()
    canonical = ({"yes", "no"}, {"true", "false"}, {"1", "0"})
    return [c for c in cols if facts[c]["all"] and len(facts[c]["set"]) >= 2 and set(facts[c]["set"]) not in canonical]


def unify_booleans(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    v = lambda c: F.lower(F.trim(c))
    return df.withColumns({c: F.when(v(c).isin(TRUE_WORDS), "yes").when(v(c).isin(FALSE_WORDS), "no") for c in cols}) if cols else df


# --- missing values -----------------------------------------------------------------------------------------------------

def null_shares(df: DataFrame) -> DataFrame:
    return wide_to_rows(df, df.columns, {
        "missing": lambda c: F.count_if(F.col(c).isNull()),
        "missing_pct": lambda c: F.round(F.count_if(F.col(c).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1)})


def drop_sparse(df: DataFrame, limit: float = 60.0) -> DataFrame:
    share = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (share[c] or 0) > limit])


def numeric_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians, one number per column."""
    q = grouped_quantiles(stack_numbers(df, cols), ["column"], "value", {"m": 0.5}, few_keys=True)
    return {r["column"]: r["m"] for r in q.collect()}


def missingness_mechanism(df: DataFrame, row_id: str, cols: Sequence[str] | None = None) -> DataFrame:
    """MCAR, MAR or MNAR per column with nulls.

    MAR: the null flag follows another number (|r| > 0.25, medians filled in, 15 numbers at most). MNAR: it follows the
    column's own value one row earlier (|r| > 0.4).
    """
    nums = [c for c in numeric_columns(df) if c != row_id]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    cols = [c for c in (cols or df.columns) if c != row_id and counts[c] > 0]
    schema = "column string, mechanism string, strength double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    med = numeric_medians(df, nums)
    own = [c for c in cols if c in nums]
    rows = df
    if own:
        rows = neighbourhood(with_position(df, [], row_id), [], lambda frame: {
            f"_prev_{c}": F.lag(c).over(frame(None, None)) for c in own}, before=1, after=0)
    packed = rows.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), F.count(c).alias("filled"),
            F.array(*[correlation_of(F.col(c).isNull().cast("double"), F.coalesce(F.col(o).cast("double"), F.lit(med[o])))
                      for o in nums if o != c] or [F.lit(None).cast("double")]).alias("rs"),
            (correlation_of(F.when(F.col(f"_prev_{c}").isNotNull(), F.col(c).isNull().cast("double")), F.col(f"_prev_{c}").cast("double"))
             if c in own else F.lit(None).cast("double")).alias("self"),
        ).alias(f"_{i}") for i, c in enumerate(cols)])
    m = packed.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))
    strongest = F.coalesce(F.array_max(F.transform("rs", lambda r: F.abs(F.nanvl(r, F.lit(0.0))))), F.lit(0.0))
    few = F.col("missing") < 3
    mnar = (F.col("filled") >= 10) & (F.abs("self") > 0.4)
    return m.withColumn("_r", strongest).select(
        "column", F.when(few, "mcar").when(mnar, "mnar").when(F.col("_r") > 0.25, "mar").otherwise("mcar").alias("mechanism"),
        F.round(F.when(few, 0.0).when(mnar, F.abs("self")).otherwise(F.col("_r")), 4).alias("strength"))


def fill_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value and method per column: median below three values or |skew| > 1, else mean; the mode for text."""
    nums = [c for c in cols if c in numeric_columns(df)]
    texts = [c for c in cols if c not in nums]
    parts = []
    if nums:
        s = wide_to_rows(df, nums, {"n": lambda c: F.count(c), "mean": lambda c: F.avg(c), "skew": lambda c: skew_g1(c)})
        m = grouped_quantiles(stack_numbers(df, nums), ["column"], "value", {"median": 0.5}, few_keys=True).drop("n")
        use_median = (F.col("n") < 3) | (F.abs("skew") > 1)
        parts.append(s.join(m, "column").select(
            "column", F.when(use_median, "median").otherwise("mean").alias("method"),
            F.when(use_median, F.col("median")).otherwise(F.col("mean")).alias("number"), F.lit(None).cast("string").alias("text")))
    if texts:
        parts.append(category_counts(df, texts).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("text")).select(
            "column", F.lit("mode").alias("method"), F.lit(None).cast("double").alias("number"), "text"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def impute_simple(df: DataFrame, cols: Sequence[str], flag: Sequence[str] = ()) -> DataFrame:
    """Nulls replaced by the column's fill value; ``flag`` columns also get ``<col>_was_missing``."""
    kinds = dict(df.dtypes)
    fills = {r["column"]: (r["number"] if r["number"] is not None else r["text"]) for r in fill_values(df, cols).collect()}
    new = {f"{c}_was_missing": F.col(c).isNull().cast("int") for c in flag}
    for c, v in fills.items():
        keep_double = kinds[c] in ("tinyint", "smallint", "int", "bigint")
        new[c] = F.coalesce(F.col(c).cast("double") if keep_double else F.col(c), F.lit(v).cast("double" if keep_double else kinds[c]))
    return df.withColumns(new) if new else df


# --- outliers -----------------------------------------------------------------------------------------------------------

def outlier_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fences per column: 3 x IQR when |skew| > 1 and the IQR is positive, else mean +- 4 standard deviations."""
    s = wide_to_rows(df, cols, {"n": lambda c: F.count(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "skew": lambda c: skew_g1(c)})
    q = grouped_quantiles(stack_numbers(df, cols), ["column"], "value", {"q1": 0.25, "q3": 0.75}, few_keys=True).drop("n")
    iqr = F.col("q3") - F.col("q1")
    fence = (F.abs("skew") > 1) & (iqr > 0)
    b = s.join(q, "column").select(
        "column", "n", F.when(fence, F.col("q1") - 3 * iqr).otherwise(F.col("mean") - 4 * F.col("std")).alias("lower"),
        F.when(fence, F.col("q3") + 3 * iqr).otherwise(F.col("mean") + 4 * F.col("std")).alias("upper"),
        F.when(fence, "iqr").when(F.col("std") == 0, "constant").otherwise("sigma").alias("method"))
    outside = stack_numbers(df, cols).join(F.broadcast(b.select("column", "lower", "upper")), "column").groupBy("column").agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("outside"))
    return b.join(outside, "column")


def outlier_strategy(name: str, semantic: str | None) -> str:
    if semantic in PROTECTED or semantic == "revenue" or re.search(PRESERVE_OUTLIERS, name, re.I):
        return "preserve"
    return "winsorize"


def treat_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]], strategy: str) -> DataFrame:
    """Clip to the fences (``winsorize``/``cap``), flag beside, null outside values (``isolate``) or keep (``preserve``)."""
    new: dict[str, Column] = {}
    for c, (lo, hi) in bounds.items():
        out = (F.col(c) < lo) | (F.col(c) > hi)
        if strategy in ("winsorize", "cap"):
            new[c] = F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo)))
        elif strategy == "flag_only":
            new[f"{c}_is_outlier"] = F.coalesce(out, F.lit(False))
        elif strategy == "isolate":
            new[c] = F.when(~out, F.col(c))
    return df.withColumns(new) if new else df


def suspicious_zeros(df: DataFrame, cols: Sequence[str] | None = None, share: float = 0.10) -> DataFrame:
    """Numbers with 10 % or more exact zeros (20 values up, neither constant nor two-valued)."""
    cols = list(cols or numeric_columns(df))
    z = wide_to_rows(df, cols, {"n": lambda c: F.count(c), "zeros": lambda c: F.count_if(F.col(c) == 0),
                                "span": lambda c: (F.max(c) - F.min(c)).cast("double")})
    return z.join(F.broadcast(distinct_counts(df, cols)), "column").where(
        (F.col("n") >= 20) & (F.col("zeros") / F.col("n") >= share) & (F.col("span") != 0) & (F.col("n_unique") > 2)
    ).select("column", F.col("zeros").alias("zero_count"), F.round(F.col("zeros") / F.col("n") * 100, 1).alias("zero_pct"))


# --- confidence ----------------------------------------------------------------------------------------------------------

def confidence_score(facts: DataFrame) -> DataFrame:
    """0 to 100 with five capped penalties, grade and label, from one row of cleaning counts per table.

    ``facts``: ``rows, cols, missing_pct, placeholders, suspicious, winsorized, duplicate_cols`` plus any keys.
    """
    cells = F.greatest(F.col("rows") * F.col("cols"), F.lit(1))
    cap = lambda x, top: F.least(x, F.lit(float(top)))
    score = (
        100 - cap(F.col("missing_pct") * 0.5, 30) - cap(F.col("placeholders") / cells * 100 * 0.4, 20) - cap(F.col("suspicious") * 5.0, 20)
        - cap(F.col("winsorized") / cells * 100 * 0.3, 15) - cap(F.col("duplicate_cols") * 2.0, 10))
    s = F.col("score")
    return facts.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score))).cast("bigint")).withColumn(
        "grade", F.when(s >= 90, "A+").when(s >= 80, "A").when(s >= 65, "B").when(s >= 50, "C").otherwise("D")).withColumn(
        "label", F.when(s >= 90, "Analyst Ready").when(s >= 80, "High Quality").when(s >= 65, "Good").when(s >= 50, "Needs Review")
        .otherwise("Significant Issues"))


def ranked_audit(audit: DataFrame) -> DataFrame:
    """Audit entries per kind: number of steps and rows or columns they touched."""
    return audit.groupBy("kind").agg(F.count(F.lit(1)).alias("steps"), F.sum("affected").alias("affected"))
