"""Health scores of tables and columns, from one profile row per column plus the duplicate count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.profile import numeric_profile
from gridloom.operators.filters import distinct_counts
from gridloom.plans.stacked import numeric_columns, text_columns, wide_to_rows

# Weights of completeness, uniqueness, consistency, validity and structure per table type.
WEIGHTS = {
    "timeseries": (35, 15, 20, 15, 15), "financial_markets_timeseries": (34, 16, 20, 15, 15),
    "financial_markets_snapshot": (32, 18, 18, 17, 15), "transactional": (25, 30, 20, 15, 10),
    "survey": (30, 10, 25, 20, 15), "general": (30, 20, 20, 15, 15),
}
# Name words of the table-type scores.
TRANSACTION_WORDS = ["id", "order", "transaction", "invoice", "receipt", "ticket"]
AMOUNT_WORDS = ["amount", "price", "revenue", "cost", "qty", "quantity", "total", "sale"]
SURVEY_WORDS = ["rating", "score", "response", "satisfaction", "agree", "disagree", "rank", "feedback", "opinion"]


def _named(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(col).contains(w) for w in words])


def dataset_type(profile: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Type and confidence of every table in a profile catalogue (``column, type, rows, unique`` per table key)."""
    ratio = F.col("unique") / F.greatest("rows", F.lit(1))
    is_date, is_num, is_text = (F.col("type") == k for k in ("datetime", "numeric", "categorical"))
    tx = (ratio > 0.9) & _named(F.col("column"), TRANSACTION_WORDS)
    low = is_text & (F.col("unique") <= 10)
    s = profile.groupBy(*keys).agg(
        (F.sum(F.when(is_date & (ratio > 0.5), 3).when(is_date, 1).otherwise(0)) - 2 * F.count_if(tx)).alias("timeseries"),
        (3 * F.count_if(tx) + F.count_if(is_num & _named(F.col("column"), AMOUNT_WORDS))).alias("transactional"),
        (F.when(F.count_if(low) / F.nullif(F.count_if(is_text), F.lit(0)) > 0.5, 2).otherwise(0)
         + F.when(F.bool_or(_named(F.col("column"), SURVEY_WORDS)), 2).otherwise(0)).alias("survey"),
    )
    names = ["timeseries", "transactional", "survey"]
    best = F.greatest(*[F.col(n) for n in names])
    signal = reduce(lambda a, b: a + b, [F.abs(n) for n in names])
    none = (signal == 0) | (best <= 0)
    pick = F.when(none, "general").when(F.col("timeseries") == best, "timeseries").when(F.col("transactional") == best, "transactional").otherwise("survey")
    conf = F.when(none, 40).otherwise(F.bround(F.least(F.lit(95.0), F.greatest(F.lit(40.0), best / signal * 100 + 40))))
    return s.select(*keys, *[F.col(n).cast("bigint").alias(n) for n in names], pick.alias("dataset_type"), conf.cast("bigint").alias("confidence"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Surplus copies of identical rows (one number)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def table_facts(df: DataFrame) -> DataFrame:
    """One row: cell, null and null-row counts, whitespace and mixed-type column counts, duplicates."""
    texts = text_columns(df)
    parses = {c: F.avg(F.col(c).try_cast("double").isNotNull().cast("int")) for c in texts}
    zero = F.lit(0)
    agg = df.agg(
        F.count(F.lit(1)).alias("rows"),
        reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns]).alias("nulls"),
        F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns])).alias("null_rows"),
        (F.greatest(F.lit(False), *[F.bool_or(F.coalesce(F.trim(c) != F.col(c), F.lit(False))) for c in texts]) if texts else F.lit(False)).alias("untrimmed"),
        reduce(lambda a, b: a + b, [F.when((p > 0.1) & (p < 0.9), 1).otherwise(0) for p in parses.values()], zero).alias("mixed"),
    )
    return agg.withColumn("duplicates", duplicate_rows(df).scalar())


def health_score(df: DataFrame, kind: str = "general") -> DataFrame:
    """Five dimension scores, total and grade of one table."""
    wc, wu, wco, wv, ws = WEIGHTS[kind]
    nums = numeric_columns(df)
    uniq = distinct_counts(df, df.columns)
    const = F.lit(len(df.columns)) - uniq.agg(F.count_if(F.col("n_unique") > 1)).scalar()
    f = table_facts(df).withColumn("constant", const)
    if nums:
        p = numeric_profile(df, nums)
        big = F.col("n") > 10
        s = p.agg(F.struct(F.count_if((F.col("n") >= 4) & (F.col("q75") > F.col("q25")) & (F.col("outliers_iqr") > 0)).alias("outlier_cols"),
                           F.count_if(big & (F.abs("skewness") > 2)).alias("skewed"), F.count_if(big & (F.abs("skewness") > 3)).alias("very_skewed"),
                           F.max(F.when(F.col("q75") > F.col("q25"), F.col("outliers_iqr")).otherwise(0)).alias("outlier_rows"))).scalar()
        f = f.withColumn("_s", s).select("*", "_s.*").drop("_s")
    else:
        f = f.withColumns({c: F.lit(0) for c in ("outlier_cols", "skewed", "very_skewed", "outlier_rows")})
    zero = F.lit(0.0)
    missing = F.col("nulls") / F.greatest(F.col("rows") * len(df.columns), F.lit(1)) * 100
    dupes = F.col("duplicates") / F.greatest("rows", F.lit(1)) * 100
    cap = lambda x, top: F.least(x, F.lit(float(top)))
    scores = {
        "completeness": F.greatest(zero, wc - missing * (wc / 20)),
        "uniqueness": F.greatest(zero, wu - dupes * (wu / 10)),
        "consistency": F.greatest(zero, wco - F.when(F.col("untrimmed"), 2.0).otherwise(0.0) - cap(F.col("mixed") * 3.0, wco * 0.5)),
        "validity": F.greatest(zero, wv - cap(F.col("outlier_cols") * 2.0, wv * 0.7) - cap(F.col("skewed") * 1.0, wv * 0.3)),
        "structure": F.greatest(zero, ws - cap(F.col("constant") * 2.0, ws * 0.6) - cap(F.col("very_skewed") * 1.5, ws * 0.4)),
    }
    f = f.withColumns({k: F.round(v, 1) for k, v in scores.items()})
    total = F.round(reduce(lambda a, b: a + b, [F.col(k) for k in scores]), 1)
    return f.withColumn("total", total).select(
        *scores, "total", grade(F.col("total")).alias("grade"), F.col("null_rows").alias("unreliable_rows"),
        F.round(F.col("null_rows") / F.greatest("rows", F.lit(1)) * 100, 1).alias("unreliable_pct"),
        F.col("duplicates").alias("duplicate_rows"), F.col("outlier_rows").cast("bigint").alias("outlier_rows"))


def grade(total: Column) -> Column:
    return F.when(total >= 85, "A").when(total >= 70, "B").when(total >= 55, "C").when(total >= 40, "D").otherwise("F")


def column_health(df: DataFrame) -> DataFrame:
    """0 to 100 per column: missing share, outlier share, severe skew and constant numbers cost points."""
    nums = numeric_columns(df)
    b = wide_to_rows(df, df.columns, {"rows": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(F.col(c).isNull())})
    if nums:
        b = b.join(F.broadcast(numeric_profile(df, nums).select("column", "n", "q25", "q75", "outliers_iqr", "skewness", "n_unique")), "column", "left")
    else:
        b = b.withColumns({c: F.lit(None).cast("double") for c in ("n", "q25", "q75", "outliers_iqr", "skewness", "n_unique")})
    missing = F.col("missing") / F.greatest("rows", F.lit(1)) * 100
    outlier = F.when((F.col("n") >= 4) & (F.col("q75") > F.col("q25")), F.col("outliers_iqr") / F.col("n") * 100).otherwise(0.0)
    score = (
        100 - F.least(F.lit(40.0), missing * 1.5) - F.least(F.lit(20.0), outlier * 2)
        - F.when((F.col("n") > 2) & (F.abs("skewness") > 3), 5.0).otherwise(0.0)
        - F.when(F.col("n_unique") <= 1, 20.0).otherwise(0.0))
    return b.select("column", F.round(F.greatest(F.lit(0.0), score), 1).alias("score"))


def missingness(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Null counts and shares per column before and after cleaning, worst first."""
    def nulls(d, tag):
        return wide_to_rows(d, d.columns, {
            f"{tag}_missing": lambda c: F.count_if(F.col(c).isNull()),
            f"{tag}_pct": lambda c: F.round(F.count_if(F.col(c).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1)})
    return nulls(raw, "raw").join(nulls(cleaned, "clean"), "column", "left").orderBy(F.desc("raw_pct"), "column")


def key_columns(df: DataFrame) -> DataFrame:
    """Columns without nulls whose values are all distinct."""
    b = wide_to_rows(df, df.columns, {"rows": lambda c: F.count(F.lit(1)), "filled": lambda c: F.count(c)})
    return b.join(F.broadcast(distinct_counts(df, df.columns)), "column").where("filled = rows AND n_unique = rows").select("column")


