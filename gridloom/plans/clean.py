"""The cleaning flow: the steps in their fixed order with a typed audit table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.patterns import PROTECTED
from gridloom.operators import cleaning as cl
from gridloom.operators.filters import calendar_features, distinct_counts
from gridloom.plans.stacked import numeric_columns, text_columns
from gridloom.session import settle

AUDIT_SCHEMA = "seq bigint, kind string, column string, detail string, affected bigint, impact string"


@dataclass
class Cleaned:
    data: DataFrame
    audit: DataFrame
    summary: DataFrame


def clean_dataset(df: DataFrame, row_id: str, mode: str = "aggressive") -> Cleaned:
    """Run all steps (``aggressive``) or only report what they would do (``safe``).

    Decisions come from one aggregate per step over all columns; the audit has a row per step and column, a few hundred
    at most. The table is settled once after the duplicate removal, the only step that shuffles it.
    """
    change = mode == "aggressive"
    log: list[tuple] = []

    def note(kind, column, detail, affected, impact):
        log.append((len(log), kind, column, detail, int(affected or 0), impact if change else "warning"))

    data = df
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
    rows0, cols0 = first["n"], [c for c in df.columns if c != row_id]
    missing0 = round(sum(first[f"_{i}"] for i, c in enumerate(df.columns) if c != row_id) / max(rows0 * len(cols0), 1) * 100, 1)

    texts = [c for c in text_columns(data) if c != row_id]
    replaced = {r["column"]: r["replaced"] for r in cl.placeholder_counts(data, texts).collect()} if texts else {}
    for c, n in replaced.items():
        if n:
            note("placeholder", c, "placeholder texts to null", n, "high")
    if change:
        data = cl.placeholders_to_null(data, texts)
    slim = cl.drop_empty(data, row_id)
    for c in data.columns:
        if c not in slim.columns:
            note("drop_column", c, "empty column", 1, "high")
    unique = cl.drop_duplicate_rows(slim, row_id)
    if change:
        data = settle(unique)
        after = data.count()
    else:
        after = unique.count()
    if after < rows0:
        note("drop_rows", None, "empty or duplicate rows", rows0 - after, "high")
    same = cl.duplicate_columns(data, row_id)
    for b, a in same:
        note("drop_column", b, f"same values as {a}", 1, "medium")
    if change:
        data = data.drop(*[b for b, _ in same])
    names = cl.unique_names([cl.snake_case(c) for c in data.columns])
    renamed = dict(zip(data.columns, names))
    for old, new in renamed.items():
        if old != new:
            note("rename", old, new, 1, "medium")
    if change:
        data = data.toDF(*names)
        row_id = renamed.get(row_id, row_id)

    semantic = cl.semantic_columns(data.drop(row_id))
    protected = [c for c, k in semantic.items() if k in PROTECTED]
    texts = [c for c in text_columns(data) if c not in protected and c != row_id]
    if texts:
        targets = {r["column"]: (r["target"], r["filled"]) for r in cl.type_decisions(cl.type_rates(data, texts)).collect()}
        for c, (t, n) in targets.items():
            if t != "text":
                note("type_fix", c, t, n, "high")
        if change:
            data = cl.retype(data, {c: t for c, (t, _) in targets.items()})
    bools = cl.boolean_columns(data, [c for c in text_columns(data) if c not in protected and c != row_id])
    for c in bools:
        note("boolean", c, "yes/no", after, "medium")
    if change:
        data = cl.unify_booleans(data, bools)

    shares = {r["column"]: (r["missing"], r["missing_pct"]) for r in cl.null_shares(data).collect()}
    sparse = [c for c, (_, p) in shares.items() if p > 60]
    for c in sparse:
        note("drop_column", c, "more than 60 % missing", shares[c][0], "high")
    gaps = [c for c, (n, _) in shares.items() if n > 0 and c not in sparse]
    if not change:
        for c in gaps:
            note("impute", c, "would be filled", shares[c][0], "warning")
    else:
        data = data.drop(*sparse)
        if gaps:
            nums = numeric_columns(data)
            mech = {r["column"]: r["mechanism"] for r in cl.missingness_mechanism(data, row_id, [c for c in gaps if c in nums]).collect()}
            mar = [c for c in gaps if mech.get(c) == "mar" and shares[c][1] <= 30]
            simple = [c for c in gaps if c not in mar]
            data = cl.impute_simple(data, simple, [c for c in simple if mech.get(c) == "mnar"])
            for c in mar:
                from gridloom.operators.impute import fit_chained, impute_chained, impute_nearest

                others = [n for n in nums if n not in (c, row_id)]
                if len(others) < 3:
                    data = impute_nearest(data, row_id, c, others)
                    continue
                fit = fit_chained(data, c, others)
                data = impute_chained(data, row_id, c, others, fit=fit)
                if fit.caveat:
                    note("impute", c, fit.caveat, shares[c][0], "warning")
            for c in gaps:
                note("impute", c, f"{mech.get(c, 'mode')}: {'model' if c in mar else 'simple'}", shares[c][0], "medium")
            data = settle(data)

    clipped = 0
    uniq = {r["column"]: r["n_unique"] for r in distinct_counts(data, numeric_columns(data)).collect()}
    nums = [c for c in numeric_columns(data) if c != row_id and uniq.get(c, 0) > 2]
    if nums:
        b = {r["column"]: r for r in cl.outlier_bounds(data, nums).where("n >= 20 AND outside > 0").collect()}
        treat = {c: (r["lower"], r["upper"]) for c, r in b.items() if cl.outlier_strategy(c, semantic.get(c)) == "winsorize"}
        for c, r in b.items():
            note("winsorize" if c in treat else "preserve", c, r["method"], r["outside"], "medium" if c in treat else "warning")
        if change:
            clipped = sum(b[c]["outside"] for c in treat)
            data = cl.treat_outliers(data, treat, "winsorize")
    zeros = cl.suspicious_zeros(data, nums).collect() if nums else []
    for r in zeros:
        note("suspicious_zeros", r["column"], f"{r['zero_pct']} % zeros", r["zero_count"], "warning")
    facts = {r["column"]: r for r in cl.text_facts(data).collect()} if text_columns(data) else {}
    for c, r in facts.items():
        if r["untrimmed"]:
            note("trim", c, "spaces removed", r["untrimmed"], "low")
        if r["upper_share"] > 0.7 and c not in protected:
            note("casing", c, "title case", after, "low")
    if change:
        data = calendar_features(cl.title_case(cl.trim_text(data), protected))

    spark = df.sparkSession
    audit = spark.createDataFrame(log, AUDIT_SCHEMA)
    counts = [(rows0, len(cols0), after, len(data.columns) - 1, float(missing0), int(sum(replaced.values())), len(zeros), int(clipped), len(same))]
    summary = cl.confidence_score(spark.createDataFrame(
        counts, "rows bigint, cols bigint, final_rows bigint, final_cols bigint, missing_pct double, placeholders bigint, suspicious bigint, winsorized bigint, duplicate_cols bigint"))
    return Cleaned(data, audit, summary)
