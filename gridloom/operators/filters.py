"""Row filters, search, paging, derived columns and column metadata."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import correlation_of, skew_g1
from gridloom.plans.ordered import with_position
from gridloom.plans.stacked import (
    clean_number, date_columns, numeric_columns, stack_text, text_columns, wide_to_rows,
)

# Functions a formula may call.
FORMULA_FUNCTIONS = {"log", "log1p", "log2", "sqrt", "abs", "exp", "sin", "cos", "floor", "ceil", "round"}
DEEP_PAGE_ROWS = 100_000


def _number(text: str) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def apply_filters(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """AND of ``{col, op, value}`` conditions; unknown columns and unreadable values are skipped.

    ``eq``/``neq`` compare as numbers when the column holds any readable number, else as text without case.
    """
    numeric = set(numeric_columns(df))
    known = [f for f in filters if f.get("col") in df.columns and f.get("op")]
    probe = sorted({f["col"] for f in known if f["op"] in ("eq", "neq") and f["col"] not in numeric})
    as_number = {c: True for c in numeric}
    if probe:
        found = df.agg(*[
            F.bool_or(F.col(c).cast("string").try_cast("double").isNotNull()).alias(c) for c in probe
        ]).first()
        as_number.update({c: bool(found[c]) for c in probe})
    conditions: list[Column] = []
    for f in known:
        c, op, text = f["col"], f["op"], str(f.get("value", ""))
        raw = F.col(c).cast("string")
        num = F.col(c).cast("double") if c in numeric else raw.try_cast("double")
        value = _number(text)
        if op == "is_null":
            conditions.append(F.col(c).isNull())
        elif op == "not_null":
            conditions.append(F.col(c).isNotNull())
        elif op == "contains":
            conditions.append(F.lower(raw).contains(text.lower()))
        elif op in ("eq", "neq"):
            if as_number[c] and value is None:
                continue
            same = num == value if as_number[c] else F.lower(raw) == text.lower()
            conditions.append(same if op == "eq" else ~F.coalesce(same, F.lit(False)))
        elif op in ("gt", "gte", "lt", "lte") and value is not None:
            conditions.append({"gt": num > value, "gte": num >= value, "lt": num < value, "lte": num <= value}[op])
    return reduce(lambda d, cond: d.where(cond), conditions, df)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows where any text column holds ``text``, ignoring case."""
    needle = text.strip().lower()
    cols = text_columns(df)
    if not needle or not cols:
        return df
    return df.where(reduce(lambda a, b: a | b, [
        F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in cols
    ]))


def page(df: DataFrame, sort: str, ties: str, number: int, per_page: int, descending: bool = False) -> DataFrame:
    """One page of the table sorted with nulls last, plus ``total_rows``, ``total_pages`` and the clamped ``page``.

    Shallow pages are a bounded top-k; deep pages are cut out by row position, nulls placed behind all values, so no task
    sorts the whole table. Both give the same rows.
    """
    total = df.count()
    pages = max(1, -(-total // per_page))
    at = min(number, pages)
    start = (at - 1) * per_page
    sortable = {sort, ties} <= {*numeric_columns(df), *date_columns(df)}
    if start + per_page > DEEP_PAGE_ROWS and sortable:
        values = df.where(F.col(sort).isNotNull())
        placed = with_position(values, [], sort, ties, descending)
        blank = with_position(df.where(F.col(sort).isNull()), [], ties)
        placed = placed.unionByName(blank.withColumn("pos", F.col("pos") + values.count()))
        rows = placed.where((F.col("pos") > start) & (F.col("pos") <= start + per_page)).drop("pos")
    else:
        order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
        rows = df.orderBy(order, ties).offset(start).limit(per_page)
    return rows.withColumns({
        "total_rows": F.lit(total).cast("bigint"), "total_pages": F.lit(pages).cast("bigint"),
        "page": F.lit(at).cast("bigint"),
    })


def sort_rows(df: DataFrame, col: str, ties: str, descending: bool = False) -> DataFrame:
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()
    return df.orderBy(order, ties)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, n_unique`` for all columns from one shuffle of distinct cells.

    A cell travels as two 64-bit hashes of its value (0.0 and -0.0 are one value), so long texts are never shuffled.
    """
    def cell(i: int, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("p"), F.xxhash64(F.lit(1), F.col(c)).alias("q")))

    names = F.array(*[F.lit(c) for c in cols])
    cells = df.select(F.explode(F.array_compact(F.array(*[cell(i, c) for i, c in enumerate(cols)]))).alias("s")).select("s.*").distinct()
    return cells.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique")).select(F.get(names, F.col("i")).alias("column"), "n_unique")


def simple_type(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    if dtype == "boolean":
        return "boolean"
    return "datetime" if dtype in ("timestamp", "timestamp_ntz", "date") else "text"


def column_metadata(df: DataFrame) -> DataFrame:
    """Per column: type, null count and share, distinct count and, for numbers, min, max and mean."""
    kinds = dict(df.dtypes)
    numeric = set(numeric_columns(df))

    def num(c, fn):
        return fn(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")

    base = wide_to_rows(df, df.columns, {
        "dtype": lambda c: F.first(F.lit(simple_type(kinds[c]))),
        "null_count": lambda c: F.count_if(F.col(c).isNull()),
        "null_pct": lambda c: F.round(F.count_if(F.col(c).isNull()) / F.count(F.lit(1)) * 100, 1),
        "min": lambda c: num(c, F.min),
        "max": lambda c: num(c, F.max),
        "mean": lambda c: F.round(num(c, F.avg), 4),
    })
    return base.join(F.broadcast(distinct_counts(df, df.columns)), "column", "left").withColumn(
        "n_unique", F.coalesce("n_unique", F.lit(0))
    )


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns by kind and the missing share of all cells."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("bigint").alias("categorical_columns"),
        F.lit(len(date_columns(df))).cast("bigint").alias("datetime_columns"),
        F.round(nulls / (rows * len(df.columns)) * 100, 2).alias("missing_pct"),
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """Which picker lists a column belongs to; text columns count as dates when 60 % of their values parse."""
    texts, nums, dates = text_columns(df), set(numeric_columns(df)), set(date_columns(df))
    share = wide_to_rows(df, df.columns, {
        "parsed": lambda c: (
            F.count(F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")]))
            / F.greatest(F.count(c), F.lit(1))
        ) if c in texts else F.lit(0.0),
    })
    return share.select(
        "column",
        F.col("column").isin(list(nums)).alias("numeric"),
        F.col("column").isin(texts).alias("categorical"),
        (F.col("column").isin(list(dates)) | (F.col("parsed") >= 0.6)).alias("datetime"),
    )


def derive(df: DataFrame, name: str, formula: str) -> DataFrame:
    """A column computed from a formula over columns, arithmetic and the allowed functions; a division by zero gives null."""
    called = set(re.findall(r"([A-Za-z_]\w*)\s*\(", formula))
    words = set(re.findall(r"[A-Za-z_]\w*", formula)) - called
    if not name.strip():
        raise ValueError("a feature needs a name")
    if called - FORMULA_FUNCTIONS or words - set(df.columns) - {"e"} or ";" in formula:
        raise ValueError(f"formula uses unknown names: {sorted((called - FORMULA_FUNCTIONS) | (words - set(df.columns)))}")
    return df.withColumn(name, F.expr(safe_division(re.sub(r"\blog\s*\(", "ln(", formula))))


class _SafeDivision(ast.NodeTransformer):
    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        name = {ast.Div: "try_divide", ast.Mod: "try_mod"}.get(type(node.op))
        return ast.Call(ast.Name(name), [node.left, node.right], []) if name else node


def safe_division(formula: str) -> str:
    """The formula with divisions that give null where the divisor is zero."""
    return ast.unparse(_SafeDivision().visit(ast.parse(formula.strip(), mode="eval")))


def reapply(df: DataFrame, features: Sequence[tuple[str, str]]) -> DataFrame:
    """Saved ``(name, formula)`` features applied in order."""
    return reduce(lambda d, f: derive(d, *f), features, df)


def feature_stats(df: DataFrame, name: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(name).isNull()).alias("null_count"), F.round(F.avg(name), 4).alias("mean"),
        F.round(F.stddev_samp(name), 4).alias("std"), F.round(F.min(name), 4).alias("min"),
        F.round(F.max(name), 4).alias("max"),
    )


def suggest_features(df: DataFrame, shapes: int | None = None, top: int | None = None) -> DataFrame:
    """Suggested formulas: log of skewed columns, ratios, products of correlated pairs, calendar parts.

    A report may ask for the first ``shapes`` transforms and ratios and the ``top`` suggestions; all are the default.
    """
    nums, dates = numeric_columns(df), date_columns(df)
    pairs = list(combinations(nums, 2))
    checks = (
        [(1, i, f"log_{c}", f"log1p({c})", "transform", (F.abs(skew_g1(c)) > 1.5) & (F.min(c) >= 0))
         for i, c in enumerate(nums)]
        + [(2, i, f"{a}_per_{b}", f"{a} / ({b} + 1e-9)", "ratio",
            (F.try_divide(F.count_if(F.col(b) == 0), F.count(F.lit(1))) < 0.1) & (F.avg(b) != 0)) for i, (a, b) in enumerate(pairs)]
        + [(3, i, f"{a}_x_{b}", f"{a} * {b}", "interaction", F.abs(correlation_of(a, b)) > 0.6)
           for i, (a, b) in enumerate(pairs)]
        + [(4, i, f"{c}_{part}", f"{part}({c})", "datetime", F.max(F.lit(True)))
           for i, (c, part) in enumerate((c, p) for c in dates for p in ("month", "dayofweek"))]
    )
    rows = df.agg(*[
        F.struct(F.lit(g).alias("grp"), F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(f).alias("formula"),
                 F.lit(cat).alias("category"), F.coalesce(ok, F.lit(False)).alias("ok")).alias(f"_{k}")
        for k, (g, i, n, f, cat, ok) in enumerate(checks)
    ])
    kept = F.filter(F.array(*[f"_{k}" for k in range(len(checks))]), lambda s: s["ok"])
    first = F.filter(kept, lambda s: s["grp"] <= 2)
    first = first if shapes is None else F.slice(first, 1, shapes)
    rest = F.filter(kept, lambda s: s["grp"] == 3)
    dates_ = F.filter(kept, lambda s: s["grp"] == 4)
    listed = F.concat(first, rest, dates_)
    listed = listed if top is None else F.slice(listed, 1, top)
    return rows.select(F.inline(listed)).select("name", "formula", "category")


def calendar_features(df: DataFrame) -> DataFrame:
    """Year, month, day, day of week (Monday 0), quarter and weekend flag of every date column."""
    new: dict[str, Column] = {}
    for c in date_columns(df):
        parts = {
            "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "day_of_week": F.weekday(c),
            "quarter": F.quarter(c), "is_weekend": F.weekday(c).isin(5, 6).cast("int"),
        }
        new.update({f"{c}_{p}": e.cast("bigint") for p, e in parts.items() if f"{c}_{p}" not in df.columns})
    return df.withColumns(new) if new else df


def id_like(df: DataFrame) -> DataFrame:
    """Columns left out of analysis: name contains "id" and more than 95 % distinct values."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return distinct_counts(df, df.columns).select(
        "column", F.round(F.col("n_unique") / total * 100, 2).alias("unique_pct"),
        (F.lower("column").contains("id") & (F.col("n_unique") / total > 0.95)).alias("id_like"),
    )


def within_range(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Valid and excluded row counts of a range rule."""
    ok = F.col(col).between(low, high)
    return df.where(F.col(col).isNotNull()).agg(
        F.count_if(ok).alias("valid"), F.count_if(~ok).alias("excluded"),
        F.round(F.avg(F.when(ok, F.col(col))), 4).alias("mean_valid"),
    )
