"""Joins and set comparisons between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_tables(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other and columns in both tables get ``_left`` / ``_right``.

    A key of the same name on both sides stays one column. Skewed keys are left to the adaptive skew join.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join kind {how!r}")
    shared_key = left_on == right_on
    both = set(left.columns) & set(right.columns) - ({left_on} if shared_key else set())
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, F.col(f"l.{left_on}").eqNullSafe(F.col(f"r.{right_on}")), how)
    cols = []
    for c in left.columns:
        if shared_key and c == left_on:
            cols.append(F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c))
        else:
            cols.append(F.col(f"l.{c}").alias(f"{c}_left" if c in both else c))
    for c in right.columns:
        if not (shared_key and c == right_on):
            cols.append(F.col(f"r.{c}").alias(f"{c}_right" if c in both else c))
    return joined.select(*cols)


def suggest_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common column names with the share of the left table's distinct values found on the right."""
    parts = []
    for c in sorted(set(left.columns) & set(right.columns)):
        a = left.select(F.col(c).alias("v")).where(F.col("v").isNotNull()).distinct()
        b = right.select(F.col(c).alias("v")).distinct().withColumn("hit", F.lit(1))
        parts.append(a.join(b, "v", "left").agg(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("left_values"), F.count("hit").alias("matched"),
            F.round(F.count("hit") / F.count(F.lit(1)) * 100, 2).alias("overlap_pct"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_overlap(a: DataFrame, b: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows of ``a`` (on the shared columns) that also occur in ``b``; nulls count as equal."""
    shared = list(cols or sorted(set(a.columns) & set(b.columns)))
    marked = a.select(*shared).distinct().withColumn("_s", F.lit(1)).unionByName(
        b.select(*shared).distinct().withColumn("_s", F.lit(2))
    )
    sides = marked.groupBy(*shared).agg(F.sum("_s").alias("_s"))
    return sides.agg(
        F.count_if(F.col("_s") == 3).alias("overlap"),
        F.count_if(F.col("_s") != 2).alias("distinct_a"),
        F.round(F.count_if(F.col("_s") == 3) / F.greatest(F.count_if(F.col("_s") != 2), F.lit(1)) * 100, 2)
        .alias("pct_of_a"),
    )


def shared_rows(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows found in both tables."""
    return a.select(*cols).intersect(b.select(*cols))


def schema_sets(catalog_a: DataFrame, catalog_b: DataFrame) -> DataFrame:
    """Column names of two tables marked ``shared``, ``only_a`` or ``only_b``."""
    a = catalog_a.select("column").distinct().withColumn("a", F.lit(True))
    b = catalog_b.select("column").distinct().withColumn("b", F.lit(True))
    return a.join(b, "column", "full_outer").select(
        "column",
        F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "only_a").otherwise("only_b").alias("side"),
    )


def latest_per_owner(owners: DataFrame, runs: DataFrame, owner: str, run_owner: str, run_id: str, run_at: str) -> DataFrame:
    """Every owner with the time and id of its latest run; owners without one come last."""
    latest = runs.groupBy(F.col(run_owner).alias(owner)).agg(
        F.max(run_at).alias("latest_run_at"), F.max(run_id).alias("latest_run_id")
    )
    return owners.join(latest, owner, "left").orderBy(F.col("latest_run_at").desc_nulls_last(), owner)


def finding_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Findings of run ``b`` against run ``a`` by normalised text: new, resolved or unchanged."""
    def keyed(d):
        k = F.lower(F.trim(F.col(key)))
        return d.select(k.alias("key")).where(F.length("key") > 0).distinct()
    new = keyed(b).join(keyed(a), "key", "left_anti").withColumn("state", F.lit("new"))
    gone = keyed(a).join(keyed(b), "key", "left_anti").withColumn("state", F.lit("resolved"))
    kept = keyed(b).join(keyed(a), "key", "left_semi").withColumn("state", F.lit("unchanged"))
    return new.unionByName(gone).unionByName(kept)


def profile_diff(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Added, removed and changed columns between two profile tables keyed by ``column``."""
    l, r = a.alias("l"), b.alias("r")
    j = l.join(r, F.col("l.column") == F.col("r.column"), "full_outer")
    changed = [F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]
    return j.select(
        F.coalesce("l.column", "r.column").alias("column"),
        F.when(F.col("l.column").isNull(), "added").when(F.col("r.column").isNull(), "removed")
        .when(F.size(F.array_compact(F.array(*changed))) > 0, "changed").otherwise("same").alias("state"),
        F.when(F.col("l.column").isNotNull() & F.col("r.column").isNotNull(),
               F.concat_ws(",", F.array_compact(F.array(*changed)))).alias("fields"),
    )
