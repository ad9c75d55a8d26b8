"""Multivariate anomalies by an isolation forest: trees grow in parallel on small samples, all rows are scored."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.plans.ordered import grouped_quantiles
from gridloom.session import settle

TREES, SAMPLE, SEED = 100, 256, 42
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, length double"


def expected_length(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes ``(node, feature, split, left, right, length)``; leaves have feature -1 and the adjusted path length."""
    nodes: list[tuple] = []
    stack = [(np.arange(len(x)), 0, 0)]
    count = 1
    while stack:
        rows, depth, me = stack.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        if len(rows) <= 1 or depth >= max_depth or len(open_) == 0:
            nodes.append((me, -1, 0.0, -1, -1, depth + expected_length(len(rows))))
            continue
        f = int(rng.choice(open_))
        split = float(rng.uniform(lo[f], hi[f]))
        below = x[rows, f] < split
        left, right = count, count + 1
        count += 2
        nodes.append((me, f, split, left, right, 0.0))
        stack.append((rows[below], depth + 1, left))
        stack.append((rows[~below], depth + 1, right))
    return nodes


def _samples(rows: DataFrame, n: int, row_id: str) -> DataFrame:
    """About 1.5 x 256 rows per tree by hashed ids; big tables draw each row for at most one tree."""
    share = 1.5 * SAMPLE / max(n, 1)
    u = lambda *salt: F.pmod(F.xxhash64(F.col(row_id), *[F.lit(s) if isinstance(s, int) else s for s in salt]), F.lit(2**40)) / float(2**40)
    if share * TREES < 0.5:
        picked = rows.where(u(SEED) < share * TREES).withColumn("tree", F.floor(u(SEED, 1) * TREES).cast("int"))
    else:
        each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
        picked = each.where(u(SEED, F.col("tree")) < min(1.0, share)) if share < 1 else each
    return picked.withColumn("_o", F.xxhash64(F.col(row_id), F.col("tree"), F.lit(SEED)))


def fit_forest(df: DataFrame, row_id: str, cols: Sequence[str]) -> pd.DataFrame:
    """Nodes of all trees (a bounded table: 100 trees of at most 511 nodes)."""
    cols = list(cols)
    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    n = rows.count()

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.nsmallest(SAMPLE, "_o")
        tree = int(key[0])
        depth = int(np.ceil(np.log2(max(len(pdf), 2))))
        nodes = grow_tree(pdf[cols].to_numpy(dtype=float), np.random.default_rng([SEED, tree]), depth)
        return pd.DataFrame([(tree, *r) for r in nodes], columns=["tree", "node", "feature", "split", "left", "right", "length"])

    return _samples(rows, n, row_id).groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()


def score_rows(df: DataFrame, row_id: str, cols: Sequence[str], nodes: pd.DataFrame, sample: int) -> DataFrame:
    """Complete rows with their score (lower is more anomalous)."""
    cols = list(cols)
    forest = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(g[c].to_numpy() for c in ("feature", "split", "left", "right", "length")))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = max(expected_length(sample), 1e-9)

    @F.pandas_udf(DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(x))
        at_rows = np.arange(len(x))
        for feature, split, left, right, length in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[at_rows, np.where(inner, f, 0)] < split[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return pd.Series(-np.power(2.0, -(total / len(shared.value)) / norm))

    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    return rows.withColumn("score", score(*cols))


def isolation_forest(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Scores and flags of all complete rows; the share flagged is 10 / n, between 1 % and 10 %."""
    n = df.select(*cols).na.drop().count()
    share = min(0.1, max(0.01, 10 / max(n, 1)))
    nodes = fit_forest(df, row_id, cols)
    scored = settle(score_rows(df, row_id, cols, nodes, min(SAMPLE, n)).select(row_id, "score"))
    cut = grouped_quantiles(scored, [], "score", {"cut": share}).select("cut").scalar()
    return scored.withColumn("_c", cut).select(row_id, F.round("score", 6).alias("score"), (F.col("score") < F.col("_c")).alias("is_anomaly"))


def anomaly_summary(flags: DataFrame) -> DataFrame:
    pct = F.round(F.count_if("is_anomaly") / F.count(F.lit(1)) * 100, 1)
    return flags.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anomaly").alias("anomalies"), pct.alias("anomaly_pct"),
                     F.when(pct > 5, "high").otherwise("medium").alias("severity"))
