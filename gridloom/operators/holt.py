"""Damped Holt forecasts of many series, long ones included: the recursion is linear in its first state, so runs of a series are
summed up apart and put together afterwards, for all parameters of a grid at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.series import Z_80, drift_forecast
from gridloom.plans.ordered import with_position
from gridloom.session import settle

#: Parameters tried: weights of the newest value and trend, damping. Ties go to the first.
ALPHA = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
BETA = [0.01, 0.05, 0.1, 0.3, 0.5]
PHI = [0.8, 0.9, 0.98]
GRID = np.array(list(product(ALPHA, BETA, PHI)))
#: A shorter series is forecast by its drift.
LEAST_POINTS = 10
#: Points of one run; runs that one task works on side by side; runs that one fold puts together.
RUN, ABREAST, FAN = 10_000, 256, 256
#: Points that one group of runs holds, about.
GROUP_POINTS = 200_000


def run_summaries(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run (a row of ``values``, filled up to the longest) and parameters: 15 numbers.

    With z = (level, trend, 1) before the run these are the level and trend after it as weights of z (3 each), the summed
    squared one-step errors as a symmetric form of z (6) and the summed errors as weights of z (3).
    """
    a, b, phi = (GRID[:, i][None, :, None] for i in range(3))
    level, trend = (np.broadcast_to(np.eye(3)[i], (len(values), len(GRID), 3)).copy() for i in (0, 1))
    squares, errors = np.zeros((len(values), len(GRID), 6)), np.zeros((len(values), len(GRID), 3))
    for t in range(values.shape[1]):
        live = slice(0, int(np.searchsorted(-lengths, -t, "left")))  # runs come longest first
        ahead = level[live] + phi * trend[live]
        e = -ahead
        e[:, :, 2] += values[live, t][:, None]
        squares[live, :, :3] += e * e
        squares[live, :, 3] += e[:, :, 0] * e[:, :, 1]
        squares[live, :, 4] += e[:, :, 0] * e[:, :, 2]
        squares[live, :, 5] += e[:, :, 1] * e[:, :, 2]
        errors[live] += e
        now = ahead + a * e
        trend[live] = b * (now - level[live]) + (1 - b) * phi * trend[live]
        level[live] = now
    return np.concatenate([level, trend, squares, errors], axis=2)


def _form(squares: np.ndarray) -> np.ndarray:
    q = np.zeros((len(squares), 3, 3))
    for k, (i, j) in enumerate([(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]):
        q[:, i, j] = q[:, j, i] = squares[:, k]
    return q


def put_together(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The summary of two neighbouring stretches."""
    moved = np.zeros((len(first), 3, 3))
    moved[:, 0], moved[:, 1], moved[:, 2, 2] = first[:, :3], first[:, 3:6], 1.0
    ahead = lambda w: np.einsum("gi,gij->gj", w, moved)
    q = np.einsum("gki,gkl,glj->gij", moved, _form(then[:, 6:12]), moved)
    squares = first[:, 6:12] + np.stack([q[:, 0, 0], q[:, 1, 1], q[:, 2, 2], q[:, 0, 1], q[:, 0, 2], q[:, 1, 2]], axis=1)
    return np.concatenate([ahead(then[:, :3]), ahead(then[:, 3:6]), squares, first[:, 12:] + ahead(then[:, 12:])], axis=1)


def _summarise(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["series", "run", "pos"], kind="stable")
    marks = frame[["series", "run"]].to_numpy()
    cuts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1)))
    sizes = np.diff(np.append(cuts, len(frame)))
    order, y, out = np.argsort(-sizes, kind="stable"), frame["value"].to_numpy(np.float64), []
    for at in range(0, len(order), ABREAST):
        some = order[at : at + ABREAST]
        wide = np.zeros((len(some), sizes[some[0]]))
        for row, k in enumerate(some):
            wide[row, : sizes[k]] = y[cuts[k] : cuts[k] + sizes[k]]
        out.append(pd.DataFrame({"series": marks[cuts[some], 0], "run": marks[cuts[some], 1], "state": list(run_summaries(wide, sizes[some]).reshape(len(some), -1))}))
    return pd.concat(out)


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("run")
    states = [np.asarray(s).reshape(len(GRID), 15) for s in frame["state"]]
    whole = states[0]
    for s in states[1:]:
        whole = put_together(whole, s)
    return pd.DataFrame({"series": frame["series"].iloc[:1], "run": frame["run"].iloc[:1] // FAN, "state": [whole.ravel()]})


def _best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for series, state, y1, y2 in zip(frame["series"], frame["state"], frame["y1"], frame["y2"]):
            s, z = np.asarray(state).reshape(len(GRID), 15), np.array([y1, y2 - y1, 1.0])
            sse = np.maximum(0.0, np.einsum("i,gij,j->g", z, _form(s[:, 6:12]), z))
            k = int(np.argmax(sse <= sse.min() * (1 + 1e-12)))  # the first of equally good ones
            rows.append((series, *GRID[k], s[k, :3] @ z, s[k, 3:6] @ z, sse[k], s[k, 12:] @ z))
        yield pd.DataFrame(rows, columns=["series", "alpha", "beta", "phi", "level", "trend", "sse", "error_sum"])


def fit_holt(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series of at least LEAST_POINTS points: the parameters of the grid with the least squared one-step errors, level
    and trend after the last point, n, and the sample deviation of the errors. It starts at the first value and first step.

    A series is cut into runs; a group of runs, of one or of many series, is one task's work. Null dates, values and keys
    drop out, as in ``points``.
    """
    keys = list(keys)
    placed = with_position(pts.where(F.col("value").isNotNull() & F.col("date").isNotNull()), keys, "date")
    first = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("y1"), F.max(F.when(F.col("pos") == 2, F.col("value"))).alias("y2"))
    known = settle(first.where(F.col("n") >= LEAST_POINTS).withColumn("series", F.monotonically_increasing_id() if keys else F.lit(0).cast("long")))
    rows = placed.where("pos > 1")
    if keys:
        rows = rows.join(known.select(*[F.col(k).alias(f"k_{k}") for k in keys], "series"), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    else:
        rows = rows.withColumn("series", F.lit(0).cast("long"))
    rows = rows.select("series", F.floor((F.col("pos") - 2) / RUN).alias("run"), "pos", F.col("value").cast("double").alias("value"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP_POINTS))
    shape = "series long, run long, state array<double>"
    states = settle(rows.groupBy(F.pmod(F.xxhash64("series", "run"), F.lit(groups)).alias("part")).applyInPandas(_summarise, shape))
    longest = known.agg(F.max("n")).first()[0] or 0
    runs = -(-max(longest - 1, 1) // RUN)
    while runs > 1:
        states = settle(states.groupBy("series", F.floor(F.col("run") / FAN).alias("part")).applyInPandas(_fold, shape))
        runs = -(-runs // FAN)
    best = states.join(known.select("series", "y1", "y2"), "series").select("series", "state", "y1", "y2").mapInPandas(
        _best, "series long, alpha double, beta double, phi double, level double, trend double, sse double, error_sum double")
    m = F.col("n") - 1
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("sse") - F.col("error_sum") * F.col("error_sum") / m) / (m - 1)))
    return known.join(best, "series").select(*keys, "n", "alpha", "beta", "phi", "level", "trend", "sse", spread.alias("deviation"))


def holt_forecast(pts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Damped Holt for 7 to 30 steps by length, with an 80 % band that widens with the root of the step; series too short for it
    go by their drift."""
    keys = list(keys)
    fits = settle(fit_holt(pts, keys))
    horizon = F.least(F.lit(30), F.greatest(F.lit(7), F.floor(F.col("n") / 4))).cast("int")
    t = fits.withColumn("step", F.explode(F.sequence(F.lit(1), horizon)))
    f = F.col("level") + F.col("trend") * F.col("phi") * (1 - F.pow("phi", F.col("step"))) / (1 - F.col("phi"))
    band = Z_80 * F.col("deviation") * F.sqrt(F.col("step"))
    long = t.select(*keys, F.col("step").cast("bigint").alias("step"), F.round(f, 4).alias("forecast"), F.round(f - band, 4).alias("lower_80"), F.round(f + band, 4).alias("upper_80"), F.lit("damped_holt").alias("model_used"))
    clean = pts.where(F.col("value").isNotNull() & F.col("date").isNotNull())
    if keys:
        sizes = clean.groupBy(*keys).count().where(F.col("count") < LEAST_POINTS).select(*[F.col(k).alias(f"k_{k}") for k in keys])
        few = clean.join(sizes, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], "left_semi")
    else:
        few = clean.where(F.lit(fits.isEmpty()))
    return long.unionByName(drift_forecast(few, keys).withColumn("model_used", F.lit("drift")))
