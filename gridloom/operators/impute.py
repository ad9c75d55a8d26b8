"""Model-based imputation of one numeric column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cleaning import numeric_medians
from gridloom.plans import metric
from gridloom.plans.boxes import by_pattern, distinct, levels, nearest_levels, settle_boxes
from gridloom.plans.metric import distances, matrix, meet, stripes
from gridloom.session import settle

MAX_ROUNDS, TOLERANCE, RIDGE = 15, 1e-3, 1e-6
#: Predictors with this share of nulls or more are left out.
SPARSE = 0.5
NEIGHBOURS = 5
#: Decimals to which distances are told apart; rows equally far share what is left of the k places.
DECIMALS = 9


def _number(c: str) -> Column:
    """The column as a double; NaN is unknown as null is."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


# --- chained regressions ----------------------------------------------------------------------------------------------


@dataclass
class ChainedFit:
    """Regressions of every column with nulls on all others, on standardised numbers, and the summary they come from."""

    columns: list[str]
    gaps: list[str]
    centre: np.ndarray
    scale: np.ndarray
    start: np.ndarray  # first fills
    rounds: list[dict[int, np.ndarray]] = field(default_factory=list)  # per round and column: intercept, then a weight a column
    converged: bool = True
    products: DataFrame | None = None  # (pattern, n, products): sums of products over the rows of each null pattern

    @property
    def caveat(self) -> str | None:
        return None if self.converged else f"the fills still moved after {len(self.rounds)} rounds; they are estimates"

    def maps(self, pattern: str) -> np.ndarray:
        """Each column of a row with this pattern as intercept and weights of its known values.

        Fills are linear in the known values at every round, so the rounds are replayed on the maps, column by column.
        """
        d = len(self.columns)
        out = np.zeros((d, d + 1))
        unknown = [i for i in range(d) if pattern[i] == "0"]
        for i in range(d):
            out[i, 0 if pattern[i] == "0" else i + 1] = self.start[i] if pattern[i] == "0" else 1.0
        for weights in self.rounds:
            for i in unknown:
                w = weights.get(i)
                if w is not None:
                    out[i] = w[1:] @ out
                    out[i, 0] += w[0]
        return out


def _null_pattern(cols: Sequence[str]) -> Column:
    return F.concat(*[F.when(_number(c).isNull(), "0").otherwise("1") for c in cols])


def _pattern_products(df: DataFrame, cols: Sequence[str], centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(pattern, n, products): for each null pattern the summed products of (1, standardised values), unknown ones as 0.

    Summed within each task first; one row a pattern and task is shuffled.
    """
    d = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pattern": list(held), "products": pa.array([x.ravel().tolist() for x in held.values()], pa.list_(pa.float64()))})

        for batch in batches:
            x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols]) - centre) / scale
            known = ~np.isnan(x)
            rows = np.hstack([np.ones((len(x), 1)), np.where(known, x, 0.0)])
            kinds, which = np.unique(known, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            cuts = np.searchsorted(which.ravel()[order], np.arange(len(kinds) + 1))
            for k, kind in enumerate(kinds):
                part = rows[order[cuts[k] : cuts[k + 1]]]
                name = "".join("1" if b else "0" for b in kind)
                held[name] = held.get(name, 0.0) + part.T @ part
            if len(held) * (d + 1) ** 2 > 1 << 22:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = df.select(*[_number(c).alias(c) for c in cols]).mapInArrow(run, "pattern string, products array<double>")
    cells = parts.select("pattern", F.posexplode("products").alias("place", "v")).groupBy("pattern", "place").agg(F.sum("v").alias("v"))
    return cells.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda s: s["v"]).alias("products"))


def _round_products(fit: ChainedFit) -> dict[int, np.ndarray]:
    """For every column with nulls the products of all columns, as filled so far, over the rows that know it."""
    d, gaps = len(fit.columns), [fit.columns.index(c) for c in fit.gaps]
    known = ChainedFit(fit.columns, fit.gaps, fit.centre, fit.scale, fit.start, list(fit.rounds))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {i: np.zeros((d + 1, d + 1)) for i in gaps}
        for frame in frames:
            for pattern, flat in zip(frame["pattern"], frame["products"]):
                full = np.vstack([np.eye(1, d + 1), known.maps(pattern)])
                made = full @ np.asarray(flat, np.float64).reshape(d + 1, d + 1) @ full.T
                for i in gaps:
                    if pattern[i] == "1":
                        sums[i] += made
        yield pd.DataFrame({"column": gaps, "products": [sums[i].ravel().tolist() for i in gaps]})

    parts = fit.products.mapInPandas(run, "column int, products array<double>").select("column", F.posexplode("products").alias("place", "v"))
    out = {i: np.zeros((d + 1) ** 2) for i in gaps}
    for r in parts.groupBy("column", "place").agg(F.sum("v").alias("v")).collect():
        out[r["column"]][r["place"]] = r["v"]
    return {i: x.reshape(d + 1, d + 1) for i, x in out.items()}


def _solve(products: np.ndarray, target: int, ridge: float = RIDGE) -> np.ndarray:
    """Ridge regression of a column on all others by the normal equations: intercept, then a weight a column (its own is 0)."""
    n = products[0, 0]
    out = np.zeros(len(products))
    if n == 0:
        return out
    mean = products[0, 1:] / n
    spread = products[1:, 1:] / n - np.outer(mean, mean)
    inputs = [i for i in range(len(mean)) if i != target]
    if inputs:
        out[[i + 1 for i in inputs]] = np.linalg.solve(spread[np.ix_(inputs, inputs)] + ridge * np.eye(len(inputs)), spread[inputs, target])
    out[0] = mean[target] - out[1:] @ mean
    return out


def fit_chained(df: DataFrame, target: str, others: Sequence[str], rounds: int = MAX_ROUNDS) -> ChainedFit:
    """Chained regressions until no weight moves by more than the tolerance.

    The table is read twice: for the columns' facts, and for sums of products by null pattern. Every round then works on those
    sums alone, one row a pattern: a fill is linear in what its row knows, so the products of filled columns follow from the
    products of known ones. Predictors are all numbers with under half missing; a column without any value is no predictor.
    """
    share = df.agg(*[F.struct(F.avg(_number(c).isNull().cast("int")).alias("share"), F.avg(_number(c)).alias("m"), F.stddev_pop(_number(c)).alias("s")).alias(c) for c in dict.fromkeys([target, *others])]).first()
    cols = [target, *[c for c in dict.fromkeys(others) if c != target and (share[c]["share"] or 0.0) < SPARSE and share[c]["m"] is not None]]
    centre = np.array([share[c]["m"] or 0.0 for c in cols])
    scale = np.array([share[c]["s"] or 1.0 for c in cols])
    gaps = [c for c in cols if share[c]["share"] or 0.0]
    fit = ChainedFit(cols, gaps, centre, scale, np.zeros(len(cols)))
    if share[target]["m"] is None or not gaps:
        return fit
    med = numeric_medians(df.select(*[_number(c).alias(c) for c in gaps]), gaps)
    fit.start = np.array([(float(med[c]) if c in med else m) - m for c, m in zip(cols, centre)]) / scale
    fit.products = settle(_pattern_products(df, cols, centre, scale))
    fit.converged = False
    for _ in range(rounds):
        weights = {i: _solve(g, i) for i, g in _round_products(fit).items()}
        moved = max(np.abs(w - (fit.rounds[-1][i] if fit.rounds else 0.0)).max() for i, w in weights.items())
        fit.rounds.append(weights)
        if moved < TOLERANCE or len(gaps) == 1:  # predictors without nulls: the first fit is the last
            fit.converged = True
            break
    return fit


def fitted_lines(df: DataFrame, fit: ChainedFit) -> DataFrame:
    """(column, predictor, weight, rounds, converged): the last round's regressions in the columns' own units; predictor null is
    the intercept."""
    rows = []
    last = fit.rounds[-1] if fit.rounds else {}
    for i, w in sorted(last.items()):
        own = w[1:] * fit.scale[i] / fit.scale
        rows.append((fit.columns[i], None, float(fit.centre[i] + w[0] * fit.scale[i] - own @ fit.centre), len(fit.rounds), fit.converged))
        rows += [(fit.columns[i], c, float(own[k]), len(fit.rounds), fit.converged) for k, c in enumerate(fit.columns) if k != i]
    return df.sparkSession.createDataFrame(rows, "column string, predictor string, weight double, rounds int, converged boolean")


def impute_chained(df: DataFrame, row_id: str, target: str, others: Sequence[str], rounds: int = MAX_ROUNDS, fit: ChainedFit | None = None) -> DataFrame:
    """``df`` with the nulls of ``target`` filled by the chained regressions (a given fit, or one made here).

    Rows that know the target pass by; the others meet their pattern's line by a join. A column without any value stays.
    """
    fit = fit or fit_chained(df, target, others, rounds)
    value = _number(target)
    if not fit.rounds or target not in fit.gaps:
        return df.withColumn(target, value)
    known = ChainedFit(fit.columns, fit.gaps, fit.centre, fit.scale, fit.start, list(fit.rounds))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_pattern": frame["pattern"], "_line": [known.maps(p)[0].tolist() for p in frame["pattern"]]})

    lines = fit.products.where(F.col("pattern").startswith("0")).select("pattern").mapInPandas(run, "_pattern string, _line array<double>")
    held = F.array(F.lit(1.0), *[F.coalesce((_number(c) - float(m)) / float(s), F.lit(0.0)) for c, m, s in zip(fit.columns, fit.centre, fit.scale)])
    # Columns of the table may have any names.
    asks = df.where(value.isNull()).select(F.struct(*df.columns).alias("_row"), _null_pattern(fit.columns).alias("_pattern"), held.alias("_held"))
    fill = F.aggregate(F.zip_with("_line", "_held", lambda w, x: w * x), F.lit(0.0), lambda a, b: a + b) * float(fit.scale[0]) + float(fit.centre[0])
    filled = asks.join(lines, "_pattern").select(*[(fill if c == target else F.col("_row").getField(c)).alias(c) for c in df.columns])
    return df.where(value.isNotNull()).withColumn(target, value).unionByName(filled)


# --- nearest donors ---------------------------------------------------------------------------------------------------


#: Pairs of null patterns of seekers and donors in one piece that are looked into one by one.
PATTERN_PAIRS = 256


def _levels_of_piece(k: int):
    """The donors of a piece nearest to each seeker: for each distance their number and the sum of their values.

    Seekers and donors of two null patterns meet in the components that both know: there equal seekers are one, equal donors
    one with their weight, and nothing is unknown. A piece of very many patterns is compared pair by pair.
    """

    def found(asks: pa.Table, gives: pa.Table) -> pa.Table:
        parts = []
        if asks.num_rows and gives.num_rows:
            width = len(asks["vec"][0])
            x, y = matrix(asks["vec"], width), matrix(gives["d_vec"], width)
            reach = np.asarray(asks["reach"].to_numpy(), np.float64)
            reach = np.where(np.isnan(reach), np.inf, reach)
            ids, w, wv = asks["id"].to_numpy(), gives["d_w"].to_numpy().astype(np.float64), gives["d_wv"].to_numpy()
            theirs, ours = by_pattern(x), by_pattern(y)
            if len(theirs) * len(ours) > PATTERN_PAIRS:
                parts = [all_pairs(ids[s], x[s], y, w, wv) for s in stripes(len(x))]
            else:
                parts = [part for seeks, i in theirs for gives_, j in ours if (part := shared(seeks & gives_, ids[i], x[i], reach[i], y[j], w[j], wv[j]))]
        kinds = (("id", np.int64), ("d", np.float64), ("w", np.float64), ("wv", np.float64))
        return pa.table({c: np.concatenate([p[n] for p in parts]).astype(kind) if parts else np.zeros(0, kind) for n, (c, kind) in enumerate(kinds)})

    def all_pairs(ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, wv: np.ndarray) -> tuple[np.ndarray, ...]:
        d = np.round(distances(x, y), DECIMALS)
        far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        who, which = np.nonzero((d <= far[:, None]) & np.isfinite(d))
        at, *rest = levels(who, d[who, which], w[which], wv[which], k)
        return ids[at], *rest

    def shared(known: np.ndarray, ids: np.ndarray, x: np.ndarray, reach: np.ndarray, y: np.ndarray, w: np.ndarray, wv: np.ndarray) -> tuple[np.ndarray, ...] | None:
        if not known.any():
            return None
        scale = len(known) / known.sum()
        (x, of), (y, spot) = distinct(x[:, known]), distinct(y[:, known])
        most = np.full(len(x), -np.inf)
        np.maximum.at(most, of, reach)
        w, wv = np.bincount(spot, weights=w), np.bincount(spot, weights=wv)
        at, d, w, wv = nearest_levels(x, most, y, w, wv, scale, k, DECIMALS)
        # Every seeker gets the levels of its place.
        starts = np.searchsorted(at, np.arange(len(x) + 1))
        often = np.diff(starts)[of]
        rows = np.repeat(starts[of] - np.cumsum(often) + often, often) + np.arange(often.sum())
        return np.repeat(ids, often), d[rows], w[rows], wv[rows]

    return found


def _nearest_levels(found: DataFrame, k: int) -> DataFrame:
    """Per seeker the distances up to the one that completes k donors, with the donors before each."""
    levels = found.groupBy("id", "d").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))
    before = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return levels.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0.0))).where(F.col("before") < k)


def impute_nearest(df: DataFrame, row_id: str, target: str, others: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """``df`` with the nulls of ``target`` filled by the distance-weighted mean of the ``k`` nearest rows that have the value.

    Distances run over the other numbers, standardised, and only over those that both rows know (scaled up by the root of all /
    shared); rows that share none are no donors. Donors equally far share what is left of the k places; if some are at
    distance 0, theirs is the fill. A seeker without any donor gets the mean of the column. Equal donor positions are one donor
    with a weight, equal seekers one seeker. Exact: a seeker first looks into the cell whose k-th donor should be the nearest,
    which bounds how far it can be, then into every other cell that may hold a nearer one.
    """
    others = list(dict.fromkeys(c for c in others if c != target))
    value = _number(target)
    facts = df.agg(F.avg(value).alias("mean"), F.count(value).alias("n"), *[F.struct(F.avg(_number(c)).alias("m"), F.stddev_pop(_number(c)).alias("s")).alias(f"o{i}") for i, c in enumerate(others)]).first()
    if facts["n"] == 0 or not others:
        return df.withColumn(target, F.coalesce(value, F.lit(facts["mean"]).cast("double")))
    spread = [(facts[f"o{i}"]["m"] or 0.0, facts[f"o{i}"]["s"] or 1.0) for i in range(len(others))]
    vec = F.array(*[((_number(c) - float(m)) / float(s)) for c, (m, s) in zip(others, spread)])
    rows = df.select(value.alias("v"), vec.alias("vec"))
    donors = rows.where("v IS NOT NULL").groupBy("vec").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("v").alias("wv"))
    seekers = settle(rows.where("v IS NULL").select("vec").distinct().select(F.monotonically_increasing_id().alias("id"), "vec"))
    k = max(1, min(k, facts["n"] - 1))
    cells, placed = settle_boxes(donors, len(others), k)
    found, schema = _levels_of_piece(k), "id long, d double, w double, wv double"
    first = settle(meet(seekers.withColumn("reach", F.lit(None).cast("double")), cells, placed, True, found, schema, "id", 8 * metric.PIECE))
    bound = _nearest_levels(first, k).groupBy("id").agg(F.max("d").alias("d"), F.sum("w").alias("w")).where(F.col("w") >= k).select("id", (F.col("d") + 10.0**-DECIMALS).alias("reach"))
    more = meet(seekers.join(bound, "id", "left"), cells, placed, False, found, schema, "id", 8 * metric.PIECE)
    used = _nearest_levels(first.unionByName(more), k).withColumn("use", F.least("w", k - F.col("before")))
    weight = F.col("use") / F.col("d")
    fills = used.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("d") == 0, F.col("wv") / F.col("w"))), F.sum(F.when(F.col("d") > 0, weight * F.col("wv") / F.col("w"))) / F.sum(F.when(F.col("d") > 0, weight))).alias("fill"))
    fills = settle(seekers.join(fills, "id").select(F.col("vec").alias("_vec"), F.col("fill").alias("_fill")))
    asks = df.where(value.isNull()).select(F.struct(*df.columns).alias("_row"), vec.alias("_at"))
    filled = asks.join(fills, F.col("_at").eqNullSafe(F.col("_vec")), "left")
    filled = filled.select(*[(F.coalesce("_fill", F.lit(float(facts["mean"]))) if c == target else F.col("_row").getField(c)).alias(c) for c in df.columns])
    return df.where(value.isNotNull()).withColumn(target, value).unionByName(filled)
