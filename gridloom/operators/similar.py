"""Near-duplicate rows and near-equal texts, found exactly and without forming all pairs of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.plans.metric import distances, matrix, meet, sample_nearest, settle_cells, stripes
from gridloom.plans.ordered import grouped_quantiles, with_previous
from gridloom.session import settle

FLOOR, SHARE = 0.05, 0.05
GRID_COLUMNS, HALVINGS, CELL_POINTS = 3, 16, 32


def _neighbours(asks: DataFrame, points: DataFrame, zs: Sequence[str], reach: float) -> DataFrame:
    """Per asking point: nearest distance within ``reach`` and the nearest later point (by id) within it.

    Points meet only in equal or touching cells (over the ``g`` columns) of the size of the reach; pairs are folded into
    two aggregates as they are formed and never stored.
    """
    gs = [c for c in points.columns if c.startswith("g")]
    keys = [f"_c{i}" for i in range(len(gs))]
    cell = lambda df: df.select("*", *[F.floor(F.col(g) / reach).alias(k) for g, k in zip(gs, keys)])
    spread = cell(asks)
    for k in keys:
        spread = spread.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    a = spread.select(*keys, *[F.col(z).alias(f"{z}_a") for z in zs], F.col("last_id").alias("id_a"))
    b = cell(points).select(*keys, *[F.col(z).alias(f"{z}_b") for z in zs], F.col("last_id").alias("id_b"))
    dist = F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.col(f"{z}_a") - F.col(f"{z}_b"), F.lit(2)) for z in zs]))
    near = a.join(b, keys).where("id_a <> id_b").withColumn("d", dist).where(F.col("d") <= reach)
    later = F.col("id_b") > F.col("id_a")
    return near.groupBy("id_a").agg(F.min("d").alias("_nearest"), F.min(F.when(later, F.struct("d", "id_b"))).alias("_later"))


def _first_reach(points: DataFrame) -> float:
    """The largest halving of the floor at which no cell holds more than a few points (the smallest one tried otherwise)."""
    gs = [c for c in points.columns if c.startswith("g")]
    sizes = points.select(F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("j"), *gs).groupBy(
        "j", *[F.floor(F.col(g) * F.pow(F.lit(2.0), F.col("j")) / FLOOR).alias(f"_{g}") for g in gs]).agg(F.count(F.lit(1)).alias("n"))
    most = {r["j"]: r["n"] for r in sizes.groupBy("j").agg(F.max("n").alias("n")).collect()}
    return FLOOR / 2 ** next((j for j in range(HALVINGS) if most.get(j, 0) <= CELL_POINTS), HALVINGS)


def near_duplicate_rows(df: DataFrame, row_id: str, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Each row with its nearest later near-duplicate.

    Rows are compared on standardised numbers. The threshold is the 5th percentile of all rows' nearest distances, at
    least 0.05. The reach starts where cells hold few points and doubles until the floor is passed and enough nearest
    distances are known to fix that percentile. A point that knows its nearest and its nearest later one asks no more, so
    in a dense cell only the few that still lack a later one go on to larger cells. Identical rows are one point; a
    copy's partner is the next copy. More than three columns go to ``near_duplicate_vectors``.
    """
    cols = list(cols)
    if len(cols) > GRID_COLUMNS:
        vector = F.array(*[F.col(c).cast("double") for c in cols])
        return near_duplicate_vectors(df.select(F.col(row_id), vector.alias("vec")), row_id, "vec", exact)
    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    s = rows.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    n = s["n"]
    schema = "first_id bigint, second_id bigint, distance double"
    if n < 5:
        return df.sparkSession.createDataFrame([], schema)
    zs = [f"z{i}" for i in range(len(cols))]
    points = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"), F.max(row_id).alias("last_id")).select(
        "copies", "last_id", *[((F.col(c) - s[c]["m"]) / (s[c]["s"] or 1.0)).alias(z) for c, z in zip(cols, zs)])
    points = settle(points.select("*", *[F.col(z).alias(f"g{i}") for i, z in enumerate(zs)]))
    span = points.agg(*[(F.max(z) - F.min(z)).alias(z) for z in zs]).first()
    widest = sum(v * v for v in span) ** 0.5
    need = floor((n - 1) * SHARE) + 2
    reach = _first_reach(points)
    asks = points.select("*", F.lit(None).cast("double").alias("nearest"), F.lit(None).cast("struct<d:double,id_b:bigint>").alias("later"))
    parts: list[DataFrame] = []
    while True:
        found = _neighbours(asks, points, zs, reach)
        state = settle(asks.join(found, asks["last_id"] == found["id_a"], "left").select(
            *points.columns, F.coalesce("nearest", "_nearest").alias("nearest"), F.coalesce("later", F.struct(F.col("_later.d").alias("d"), F.col("_later.id_b").cast("bigint").alias("id_b"))).alias("later")
        ).withColumn("later", F.when(F.col("later.id_b").isNotNull(), F.col("later"))))
        complete = F.col("nearest").isNotNull() & F.col("later").isNotNull()
        parts.append(state.where(complete))
        asks = state.where(~complete)
        near = reduce(lambda x, y: x.unionByName(y), parts, asks)
        known = near.select(F.when(F.col("copies") > 1, 0.0).otherwise(F.col("nearest")).alias("d"), F.col("copies").alias("w")).where("d IS NOT NULL")
        have = known.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        if reach >= FLOOR and (have >= min(need, n) or reach > widest):
            break
        reach *= 2
    # The wanted rank lies among the known distances; the rest only counts.
    at = (n - 1) * SHARE
    p5 = grouped_quantiles(known, [], "d", {"q": min(1.0, at / max(have - 1, 1))}, weight="w").first()
    limit = max(FLOOR, p5["q"] if p5 else FLOOR)
    pairs = near.where(F.col("later").isNotNull() & (F.col("later.d") <= limit)).select(
        F.col("last_id").alias("first_id"), F.col("later.id_b").alias("second_id"), F.round("later.d", 4).alias("distance"))
    if not exact:
        return pairs
    copies = with_previous(rows.withColumn("_h", F.xxhash64(*cols)), ["_h", *cols], row_id).where("prev IS NOT NULL").select(
        F.col("prev").alias("first_id"), F.col(row_id).alias("second_id"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(copies)


def _nearest_of_piece(asks: pa.Table, gives: pa.Table) -> pa.Table:
    """Per asking point of a piece: distance of the nearest other point, distance and id of the nearest later one."""
    ids, others = asks["id"].to_numpy(), gives["d_id"].to_numpy()
    width = len((asks["vec"] if asks.num_rows else gives["d_vec"])[0])  # a piece that nobody visits has donors only
    x, y = matrix(asks["vec"], width), matrix(gives["d_vec"], width)
    nearest, later, later_id = np.full(len(ids), np.inf), np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    order = np.argsort(others, kind="stable")  # of equally near later points the first is found
    others, y = others[order], y[order]
    for s in stripes(len(ids)):
        if not len(others):
            break
        d = distances(x[s], y)
        d[ids[s][:, None] == others[None, :]] = np.inf
        nearest[s] = d.min(axis=1)
        d[ids[s][:, None] > others[None, :]] = np.inf
        at = d.argmin(axis=1)
        later[s], later_id[s] = d[np.arange(len(at)), at], others[at]
    hit = np.isfinite(later)
    return pa.table({"id": ids, "nearest": pa.array(nearest, mask=~np.isfinite(nearest)), "later": pa.array(later, mask=~hit), "later_id": pa.array(later_id, mask=~hit)})


_PIECE = "id long, nearest double, later double, later_id long"


def near_duplicate_vectors(df: DataFrame, row_id: str, vec: str, exact: bool = True) -> DataFrame:
    """Each row with its nearest later near-duplicate, as ``near_duplicate_rows``, over all components of a vector column.

    The vector stays one column, so no plan grows with its width. Points live in cells around pivots. A sample of points gives a
    reach that most likely holds the 5th percentile of nearest distances; it doubles while too few are known. Each point first
    looks into its own cell, then into the cells that its nearest later point so far, or the reach, can touch. Rows whose vector
    is null, holds a null or has another width than the widest are left out; copies of a vector are one point. Ties go to
    the smaller id.
    """
    schema = "first_id bigint, second_id bigint, distance double"
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("raw")).where(F.col("id").isNotNull() & F.col("raw").isNotNull() & ~F.exists("raw", lambda v: v.isNull() | F.isnan(v)))
    width = rows.agg(F.max(F.size("raw"))).first()[0] or 0
    rows = rows.where(F.size("raw") == width)
    parts = rows.select(F.posexplode("raw").alias("place", "v")).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("place").collect()
    n = parts[0]["n"] if parts else 0
    if n < 5:
        return df.sparkSession.createDataFrame([], schema)
    centre, scale = (F.array(*[F.lit(float(r[c]) if c == "m" else float(r[c]) or 1.0) for r in parts]) for c in ("m", "s"))
    standard = F.zip_with(F.zip_with("raw", centre, lambda v, m: v - m), scale, lambda v, s: v / s)
    points = settle(rows.groupBy("raw").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("id")).select("id", "copies", standard.alias("vec")))
    need = min(n, floor((n - 1) * SHARE) + 2)
    sampled = sample_nearest(points, width)
    # Three deviations above the wanted share of the sample.
    at = SHARE + 3 * (SHARE * (1 - SHARE) / max(1, len(sampled))) ** 0.5
    reach = max(FLOOR, float(sampled[min(len(sampled) - 1, ceil(at * len(sampled)))]) if len(sampled) and np.isfinite(sampled).all() else FLOOR)
    cells, donors = settle_cells(points.select("id", "vec"), width)
    at_home = meet(points.select("id", "vec", F.lit(0.0).alias("reach")), cells, donors, True, _nearest_of_piece, _PIECE, "id")
    best = lambda found: found.groupBy("id").agg(
        F.min("nearest").alias("nearest"), F.min(F.when(F.col("later").isNotNull(), F.struct("later", "later_id"))).alias("after"))
    first = settle(best(at_home))
    while True:
        seekers = points.join(first, "id").select("id", "vec", F.least(F.coalesce("after.later", F.lit(reach)), F.lit(reach)).alias("reach"))
        abroad = meet(seekers, cells, donors, False, _nearest_of_piece, _PIECE, "id")
        whole = first.select("id", "nearest", F.col("after.later").alias("later"), F.col("after.later_id").alias("later_id")).unionByName(abroad)
        near = settle(points.select("id", "copies").join(best(whole), "id").select("id", "copies", F.when(F.col("nearest") <= reach, F.col("nearest")).alias("nearest"), "after"))
        known = near.select(F.when(F.col("copies") > 1, 0.0).otherwise(F.col("nearest")).alias("d"), F.col("copies").alias("w")).where("d IS NOT NULL")
        have = known.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        if have >= need or near.where("nearest IS NULL").isEmpty():
            break
        reach *= 2
    p5 = grouped_quantiles(known, [], "d", {"q": min(1.0, (n - 1) * SHARE / max(have - 1, 1))}, weight="w").first()
    limit = max(FLOOR, p5["q"] if p5 else FLOOR)
    pairs = near.where(F.col("after.later") <= limit).select(F.col("id").alias("first_id"), F.col("after.later_id").alias("second_id"), F.round("after.later", 4).alias("distance"))
    if not exact:
        return pairs
    copies = with_previous(rows.withColumn("_h", F.xxhash64("raw")), ["_h", "raw"], "id").where("prev IS NOT NULL").select(
        F.col("prev").alias("first_id"), F.col("id").alias("second_id"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(copies)


def explain_pairs(df: DataFrame, pairs: DataFrame, row_id: str) -> DataFrame:
    """Per pair and differing column: both values as text, the kind of difference and the percent difference of numbers."""
    from gridloom.plans.stacked import numeric_columns

    nums = set(numeric_columns(df))
    cols = [c for c in df.columns if c != row_id]
    a, b = df.alias("a"), df.alias("b")
    j = pairs.join(a, F.col("first_id") == F.col(f"a.{row_id}")).join(b, F.col("second_id") == F.col(f"b.{row_id}"))
    cells = []
    for c in cols:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        one = x.isNull() != y.isNull()
        pct = F.round(F.abs(x.cast("double") - y.cast("double")) / (F.abs(x.cast("double")) + 1e-10) * 100, 1) if c in nums else F.lit(None).cast("double")
        cells.append(F.when(~x.eqNullSafe(y), F.struct(
            F.lit(c).alias("column"), x.cast("string").alias("value_a"), y.cast("string").alias("value_b"),
            F.when(one, "one_missing").otherwise("numeric" if c in nums else "text").alias("kind"), pct.alias("pct_diff"))))
    return j.select("first_id", "second_id", F.inline(F.array_compact(F.array(*cells))))


# --- near-equal texts -------------------------------------------------------------------------------------------------

THRESHOLD = 85.0
SHORT, LONG = 11, 5
#: A token that more texts than this would meet on is joined by the next shared one, up to so many tokens.
HOT, LEVELS = 64, 4


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    v = mask
    for ch in b:
        m = where.get(ch, 0)
        u = v & m
        v = ((v + u) | (v - u)) & mask
    return len(a) - bin(v).count("1")


def similarity(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / total length)."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 100.0 * 2 * common_length(a, b) / total


@F.pandas_udf(DoubleType())
def similarity_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def sorted_words(c):
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")), " ")


def _numbered_grams(vals: DataFrame, q: int) -> DataFrame:
    """(vid, len, token): the q-grams of a text, the second one of a kind numbered 2 and so on, so that sets count repeats."""
    grams = vals.select("vid", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("len") - (q - 1)), lambda i: F.substr("text", i, F.lit(q)))).alias("gram"))
    return grams.groupBy("vid", "len", "gram").agg(F.count(F.lit(1)).alias("k")).select(
        "vid", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat_ws("#", "gram", i.cast("string")))).alias("token"))


def _candidates(vals: DataFrame, q: int) -> DataFrame:
    """Pairs that share the rare tokens which similar texts must share.

    Tokens are the numbered q-grams of the sorted text. Two texts at 85 or above share at least ``t`` of them (85 % of
    the characters; with bigrams each edit spoils at most two), so the j-th rarest they share is among each one's rarest
    ``count - t + j``. Texts meet on the rarest shared token; where more than HOT texts have one there, they meet on it and
    the next shared one instead, and so on, so that a word which all values have joins nobody with everybody.
    """
    ratio = THRESHOLD / 100
    shortest = ratio / (2 - ratio)  # a partner is at least this share of the length
    d = vals.where(F.col("len") <= SHORT) if q == 1 else vals.where(F.col("len") >= LONG)
    tokens = _numbered_grams(d, q)
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    share = ratio / 2 * (1 + shortest)
    t = F.ceil(F.col("len") * share - 1e-9) if q == 1 else F.ceil(F.col("len") * (3 * ratio / 2 - 1) * (1 + shortest) - 1 - 1e-9)
    # A text's own tokens, at most its length, from the rarest on.
    ordered = tokens.join(freq, "token").groupBy("vid", "len").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda s: s["token"]).alias("ts")).select(
        "vid", "len", "ts", F.greatest(t, F.lit(1)).cast("int").alias("t"))
    upto = lambda j: F.least(F.size("ts"), F.size("ts") - F.col("t") + j)
    rows = settle(ordered.select("*", F.posexplode(F.slice("ts", 1, upto(1))).alias("at", "key")))
    parts = []
    for level in range(1, LEVELS + 1):
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = settle(rows.join(counts, "key"))
        hot = (F.col("n") > HOT) & F.lit(level < LEVELS)
        # Texts that need no further shared token stay too; they are short, so few of them are different.
        parts.append(_meeting(rows.where(~hot | (F.col("t") <= level)), shortest))
        rows = rows.where(hot).drop("n")
        if level == LEVELS or rows.isEmpty():
            break
        further = F.slice("ts", F.col("at") + 2, F.greatest(F.lit(0), upto(level + 1) - F.col("at") - 1))
        rows = settle(rows.select("vid", "len", "ts", "t", F.col("at").alias("before"), "key", F.posexplode(further).alias("step", "token")).select(
            "vid", "len", "ts", "t", (F.col("before") + 1 + F.col("step")).alias("at"), F.concat_ws("\u0001", "key", "token").alias("key")))
    return reduce(lambda x, y: x.union(y), parts).distinct()


def _meeting(rows: DataFrame, shortest: float) -> DataFrame:
    a = rows.select(F.col("vid").alias("a"), F.col("len").alias("la"), "key")
    b = rows.select(F.col("vid").alias("b"), F.col("len").alias("lb"), "key")
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.least("la", "lb") >= F.greatest("la", "lb") * shortest - 1e-9)).select("a", "b")


def similar_texts(df: DataFrame, col: str, row_id: str) -> DataFrame:
    """All pairs of distinct values of a column with token-sorted similarity of 85 or more; ``a`` occurs first.

    Candidates whose characters, whatever their order, can't reach 85 are dropped in the JVM; the rest is compared in batches.
    """
    vals = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(row_id).alias("vid")).select(
        "vid", "value", sorted_words(F.col("value")).alias("text")).withColumn("len", F.length("text"))
    vals = settle(vals.where("len > 0"))
    pairs = _candidates(vals, 1).union(_candidates(vals, 2)).distinct()
    bags = vals.join(_numbered_grams(vals, 1).groupBy("vid").agg(F.collect_list("token").alias("bag")), "vid")
    x, y = bags.select(F.col("vid").alias("a"), F.col("value").alias("value_a"), F.col("text").alias("ta"), F.col("bag").alias("bag_a")), bags.select(
        F.col("vid").alias("b"), F.col("value").alias("value_b"), F.col("text").alias("tb"), F.col("bag").alias("bag_b"))
    able = 200 * F.size(F.array_intersect("bag_a", "bag_b")) >= THRESHOLD * (F.size("bag_a") + F.size("bag_b"))
    j = pairs.join(x, "a").join(y, "b").where(able).select("a", "b", "value_a", "value_b", similarity_column("ta", "tb").alias("score"))
    return j.where(F.col("score") >= THRESHOLD).select("a", "b", "value_a", "value_b", F.round("score", 1).alias("score"))


def fuzzy_groups(df: DataFrame, col: str, row_id: str) -> DataFrame:
    """Values grouped under a canonical one: a value is canonical unless it is similar to an earlier canonical value, and
    belongs to the earliest canonical value it is similar to.

    Decided in rounds: a value whose earlier neighbours are all decided is decided itself.
    """
    edges = settle(similar_texts(df, col, row_id))
    earlier = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
    state = settle(earlier.select("v").union(earlier.select("u")).distinct().withColumn("role", F.lit("open")))
    while True:
        seen = earlier.join(state.select(F.col("v").alias("u"), F.col("role").alias("ur")), "u").groupBy("v").agg(
            F.bool_or(F.col("ur") == "centre").alias("near"), F.bool_and(F.col("ur") == "member").alias("free"))
        nxt = state.join(seen, "v", "left").select("v", F.when(F.col("role") != "open", F.col("role")).when(F.col("near"), "member").when(
            F.coalesce("free", F.lit(True)), "centre").otherwise("open").alias("role"))
        state = settle(nxt)
        if state.where("role = 'open'").isEmpty():
            break
    centres = state.where("role = 'centre'").select(F.col("v").alias("a"))
    members = state.where("role = 'member'").select(F.col("v").alias("b"))
    best = edges.join(centres, "a").join(members, "b").groupBy("b").agg(F.min(F.struct("a", "value_a", "value_b", "score")).alias("s"))
    return best.select(F.col("s.value_a").alias("canonical"), F.col("s.value_b").alias("value"), F.col("s.score").alias("score"))
