"""Neighbour search: equi-joins on grid cells within a radius, blocks of bounded size for the k nearest.

Within a radius, space is cut into cells as wide as it: whoever lies within it is in the same
cell or one of the 26 around it. For the k nearest each frame is cut into blocks of about as many points,
slabs along x and then along y, by approximate quantiles. A block's queries meet its points in one task; those
whose k-th neighbour lies further than their block reaches go to the other blocks that it can touch, once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrafold.functions.geometry import XYZ, all_finite
from terrafold.session import cut, ship_package

_AROUND = list(product((-1, 0, 1), repeat=3))
#: Points of a block, about, and slabs along an axis at most (a power of two).
BLOCK, SLABS = 16_384, 64
#: Widths of cells that a search within a radius chooses from: the radius times 1, 2, 4 and so on.
LEVELS = 8
#: Points of a leaf, by which the points of a block are searched.
LEAF = 64


def _cells(df: DataFrame, size: float, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}c{i}": F.floor(F.col(f"{prefix}{c}") / F.lit(size)).cast("long") for i, c in enumerate(XYZ)})


def radius_join(queries: DataFrame, points: DataFrame, radius: float, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """All pairs (columns of both sides, prefixed q_ and p_, and d2) within ``radius``, its end included. Coincident points and the query itself are pairs."""
    q = _cells(queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]), radius, "q_")
    p = _cells(points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns]), radius, "p_")
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in _AROUND]))
    q = q.withColumn("o", around).withColumns({f"q_c{i}": F.col(f"q_c{i}") + F.col(f"o.d{i}") for i in range(3)}).drop("o")
    on = [q[f"q_c{i}"] == p[f"p_c{i}"] for i in range(3)] + [q[f"q_{b}"] == p[f"p_{b}"] for b in by]
    d2 = sum(((F.col(f"q_{c}") - F.col(f"p_{c}")) * (F.col(f"q_{c}") - F.col(f"p_{c}")) for c in XYZ[1:]), (F.col("q_x") - F.col("p_x")) * (F.col("q_x") - F.col("p_x")))
    return q.join(p, on).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop(*[f"{s}_c{i}" for s in "qp" for i in range(3)])


def nearest_finder(points: DataFrame, radius: float, by: tuple[str, ...] = ("frame",), key: str = "pid") -> Callable[[DataFrame], DataFrame]:
    """A function of queries: the nearest of ``points`` within ``radius``, its end included, of each query that has any there (columns as of ``radius_join``), ties to the smaller id.

    Points are dealt once, to cells of the radius times a power of two: the widest of which none holds more than BLOCK points, and to the cells beside theirs that a ball can
    reach. A query goes to its own cell alone and comes back as one row, so the work does not grow with the pairs within the radius.
    """
    spark, axes = points.sparkSession, [f"c{i}" for i in range(3)]
    ship_package(spark)
    fine = lambda df: df.filter(all_finite()).withColumns({c: F.floor(F.col(x) / F.lit(radius)).cast("long") for c, x in zip(axes, XYZ, strict=True)})
    given = fine(points)
    counts = given.groupBy(*by, *axes).agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(LEVELS)])))
    wide = counts.groupBy("k", *by, *[F.expr(f"shiftright({c}, k)").alias(c) for c in axes]).agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    k = wide.filter(F.col("n") <= BLOCK).agg(F.max("k")).first()[0] or 0
    dealt = given
    for c in axes:
        dealt = dealt.withColumn(c, F.explode(F.sequence(F.shiftright(F.col(c) - 1, k), F.shiftright(F.col(c) + 1, k))))
    dealt = cut(dealt.select(*by, *axes, *[F.col(c).alias(f"p_{c}") for c in points.columns]))
    theirs = dealt.columns[len(by) + 3 :]

    def nearest(queries: DataFrame) -> DataFrame:
        asked = fine(queries).withColumns({c: F.shiftright(c, k) for c in axes}).select(*by, *axes, *[F.col(c).alias(f"q_{c}") for c in queries.columns])
        ours = asked.columns[len(by) + 3 :]

        def met(q: pa.Table, p: pa.Table) -> pa.Table:
            x, y = (np.column_stack([np.asarray(t[f"{s}_{c}"], float) for c in XYZ]) for t, s in ((q, "q"), (p, "p")))
            rank = np.empty(len(y), np.int64)
            rank[np.asarray(pc.sort_indices(p[f"p_{key}"]))] = np.arange(len(y))
            a, b, d2 = nearest_rows(x, np.full(len(x), -1), y, rank, 1, np.full(len(x), radius * radius))
            q, p = q.select(ours).take(pa.array(a)), p.select(theirs).take(pa.array(b))
            return pa.table([*q.columns, *p.columns, pa.array(d2)], names=[*ours, *theirs, "d2"])

        schema = StructType([*(asked.schema[c] for c in ours), *(dealt.schema[c] for c in theirs), StructField("d2", DoubleType())])
        return asked.groupBy(*by, *axes).cogroup(dealt.groupBy(*by, *axes)).applyInArrow(met, schema)

    return nearest


def radius_count(queries: DataFrame, points: DataFrame, radius: float, key: str = "pid", by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """key, n: how many points lie within the radius of each query that has any."""
    return radius_join(queries.select(key, *by, *XYZ), points.select(key, *by, *XYZ), radius, by).groupBy(F.col(f"q_{key}").alias(key)).agg(F.count("*").alias("n"))


def radius_lists(queries: DataFrame, points: DataFrame, radius: float, key: str = "pid", by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """key, n, neighbours (ids, the nearest first, of equal distance the smaller id), farthest: what lies within the radius of each query that has anything there."""
    pairs = radius_join(queries.select(key, *by, *XYZ), points.select(key, *by, *XYZ), radius, by)
    near = F.array_sort(F.collect_list(F.struct(F.round("d2", 12).alias("d"), F.col(f"p_{key}").alias("p"))))
    return pairs.groupBy(F.col(f"q_{key}").alias(key)).agg(F.count("*").alias("n"), near["p"].alias("neighbours"), F.sqrt(F.max("d2")).alias("farthest"))


def radius_pairs(points: DataFrame, radius: float, key: str = "pid", by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Unordered pairs (a < b) within the radius."""
    p = points.select(key, *by, *XYZ)
    pairs = radius_join(p, p, radius, by).filter(F.col(f"q_{key}") < F.col(f"p_{key}"))
    return pairs.select(*[F.col(f"q_{b}").alias(b) for b in by], F.col(f"q_{key}").alias("a"), F.col(f"p_{key}").alias("b"), F.sqrt("d2").alias("distance"))


def _morton(x: np.ndarray) -> np.ndarray:
    """Codes by which points that lie together stand together: ten bits of each axis, in turn."""
    low, span = x.min(0), np.maximum(x.max(0) - x.min(0), 1e-300)
    g = ((x - low) / span * 1023).astype(np.int64)
    code = np.zeros(len(x), np.int64)
    for bit in range(10):
        for axis in range(3):
            code |= ((g[:, axis] >> bit) & 1) << (3 * bit + axis)
    return code


class _Leaves:
    """Points in leaves of about LEAF along a curve, with the box of each."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(_morton(x), kind="stable") if len(x) else np.zeros(0, int)
        self.x = x[self.order]
        self.begin = np.arange(0, len(x), LEAF)
        self.low = np.minimum.reduceat(self.x, self.begin) if len(x) else self.x
        self.high = np.maximum.reduceat(self.x, self.begin) if len(x) else self.x

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        at = (self.begin[leaves][:, None] + np.arange(LEAF)).ravel()
        return at[at < len(self.x)]


def nearest_rows(queries: np.ndarray, own: np.ndarray, points: np.ndarray, rank: np.ndarray, k: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the k nearest of each query no further than ``within`` (squared), by query and distance, ties by ``rank``; ``own``: the rank that a query must not meet, or -1."""
    out: list[tuple] = []
    q, p = _Leaves(queries), _Leaves(points)
    ranks = rank[p.order]
    for i in range(len(q.begin) if len(points) else 0):
        at = q.order[q.begin[i] : q.begin[i] + LEAF]
        x = queries[at]
        gap = np.maximum(0, np.maximum(p.low - q.high[i], q.low[i] - p.high))
        gap = (gap * gap).sum(1)
        near = np.argsort(gap, kind="stable")
        bound = float(within[at].max())
        first = near[: -(-(k + 1) // LEAF) + 1]
        if len(first) < len(near):  # what the nearest leaves hold says how far it can be
            d = _squared(x, p.x[rows := p.rows(np.sort(first))])
            d[ranks[rows] == own[at][:, None]] = np.inf
            bound = min(bound, float(np.partition(d, k - 1, 1)[:, k - 1].max()) if d.shape[1] >= k else np.inf)
        rows = p.rows(np.sort(near[gap[near] <= bound]))
        d = _squared(x, p.x[rows])
        d[(ranks[rows] == own[at][:, None]) | (d > within[at][:, None])] = np.inf
        most = np.partition(d, k - 1, 1)[:, k - 1 : k] if d.shape[1] > k else np.inf
        a, b = np.nonzero((d <= most) & np.isfinite(d))
        order = np.lexsort((ranks[rows[b]], d[a, b], a))
        a, b = a[order], b[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[place < k], b[place < k]
        out.append((at[a], p.order[rows[b]], d[a, b]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (empty, empty, np.zeros(0))  # type: ignore[return-value]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x[:, None, 0] - y[None, :, 0]
    out = d * d
    for axis in (1, 2):
        d = x[:, None, axis] - y[None, :, axis]
        out += d * d
    return out


def _cut_at(points: DataFrame, by: list[str], axis: str, slabs: Column) -> DataFrame:
    """by and ``cuts``: where each group is cut along an axis into ``slabs`` (a power of two) parts of about as many points."""
    parts = F.percentile_approx(axis, F.array(*[F.lit(i / SLABS) for i in range(1, SLABS)]), 4 * SLABS)
    all_ = points.groupBy(*by).agg(parts.alias("all"), F.first(slabs).alias("m"))
    every = F.filter("all", lambda v, i: (i + 1) % (SLABS / F.col("m")) == 0)
    return all_.select(*by, F.array_distinct(every).alias("cuts"))


def _slab(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def knn(queries: DataFrame, points: DataFrame, k: int, key: str = "pid", by: tuple[str, ...] = ("frame",), include_self: bool = True, point_filter: Column | None = None) -> DataFrame:
    """q, p, rank (from 1), distance: the k nearest points of each query in its own frame, ties to the smaller id; all, where a frame has fewer.

    Rows without finite coordinates have no neighbours and are nobody's, nor are rows of a null frame. Frames of up to BLOCK points are a task each; larger ones are
    cut into blocks, and a query meets the blocks that its k nearest can lie in.
    """
    spark, group = points.sparkSession, list(by)
    ship_package(spark)
    known = all_finite()
    for b in by:
        known = known & F.col(b).isNotNull()
    q, p = (df.select(key, *by, *XYZ).filter(known) for df in (queries, points if point_filter is None else points.filter(point_filter)))
    same = q.sameSemantics(p)
    sizes = p.groupBy(*by).agg(F.count("*").alias("__n"))
    small = (sizes.agg(F.max("__n")).first()[0] or 0) <= BLOCK
    sides = [p.withColumn("side", F.lit(3))] if same else [p.withColumn("side", F.lit(1)), q.withColumn("side", F.lit(2))]
    rows = sides[0] if same else sides[0].unionByName(sides[1])
    rows = rows.withColumn("within", F.lit(float("inf")))
    kind = p.schema[key].dataType.simpleString()
    out = f"q {kind}, p {kind}, d2 double"

    def met(table: pa.Table) -> pa.Table:
        side, x = np.asarray(table["side"]), np.column_stack([np.asarray(table[c], float) for c in XYZ])
        ids = table[key].combine_chunks()
        rank = np.empty(len(side), np.int64)
        rank[np.asarray(pc.sort_indices(ids))] = np.arange(len(side))
        if not same:  # a query and a point of one id have one rank
            rank = np.asarray(pc.rank(ids, "ascending", tiebreaker="min")).astype(np.int64)
        asks, gives = np.flatnonzero(side & 2), np.flatnonzero(side & 1)
        own = rank[asks] if not include_self else np.full(len(asks), -1)
        a, b, d2 = nearest_rows(x[asks], own, x[gives], rank[gives], k, np.asarray(table["within"])[asks])
        return pa.table({"q": ids.take(pa.array(asks[a])), "p": ids.take(pa.array(gives[b])), "d2": d2})

    ahead = Window.partitionBy("q").orderBy("d2", "p")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(ahead)).filter(F.col("rank") <= k).select("q", "p", "rank", F.sqrt("d2").alias("distance"))
    if small:
        return ranked(rows.groupBy(*by).applyInArrow(met, out))
    # As many slabs along x as along y.
    slabs = F.least(F.lit(SLABS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("__n") / BLOCK)) / 2)))
    sized = p.join(sizes, group)
    along_x = cut(_cut_at(sized, group, "x", slabs).withColumnRenamed("cuts", "xs"))
    in_slab = sized.join(along_x, group).withColumn("sx", _slab(F.col("x"), F.col("xs")))
    along_y = cut(_cut_at(in_slab, [*group, "sx"], "y", slabs).withColumnRenamed("cuts", "ys"))
    placed = rows.join(along_x, group).withColumn("sx", _slab(F.col("x"), F.col("xs"))).join(along_y, [*group, "sx"], "left")
    placed = placed.withColumn("ys", F.coalesce("ys", F.expr("cast(array() AS array<double>)"))).withColumn("sy", _slab(F.col("y"), F.col("ys")))
    columns = [key, *by, *XYZ, "side", "within", "sx", "sy"]
    inside = cut(placed.select(*columns, "xs", "ys"))
    first = cut(inside.select(*columns).groupBy(*by, "sx", "sy").applyInArrow(met, out))
    # A query is settled where the ball to its k-th neighbour stays in its slabs.
    far = first.groupBy("q").agg(F.count("*").alias("n"), F.max("d2").alias("d2"))
    asks = inside.filter(F.col("side") >= 2).join(far, F.col(key) == F.col("q"), "left").withColumn("within", F.when(F.col("n") >= k, F.col("d2")).otherwise(float("inf")))
    r = F.sqrt("within") * (1 + 1e-12)
    edge = lambda cuts, at: (F.when(F.col(at) > 0, F.element_at(cuts, F.greatest(F.col(at), F.lit(1)))), F.when(F.col(at) < F.size(cuts), F.element_at(cuts, F.least(F.col(at) + 1, F.greatest(F.size(cuts), F.lit(1))))))
    out_of = F.lit(False)
    for c, cuts, at in (("x", "xs", "sx"), ("y", "ys", "sy")):
        low, high = edge(cuts, at)
        out_of = out_of | F.coalesce(F.col(c) - r <= low, F.lit(False)) | F.coalesce(F.col(c) + r >= high, F.lit(False))
    open_ = cut(asks.filter(out_of).select(key, *by, *XYZ, "within", F.col("sx").alias("own_x"), F.col("sy").alias("own_y"), "xs"))
    reach = lambda c, cuts: F.sequence(_slab(F.col(c) - r, F.col(cuts)), _slab(F.col(c) + r, F.col(cuts)))
    asked = open_.withColumn("sx", F.explode(reach("x", "xs"))).join(along_y, [*group, "sx"])
    asked = asked.withColumn("sy", F.explode(reach("y", "ys"))).filter((F.col("sx") != F.col("own_x")) | (F.col("sy") != F.col("own_y"))).withColumn("side", F.lit(2))
    gives = inside.filter(F.col("side").bitwiseAND(F.lit(1)) == 1).withColumn("side", F.lit(1))
    same = False
    second = gives.select(*columns).unionByName(asked.select(*columns)).groupBy(*by, "sx", "sy").applyInArrow(met, out)
    return ranked(first.unionByName(second))


def statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, key: str = "pid", by: str = "frame") -> DataFrame:
    """All points with ``mean_distance`` to their k nearest others and ``kept``: not above mean + ratio * population deviation over the frame.

    A frame of k finite points or fewer keeps them all; points that are not finite have no mean and are not kept.
    """
    near = knn(points, points, k, key, (by,), include_self=False)
    mean = near.groupBy("q").agg(F.avg("distance").alias("mean_distance"))
    out = points.join(mean, points[key] == mean["q"], "left").drop("q")
    # Figures a frame are an aggregate joined back, so a frame is not sorted in one task.
    frames = out.groupBy(by).agg(F.count_if(all_finite()).alias("__n"), F.avg("mean_distance").alias("__m"), F.stddev_pop("mean_distance").alias("__s"))
    out = out.join(frames, by)
    within = (F.col("__n") <= k) | F.coalesce(F.col("mean_distance") <= F.col("__m") + ratio * F.col("__s"), F.lit(True))
    return out.withColumn("kept", all_finite() & within).drop("__n", "__m", "__s")


def radius_outliers(points: DataFrame, radius: float = 0.2, min_points: int = 5, key: str = "pid", by: str = "frame") -> DataFrame:
    """All points with ``neighbours`` (itself too) and ``kept``: at least ``min_points`` of them."""
    n = radius_count(points, points, radius, key, (by,))
    return points.join(n, key, "left").withColumnRenamed("n", "neighbours").withColumn("kept", F.coalesce(F.col("neighbours") >= min_points, F.lit(False)))
