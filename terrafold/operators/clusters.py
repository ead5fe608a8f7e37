"""Euclidean clusters, their descriptors, local shape of point neighbourhoods, boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.geometry import XYZ, dominant_shape, dot, eigenvalues, plane_basis, shape_features, unit, with_eigen
from terrafold.operators.components import connected_components
from terrafold.operators.neighbors import knn, radius_pairs
from terrafold.session import cut, ship_package

MOMENTS = ("xx", "xy", "xz", "yy", "yz", "zz")
#: Local shape of a point's neighbourhood, as ``normals`` gives it.
LOCAL = ("curvature", "linearity", "planarity", "scattering")


def clusters(points: DataFrame, tolerance: float, min_size: int = 1, max_size: int = 0, key: str = "pid", by: str = "frame") -> DataFrame:
    """All points with ``component`` (the least id of those reachable), ``size`` and ``cluster_id``: per frame 0 for the largest, ties by component; -1 if too small or too large."""
    linked = connected_components(radius_pairs(points, tolerance, key, (by,)), "a", "b")
    all_ = points.join(linked, points[key] == linked["node"], "left").withColumn("component", F.coalesce("component", F.col(key))).drop("node")
    sizes = all_.groupBy(by, "component").agg(F.count("*").alias("size"))
    good = (F.col("size") >= min_size) & (F.lit(max_size == 0) | (F.col("size") <= max_size))
    ranked = sizes.filter(good).withColumn("cluster_id", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("size"), "component")) - 1)
    return all_.join(sizes, [by, "component"]).join(ranked.select(by, "component", "cluster_id"), [by, "component"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def moments() -> list[Column]:
    """Population covariances of a group."""
    return [F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]


def as_matrix(prefix: str = "") -> dict[str, Column]:
    return {m: F.col(prefix + m) for m in MOMENTS}


def descriptors(clustered: DataFrame, height: str | None = None, min_height: float | None = None, by: str = "frame") -> DataFrame:
    """Per cluster: count, centroid, extremes, heights, shape, and the means of what local shape its points have (``mean_curvature`` and so on, of those that are numbers);
    clusters lower than ``min_height`` go and the rest are numbered anew."""
    inside = clustered.filter("cluster_id >= 0")
    local = [F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(f"mean_{c}") for c in LOCAL if c in clustered.columns]
    h = F.col(height) if height else F.col("z")
    out = inside.groupBy(by, "cluster_id").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in XYZ], *[F.min(c).alias(f"min_{c}") for c in XYZ], *[F.max(c).alias(f"max_{c}") for c in XYZ],
        F.min(F.nanvl(h, F.lit(None).cast("double"))).alias("h_min"), F.max(F.nanvl(h, F.lit(None).cast("double"))).alias("h_max"), *moments(), *local,
    )
    out = out.withColumns({f"l{i}": v for i, v in enumerate(eigenvalues(as_matrix()))})
    out = out.withColumns(shape_features([F.col(f"l{i}") for i in range(3)])).drop("l0", "l1", "l2")
    out = out.withColumn("shape", dominant_shape(F.col("linearity"), F.col("planarity"), F.col("scattering"))).drop(*MOMENTS)
    if min_height is not None:
        out = out.filter(F.coalesce(F.col("h_max") >= min_height, F.lit(True))).withColumn("cluster_id", F.row_number().over(Window.partitionBy(by).orderBy("cluster_id")) - 1)
    return out


def neighborhood_moments(queries: DataFrame, points: DataFrame, k: int, key: str = "pid", by: str = "frame", radius: float | None = None) -> DataFrame:
    """q, n and the covariances of the k nearest points (itself too) of each query."""
    near = knn(queries, points, k, key, (by,))
    if radius:
        near = near.filter(F.col("distance") <= radius)
    return near.join(points.select(F.col(key).alias("p"), *XYZ), "p").groupBy("q").agg(F.count("*").alias("n"), *moments())


def normals(points: DataFrame, k: int = 30, min_neighbors: int = 5, orientation: str = "viewpoint", viewpoint: tuple = (0.0, 0.0, 0.0), reference: tuple = (0.0, 0.0, 1.0), key: str = "pid", by: str = "frame", radius: float | None = None) -> DataFrame:
    """Points with normal nx, ny, nz, curvature and verticality; null where too few neighbours lie near."""
    m = cut(neighborhood_moments(points, points, k, key, by, radius))
    m = with_eigen(m, as_matrix())
    m = m.select("q", "n", "normal", *[c.alias(f) for f, c in shape_features([F.col(f"l{i}") for i in range(3)]).items()])
    few = F.col("n") < min_neighbors
    p = points.join(m, points[key] == m["q"], "left").drop("q")
    at = [F.col("normal")[i] for i in range(3)]
    facing = {
        "viewpoint": dot([F.lit(v) - F.col(c) for v, c in zip(viewpoint, XYZ, strict=True)], at),
        "reference": dot(at, reference), "none": F.lit(1.0),
    }[orientation]
    sign = F.when(few, None).when(facing < 0, -1.0).otherwise(1.0)
    out = p.withColumns({f"n{c}": a * sign for c, a in zip(XYZ, at, strict=True)})
    out = out.withColumns({f: F.when(~few, F.col(f)) for f in ("curvature", "linearity", "planarity", "scattering")})
    return out.withColumn("verticality", 1 - F.abs(F.col("nz"))).drop("normal", "n")


# Boxes of whole clusters: axes from what a cluster's plan or moments say, extents from grouped extremes.

_PLAN = "plan array<struct<x:double,y:double>>"


def _hull(p: np.ndarray) -> np.ndarray:
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def plan_direction(hull: np.ndarray) -> np.ndarray:
    """The unit vector of that edge of a convex outline along which its rectangle has the least area; of equal ones that nearest to the x axis."""
    edges = np.roll(hull, -1, axis=0) - hull if len(hull) > 1 else np.array([[1.0, 0.0]])
    sides = edges / np.hypot(*edges.T)[:, None]
    # A rectangle has four sides: each edge stands for the one of them that points right, or up if none does.
    sides = np.where(np.abs(sides[:, :1]) >= np.abs(sides[:, 1:]), sides, sides @ np.array([[0.0, 1.0], [-1.0, 0.0]]))
    sides *= np.where(sides[:, :1] < 0, -1.0, 1.0)
    reach = lambda e: np.ptp(hull @ e.T, axis=0)
    area = reach(sides) * reach(sides @ np.array([[0.0, 1.0], [-1.0, 0.0]]))
    least = np.flatnonzero(area <= area.min() * (1 + 1e-9) + 1e-300)
    return sides[least[np.argmax(sides[least, 0])]]


def _plans(inside: DataFrame, by: str) -> DataFrame:
    """by, cluster_id and the corners of each cluster's convex outline in plan: outlines of batches first, so no task holds a whole cluster's points."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = t.group_by([by, "cluster_id"]).aggregate([("x", "list"), ("y", "list")])
            hulls = [_hull(np.column_stack([x, y])) for x, y in zip(keys["x_list"].to_pylist(), keys["y_list"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({by: keys[by].combine_chunks(), "cluster_id": keys["cluster_id"].combine_chunks(), "plan": [[{"x": a, "y": b} for a, b in h.tolist()] for h in hulls]})

    keys = ", ".join(f"{c} {inside.schema[c].dataType.simpleString()}" for c in (by, "cluster_id"))
    parts = inside.select(by, "cluster_id", "x", "y").mapInArrow(partial, f"{keys}, {_PLAN}")
    return parts.groupBy(by, "cluster_id").agg(F.flatten(F.collect_list("plan")).alias("plan"))


def _axes(inside: DataFrame, kind: str, by: str) -> DataFrame:
    """by, cluster_id, rotation: the axes of each cluster's box as rows of numbers, right-handed."""
    known = inside.groupBy(by, "cluster_id")
    if kind == "upright":
        given, column = _plans(inside, by), "plan"
    else:
        given, column = known.agg(F.count("*").alias("n"), *moments()), "n"

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                if kind == "upright":
                    c, s = plan_direction(_hull(np.array([(p["x"], p["y"]) for p in row["plan"]])))
                    axes = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
                elif row["n"] >= 3:
                    m = [row[k] for k in MOMENTS]
                    axes = np.linalg.eigh(np.array([[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]))[1][:, ::-1]
                    axes = axes * np.array([1, 1, np.sign(np.linalg.det(axes))])
                else:
                    axes = np.eye(3)
                out.append(axes.tolist())
            yield pa.RecordBatch.from_arrays([b[by], b["cluster_id"], pa.array(out, pa.list_(pa.list_(pa.float64())))], names=[by, "cluster_id", "rotation"])

    keys = ", ".join(f"{c} {inside.schema[c].dataType.simpleString()}" for c in (by, "cluster_id"))
    return given.select(by, "cluster_id", column, *(MOMENTS if kind == "pca" else ())).mapInArrow(turned, f"{keys}, rotation array<array<double>>")


def boxes(clustered: DataFrame, kind: str = "upright", by: str = "frame", up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """A box of each cluster: ``axis`` aligned, ``upright`` of least area in plan, or along the ``pca`` axes, the longest spread first: center, extent, rotation, volume.

    ``up`` is the direction that upright boxes stand along, of any length but 0.
    """
    ship_package(clustered.sparkSession)
    if kind == "upright" and unit(up) != (0.0, 0.0, 1.0):
        # Boxes of the points seen from axes of which the last is up, turned back.
        axes = [*plane_basis(up), tuple(unit(up))]
        seen = clustered.select(by, "cluster_id", *[sum((F.col(c) * w for c, w in zip(XYZ[1:], a[1:], strict=True)), F.col("x") * a[0]).alias(n) for n, a in zip(XYZ, axes, strict=True)])
        back = lambda at: [sum((at(k) * axes[k][i] for k in (1, 2)), at(0) * axes[0][i]) for i in range(3)]
        rotation = F.array(*[F.array(*[back(lambda k, j=j: F.col("rotation")[k][j])[i] for j in range(3)]) for i in range(3)])
        return boxes(seen, kind, by).select(by, "cluster_id", F.array(*back(lambda k: F.col("center")[k])).alias("center"), "extent", rotation.alias("rotation"), "volume")
    inside = clustered.filter("cluster_id >= 0").select(by, "cluster_id", *XYZ)
    if kind == "axis":
        unit_axes = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
        placed = inside.withColumn("rotation", unit_axes)
    else:
        placed = inside.join(_axes(inside, kind, by), [by, "cluster_id"])
    r = lambda i, j: F.col("rotation")[i][j]
    along = [F.col("x") * r(0, j) + F.col("y") * r(1, j) + F.col("z") * r(2, j) for j in range(3)]
    found = placed.groupBy(by, "cluster_id").agg(F.first("rotation").alias("rotation"), *[f(a).alias(f"{n}{j}") for j, a in enumerate(along) for n, f in (("lo", F.min), ("hi", F.max))])
    middle = [(F.col(f"lo{j}") + F.col(f"hi{j}")) / 2 for j in range(3)]
    extent = [F.col(f"hi{j}") - F.col(f"lo{j}") for j in range(3)]
    center = F.array(*[r(i, 0) * middle[0] + r(i, 1) * middle[1] + r(i, 2) * middle[2] for i in range(3)])
    return found.select(by, "cluster_id", center.alias("center"), F.array(*extent).alias("extent"), "rotation", (extent[0] * extent[1] * extent[2]).alias("volume"))
