"""A scan's way from raw points to a thinned cloud, quality figures, and parameter sweeps over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geometry import XYZ, all_finite, norm, square_sum
from terrafold.operators.filters import nonzero, removal_counts, removal_stages, voxel_grid, with_removed_by
from terrafold.operators.neighbors import knn, radius_outliers, statistical_outliers
from terrafold.operators.timeseries import quantiles
from terrafold.session import cut


@dataclass(frozen=True)
class ScanConfig:
    nonfinite: bool = True
    zero_eps: float | None = 1e-6
    range: tuple[float, float] | None = (0.5, 50.0)
    crop: tuple | None = None
    voxel: float | None = 0.05
    min_points: int = 1
    averages: tuple[str, ...] = ("intensity",)
    outlier: str = "none"
    outlier_on: str = "voxelized"
    outlier_args: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.range and self.range[1] <= self.range[0]:
            raise ValueError("the range ends before it begins")
        if self.crop and any(a >= b for a, b in zip(*self.crop[:2], strict=True)):
            raise ValueError("a box is empty along an axis")
        if set(self.averages) & {*XYZ, "point_count"}:
            raise ValueError("coordinates and counts are not averaged again")
        if self.outlier not in ("none", "statistical", "radius") or self.outlier_on not in ("filtered", "voxelized"):
            raise ValueError(f"no outlier stage {self.outlier} on {self.outlier_on}")

    def stages(self) -> list[tuple[str, Column]]:
        return removal_stages({"nonfinite": self.nonfinite, "zero_eps": self.zero_eps, "range": self.range, "crop": self.crop})


def _without_outliers(points: DataFrame, config: ScanConfig) -> DataFrame:
    f = {"statistical": statistical_outliers, "radius": radius_outliers}[config.outlier]
    return f(points, **config.outlier_args).filter("kept").select(points.columns)


def run_scan(points: DataFrame, config: ScanConfig = ScanConfig()) -> dict[str, DataFrame]:
    """filtered, voxelized and stats (per frame) of raw points; stages that are off are not in the plan."""
    stages = config.stages()
    marked = with_removed_by(points, stages)
    filtered = marked.filter("removed_by IS NULL").drop("removed_by")
    if config.outlier != "none" and config.outlier_on == "filtered":
        filtered = _without_outliers(filtered, config)
    stats = removal_counts(marked, stages)
    out = {"filtered": filtered}
    if config.voxel:
        voxels = voxel_grid(filtered, config.voxel, tuple(a for a in config.averages if a in points.columns), config.min_points)
        if config.outlier != "none" and config.outlier_on == "voxelized":
            keyed = voxels.withColumn("pid", F.xxhash64("frame", "ix", "iy", "iz"))
            voxels = _without_outliers(keyed, config).drop("pid")
        out["voxelized"] = voxels
        stats = stats.join(voxels.groupBy("frame").agg(F.count("*").alias("voxelized")), "frame", "left").fillna(0, ["voxelized"])
    out["stats"] = stats
    return out


def reduction(stats: DataFrame) -> DataFrame:
    """What part of the input remains: voxels if there are any, else filtered points; 0 of nothing."""
    left = F.when(F.col("voxelized") > 0, F.col("voxelized")).otherwise(F.col("filtered"))
    return stats.withColumn("ratio", F.coalesce(F.try_divide(left.cast("double"), F.col("input")), F.lit(0.0)))


def cloud_quality(points: DataFrame, by: str = "frame", ring: str | None = None, time: str | None = None) -> DataFrame:
    """Per frame: points, non-finite, zero, valid ones and their distances; how many rings, and the span of times, where there are such columns."""
    ok = all_finite() & nonzero()
    r = F.when(ok, norm())
    more = [F.countDistinct(ring).alias("rings")] if ring else []
    more += [(F.max(time) - F.min(time)).alias("t_span")] if time else []
    return points.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(~all_finite()).alias("nonfinite"), F.count_if(all_finite() & ~nonzero()).alias("zero"), F.count_if(ok).alias("valid"),
        F.avg(ok.cast("double")).alias("valid_share"), F.min(r).alias("range_min"), F.percentile(r, F.lit(0.5)).alias("range_median"), F.percentile(r, F.lit(0.99)).alias("range_p99"), F.max(r).alias("range_max"), *more,
    )


def quality_summary(quality: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, min, max over the frames that have it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    return quality.select(pairs.alias("p")).select("p.*").filter("v IS NOT NULL").groupBy("metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def range_sweep(points: DataFrame, low: float, tops: list[float]) -> DataFrame:
    """For each largest range: points kept, their mean a frame, and their share. Each row is read once, whatever the number of ranges."""
    s = square_sum()
    ok = all_finite() & (s >= low * low)
    kept = [F.count_if(ok & (s <= t * t)).alias(f"k{i}") for i, t in enumerate(tops)]
    one = points.groupBy().agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames"), *kept)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("max_range"), F.col(f"k{i}").alias("kept")) for i, t in enumerate(tops)]))
    return one.select(rows.alias("r"), "n", "frames").select("r.max_range", "r.kept", F.try_divide(F.col("r.kept").cast("double"), F.col("frames")).alias("mean_kept"), F.try_divide(F.col("r.kept").cast("double"), F.col("n")).alias("share"))


def range_histogram(points: DataFrame, width: float, bins: int) -> DataFrame:
    """bin, n: bins are closed below, the last one at both ends; what lies beyond is not counted."""
    r = norm()
    at = F.when(r == width * bins, bins - 1).otherwise(F.floor(r / width))
    return points.filter(all_finite()).select(at.cast("int").alias("bin")).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))


def voxel_sweep(points: DataFrame, sizes: list[float]) -> DataFrame:
    """For each voxel size: voxels, what part of the points they are, and how far points lie from the nearest centroid of their frame's voxels. One search serves all sizes."""
    n = points.count()
    keyed = cut(points.select("frame", "pid", *XYZ, F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("size")).withColumn("key", F.xxhash64("pid", "size")))
    cell = [F.floor(F.col(c) / F.col("size")).cast("long").alias(f"i{c}") for c in XYZ]
    voxels = keyed.select("size", "frame", *XYZ, *cell).groupBy("size", "frame", "ix", "iy", "iz").agg(*[F.avg(c).alias(c) for c in XYZ])
    voxels = cut(voxels.withColumn("key", F.xxhash64("size", "ix", "iy", "iz")))
    near = knn(keyed, voxels, 1, "key", ("size", "frame")).select(F.col("q").alias("key"), F.col("distance").alias("e"))
    errors = cut(keyed.select("key", "size").join(near, "key"))
    figures = errors.groupBy("size").agg(F.avg("e").alias("error_mean")).join(quantiles(errors, ("size",), {"error_p95": (F.col("e"), 0.95)}), "size")
    return voxels.groupBy("size").agg(F.count("*").alias("voxels")).join(figures, "size").withColumn("reduction", F.col("voxels") / F.lit(float(max(n, 1))))


def centroid_error(points: DataFrame, size: float) -> DataFrame:
    """Each point's distance to the nearest centroid of its frame's voxels."""
    v = voxel_grid(points, size).select("frame", F.xxhash64("ix", "iy", "iz").alias("pid"), *XYZ)
    return knn(points, v, 1).select(F.col("q").alias("pid"), F.col("distance").alias("error"))


def outlier_comparison(points: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """method, removed, share removed, and median distances of removed and kept; ``methods``: points with ``kept``."""
    every = None
    for name, marked in methods.items():
        one = marked.select(F.lit(name).alias("method"), "kept", norm().alias("r"))
        every = one if every is None else every.unionByName(one)
    every = cut(every)
    out = every.groupBy("method").agg(F.count_if(~F.col("kept")).alias("removed"), F.avg((~F.col("kept")).cast("double")).alias("removed_share"))
    medians = quantiles(every, ("method",), {"median_removed": (F.when(~F.col("kept"), F.col("r")), 0.5), "median_kept": (F.when(F.col("kept"), F.col("r")), 0.5)})
    return out.join(medians, "method", "left")
