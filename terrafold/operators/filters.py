"""Row filters on points, with account of what each stage removes, and voxel grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.geometry import XYZ, all_finite, dot, square_sum, voxel_keys


def nonzero(eps: float = 1e-6) -> Column:
    """Some coordinate lies off the origin; NaN counts as no distance, as in IEEE comparisons."""
    out = F.lit(False)
    for c in XYZ:
        out = out | (~F.isnan(c) & (F.abs(F.col(c)) > eps))
    return F.coalesce(out, F.lit(False))


def in_range(low: float, high: float) -> Column:
    """Closed at both ends, on squares."""
    s = square_sum()
    return F.coalesce(~F.isnan(s) & (s >= low * low) & (s <= high * high), F.lit(False))


def in_box(low: tuple, high: tuple) -> Column:
    """Within a closed box; NaN is outside."""
    out = F.lit(True)
    for c, a, b in zip(XYZ, low, high, strict=True):
        out = out & F.coalesce(~F.isnan(c) & F.col(c).between(a, b), F.lit(False))
    return out


def below_height(up: tuple, most: float) -> Column:
    return F.coalesce(dot(XYZ, up) <= most, F.lit(False))


def removal_stages(config: dict) -> list[tuple[str, Column]]:
    """(stage, whether a point passes) in order, of the stages that a configuration turns on."""
    out = []
    if config.get("nonfinite", True):
        out.append(("nonfinite", all_finite()))
    if config.get("zero_eps") is not None:
        out.append(("zero", nonzero(config["zero_eps"])))
    if config.get("range"):
        out.append(("range", in_range(*config["range"])))
    if config.get("crop"):
        low, high, negative = config["crop"]
        inside = in_box(low, high)
        out.append(("crop", ~inside if negative else inside))
    return out


def with_removed_by(points: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``removed_by``: the first stage that a point fails, null if it is kept."""
    case = F.lit(None).cast("string")
    for name, passes in reversed(stages):
        case = F.when(~passes, F.lit(name)).otherwise(case)
    return points.withColumn("removed_by", case)


def removal_counts(marked: DataFrame, stages: list[tuple[str, Column]], by: str = "frame") -> DataFrame:
    """Per frame: input, what each stage removed of what was left, and what remains."""
    counts = [F.count_if(F.coalesce(F.col("removed_by") == name, F.lit(False))).alias(f"removed_{name}") for name, _ in stages]
    return marked.groupBy(by).agg(F.count("*").alias("input"), *counts, F.count_if(F.col("removed_by").isNull()).alias("filtered"))


def organized(marked: DataFrame) -> DataFrame:
    """Removed points keep their place and other columns and lose their coordinates."""
    return marked.withColumns({c: F.when(F.col("removed_by").isNull(), F.col(c)) for c in XYZ}).withColumn("kept", F.col("removed_by").isNull())


def frame_density(marked: DataFrame, by: str = "frame") -> DataFrame:
    """Per frame: ``organized_dense``, whether the cloud that keeps its places has lost no point, and of the cloud of kept points alone its width and whether all of them are finite."""
    kept = F.col("removed_by").isNull()
    return marked.groupBy(by).agg(
        F.bool_and(kept).alias("organized_dense"), F.count_if(kept).alias("filtered_width"), F.bool_and(~kept | F.coalesce(all_finite(), F.lit(False))).alias("filtered_dense")
    )


def voxel_grid(points: DataFrame, size: float, averages: tuple[str, ...] = (), min_points: int = 1, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Centroid, means of other fields and count of each voxel that holds ``min_points`` or more."""
    keys = voxel_keys(size)
    out = points.groupBy(*by, *keys).agg(*[F.avg(c).alias(c) for c in XYZ], *[F.avg(c).alias(c) for c in averages], F.count("*").alias("point_count"))
    return out.filter(F.col("point_count") >= min_points) if min_points > 1 else out


def point_to_voxel(points: DataFrame, size: float, min_points: int = 1, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Each point with its voxel's key and count, and the voxel's number by key within its frame; -1 where it holds too few."""
    keyed = points.select("*", *voxel_keys(size))
    cells = keyed.groupBy(*by, "ix", "iy", "iz").agg(F.count("*").alias("point_count"))
    kept = cells.filter(F.col("point_count") >= min_points).withColumn("voxel", F.row_number().over(Window.partitionBy(*by).orderBy("ix", "iy", "iz")) - 1)
    return keyed.join(kept, [*by, "ix", "iy", "iz"], "left").withColumn("voxel", F.coalesce("voxel", F.lit(-1)))


def sample_rows(rows: DataFrame, n: int, by: str, key: str, seed: int = 0) -> DataFrame:
    """n rows of each group, or all of fewer, drawn without replacement: the same in every run, with ``draw``, the order in which they were drawn.

    Keys are mixed by a multiplication; tasks keep their n least of a group before they meet.
    """
    mixed = F.pmod(F.col(key) * F.lit(2654435761) + seed, F.lit(1 << 32))
    return rows.withColumn("draw", F.row_number().over(Window.partitionBy(by).orderBy(mixed, key))).filter(F.col("draw") <= n)
