"""Queries that fit models to groups of points, on encoded clouds and stores, and on streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.geometry import XYZ
from terrafold.operators import clusters as cl
from terrafold.operators import planes as pl
from terrafold.operators import registration as rg
from terrafold.operators import timeseries as ts
from terrafold.plans.registry import PTS, query, r6, rounded
from terrafold.session import cut, scratch_path
from terrafold.sources import bag, cloud
from terrafold.sources.tables import points, stamps
from terrafold.streaming import maps

_PLANE = {"threshold": 0.4, "max_angle": 45.0, "min_inliers": 5}


@query()
def ransac_plane(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pl.planes(points(spark, d), **_PLANE), "nx", "ny", "nz", "d", "rms")


@query()
def ransac_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds over seeds: share of inliers, residual and tilt of the planes found, and how far apart the seeds lead. All are one fit."""
    value = lambda v: F.explode(F.array(*[F.lit(x) for x in v]))
    p = points(spark, d).select("frame", *XYZ, value((0.2, 0.4, 0.8)).alias("threshold")).withColumn("seed", value((0, 1, 2)))
    by = ("frame", "threshold", "seed")
    found = pl.planes(p, by, threshold="threshold", seed="seed", max_angle=45.0, min_inliers=5).join(p.groupBy(*by).agg(F.count("*").alias("n")), list(by))
    spread = pl.normal_spread(found, ("frame", "threshold")).groupBy("threshold").agg(F.avg("spread").alias("spread"))
    out = found.groupBy("threshold").agg(F.avg(F.col("inliers") / F.col("n")).alias("inlier_share"), F.avg("rms").alias("rms"), F.avg(F.degrees(F.acos(F.least(F.abs("nz"), F.lit(1.0))))).alias("tilt"))
    return rounded(out.join(spread, "threshold"), "inlier_share", "rms", "tilt", "spread", digits=4)


@query()
def ground_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pl.ground_by_plane(points(spark, d), **_PLANE).select("pid", "frame", "height", "ground", "status"), "height")


@query()
def grid_ground(spark: SparkSession, d: str) -> DataFrame:
    g = pl.ground_by_grid(points(spark, d), cell=2.0, min_points=6, threshold=0.4, max_tilt=45.0, max_offset=1.0, base={"max_angle": 45.0, "min_inliers": 5})
    return rounded(g.select("pid", "frame", "height", "ground", "cell_status"), "height")


@query()
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """How many cells of each frame have a plane of their own, and why others have none."""
    return pl.cell_counts(pl.ground_by_grid(points(spark, d), cell=2.0, min_points=6, threshold=0.4, max_tilt=45.0, max_offset=1.0, base={"max_angle": 45.0, "min_inliers": 5}))


@query()
def ground_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pl.ground_statistics(pl.ground_by_plane(points(spark, d), **_PLANE)), "slope", "sensor_height", "rms", "roughness")


@query()
def ground_bands(spark: SparkSession, d: str) -> DataFrame:
    """Share of ground in bands of distance, by one plane and by a grid of them."""
    p, edges = points(spark, d), [0.0, 1.0, 2.0, 4.0]
    ways = {"plane": pl.ground_by_plane(p, **_PLANE), "grid": pl.ground_by_grid(p, cell=2.0, min_points=6, threshold=0.4, max_tilt=45.0, max_offset=1.0, base={"max_angle": 45.0, "min_inliers": 5})}
    out = [pl.ground_by_band(g, edges).withColumn("method", F.lit(name)) for name, g in ways.items()]
    return rounded(out[0].unionByName(out[1]), "ground_share")


@query()
def upright_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = cl.boxes(cl.clusters(points(spark, d), 0.8, 3), "upright")
    return b.select("frame", F.col("cluster_id").cast("long").alias("cluster_id"), *[r6(F.col("center")[i]).alias(f"c{c}") for i, c in enumerate(XYZ)], r6(F.col("volume")).alias("volume"))


@query()
def box_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean volume of three kinds of boxes around the same clusters, and its ratio to that of the upright ones."""
    c = cut(cl.clusters(points(spark, d), 0.8, 4).select("frame", "cluster_id", *XYZ))
    out = None
    for kind in ("axis", "upright", "pca"):
        one = cl.boxes(c, kind).groupBy().agg(F.lit(kind).alias("kind"), F.avg("volume").alias("mean_volume"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    figures = cut(out)
    upright = figures.filter("kind = 'upright'").select(F.col("mean_volume").alias("u"))
    return rounded(figures.join(F.broadcast(upright)).select("kind", "mean_volume", "n", F.try_divide("mean_volume", "u").alias("ratio")), "mean_volume", "ratio")


def _moved(spark: SparkSession, d: str, method: str) -> DataFrame:
    """All points against themselves moved a little: what the motion found says."""
    p = points(spark, d).select("pid", *XYZ)
    t = rg.small_motion(np.array([0.01, -0.02, 0.015, 0.05, -0.03, 0.02]))
    target = rg.transformed(p, t)
    if method == "point_to_plane":
        target = rg.with_normals(target)
    found = rg.icp(p, target, 0.4, 8, method=method)
    gap = float(np.abs(found["transform"] - t).max())
    row = (method, int(found["correspondences"]), round(float(found["inlier_rmse"]), 6), gap < 0.02, *(round(v, 4) for v in rg.motion_metrics(found["transform"]).values()))
    return spark.createDataFrame([row], "method string, correspondences long, inlier_rmse double, recovered boolean, translation_m double, rotation_deg double")


@query()
def icp_point_to_point(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d, "point_to_point")


@query()
def icp_point_to_plane(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d, "point_to_plane")


_FIELDS = [{"name": n, "offset": o, "datatype": t, "count": 1} for n, o, t in (("x", 0, 8), ("y", 8, 8), ("z", 16, 8), ("intensity", 24, 7), ("class_id", 28, 5), ("pid", 32, 6))]


@query(f"WITH {PTS} SELECT frame, x, y, z, round(intensity, 5) AS intensity, class_id, pid FROM pts")
def cloud_round_trip(spark: SparkSession, d: str) -> DataFrame:
    encoded = cloud.encode_clouds(points(spark, d), _FIELDS, 48)
    return rounded(cloud.decode_clouds(encoded, _FIELDS, 48).drop("point_idx").withColumn("intensity", F.col("intensity").cast("double")), "intensity", digits=5)


@query(f"WITH {PTS} SELECT pid, frame, x FROM pts WHERE frame IN (SELECT DISTINCT frame FROM pts ORDER BY frame LIMIT 3)")
def frame_store(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "frames")
    cloud.write_frames(points(spark, d), path)
    return cloud.read_frames(spark, path, 3).select("pid", F.col("frame").cast("long").alias("frame"), "x")


@query("SELECT DISTINCT user_id, event_type AS topic FROM events")
def streaming_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = maps.arriving(spark, d, "events").select("user_id", F.col("event_type").alias("topic")).dropDuplicates(["user_id", "topic"])
    return maps.collected(s).select("user_id", "topic")


@query("SELECT event_type AS topic, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    s = maps.arriving(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("topic"), "value")
    w = s.groupBy("topic", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = maps.snapshot(w).select("topic", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(w.start AS timestamp_ntz))").alias("day_us"), "n", "total")
    return rounded(out, "total", digits=4)


@query()
def frame_registration(spark: SparkSession, d: str) -> DataFrame:
    """Each frame taken onto the one before it."""
    found = rg.register_frames(points(spark, d), 0.8, 8)
    return rounded(found.select("previous", "current", "n", "rmse", "shift", "turn"), "rmse", "shift", "turn", digits=4)


_SHIFT, _TURN = (0.04, -0.03, 0.02), 0.01


@query(f"""WITH f AS (SELECT range AS f, range * {_TURN} AS a, range * {_SHIFT[0]} AS x, range * {_SHIFT[1]} AS y, range * {_SHIFT[2]} AS z FROM range(4)),
m AS (SELECT p.f AS previous, c.f AS current, p.x - cos(-{_TURN}) * c.x + sin(-{_TURN}) * c.y AS tx, p.y - sin(-{_TURN}) * c.x - cos(-{_TURN}) * c.y AS ty, p.z - c.z AS tz FROM f p JOIN f c ON c.f = p.f + 1)
SELECT method, previous, current, round(sqrt(tx * tx + ty * ty + tz * tz), 3) AS shift, round(degrees({_TURN}), 2) AS turn FROM m, (VALUES ('point_to_point'), ('point_to_plane')) v(method)""")
def registered_motions(spark: SparkSession, d: str) -> DataFrame:
    """Frames that are one scene moved on and turned step by step: the motions found between all of them at once, by both methods."""
    f, a = F.col("frame"), F.col("frame") * _TURN
    p = points(spark, d).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("frame"), "pid", *XYZ)
    p = p.select((F.col("pid") * 4 + f).alias("pid"), "frame", (F.cos(a) * F.col("x") - F.sin(a) * F.col("y") + f * _SHIFT[0]).alias("x"), (F.sin(a) * F.col("x") + F.cos(a) * F.col("y") + f * _SHIFT[1]).alias("y"), (F.col("z") + f * _SHIFT[2]).alias("z"))
    found = [rg.register_frames(p, 0.3, 15, 1e-9, method=m).withColumn("method", F.lit(m)) for m in ("point_to_point", "point_to_plane")]
    return rounded(rounded(found[0].unionByName(found[1]).select("method", "previous", "current", "shift", "turn"), "shift", digits=3), "turn", digits=2)


@query(f"""WITH e AS (SELECT event_id AS id, event_type AS topic, epoch_us(ts) AS h, epoch_us(ts) + event_id % 7 * 1000 AS b FROM events),
s AS (SELECT *, (h - lag(h) OVER w) / 1e6 AS dh, (b - lag(b) OVER w) / 1e6 AS db FROM e WINDOW w AS (PARTITION BY topic ORDER BY id))
SELECT topic, 'event' AS type, count(*) AS n, round(quantile_cont(dh, 0.5) FILTER (dh > 0), 6) AS header_step, round(quantile_cont(db, 0.5) FILTER (db > 0), 6) AS bag_step, count(*) FILTER (dh <= 0) AS steps_back, round(avg(b - h), 3) AS delay_mean, max(b - h) AS delay_max FROM s GROUP BY topic
UNION ALL SELECT 'unused', 'event', 0, NULL, NULL, NULL, NULL, NULL""")
def inspect_bag(spark: SparkSession, d: str) -> DataFrame:
    """A bag recorded from the events, read back: its topics, the steps of header and bag stamps, and how long after its header a message was received."""
    e = stamps(spark, d).select(F.col("seq").alias("id"), "topic", "stamp_us", (F.col("stamp_us") + F.col("seq") % 7 * 1000).alias("timestamp"))
    path = scratch_path(spark, "bag")
    bag.register(spark)
    known = e.select("topic").distinct().unionByName(spark.createDataFrame([("unused",)], "topic string")).withColumn("type", F.lit("event"))
    bag.write_bags(e.withColumn("data", cloud.header_bytes(F.col("stamp_us"))), known, path, 4)
    m = spark.read.format("bag").load(path).select("id", "topic", F.col("timestamp").alias("bag_us"), cloud.header_stamp_ns().alias("ns"))
    m = cut(m.select("id", "topic", "bag_us", F.expr("ns div 1000").alias("header_us")))
    header, received = (ts.stamp_statistics(m, "topic", c, "id") for c in ("header_us", "bag_us"))
    delay = ts.offset_statistics(m.withColumn("delay", F.col("bag_us") - F.col("header_us")), "topic", "delay")
    out = bag.topics(spark, path).join(header.select("topic", F.col("median_dt").alias("header_step"), F.col("non_monotonic").alias("steps_back")), "topic", "left")
    out = out.join(received.select("topic", F.col("median_dt").alias("bag_step")), "topic", "left").join(delay.select("topic", F.col("mean").alias("delay_mean"), F.col("max_abs").cast("long").alias("delay_max")), "topic", "left")
    return rounded(rounded(out.select("topic", "type", "n", "header_step", "bag_step", "steps_back", "delay_mean", "delay_max"), "header_step", "bag_step"), "delay_mean", digits=3)
