"""Whole pipelines, sweeps over clusters, and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.geometry import XYZ
from terrafold.operators import clusters as cl
from terrafold.operators import neighbors as nb
from terrafold.operators import planes as pl
from terrafold.operators import filters as sm
from terrafold.operators import timeseries as ts
from terrafold.plans import lidar
from terrafold.plans.map_queries import _MATRIX, _POSE, detections, observations, poses
from terrafold.plans.point_queries import _COMPONENTS, _KEYS, _REMOVED, _STAGES
from terrafold.plans.registry import PTS, RAW, ST, query, rounded
from terrafold.session import cut
from terrafold.sources import cloud
from terrafold.sources.tables import bulk_points, points, raw_points, stamps, table
from terrafold.streaming import maps


PIPELINE = f"""WITH {RAW}, m AS (SELECT *, {_REMOVED} AS r FROM fin), k AS (SELECT frame, r, {_KEYS.format(s=1.0)} FROM m),
v AS (SELECT frame, count(DISTINCT (ix, iy, iz)) AS voxelized FROM k WHERE r IS NULL GROUP BY frame)
SELECT k.frame, count(*) AS input, count(*) FILTER (r = 'nonfinite') AS removed_nonfinite, count(*) FILTER (r = 'zero') AS removed_zero, count(*) FILTER (r = 'range') AS removed_range,
 count(*) FILTER (r = 'crop') AS removed_crop, count(*) FILTER (r IS NULL) AS filtered, COALESCE(any_value(voxelized), 0) AS voxelized FROM k LEFT JOIN v ON k.frame = v.frame GROUP BY k.frame"""


@query(PIPELINE)
def scan_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return lidar.run_scan(raw_points(spark, d), lidar.ScanConfig(range=(0.5, 3.0), crop=_STAGES["crop"], voxel=1.0, averages=()))["stats"]


@query(f"""WITH s AS (SELECT frame, input, filtered, voxelized FROM ({PIPELINE})) SELECT count(*) AS frames, round(avg(input), 6) AS input, round(avg(filtered), 6) AS filtered, round(avg(voxelized), 6) AS voxelized,
 round(avg(CASE WHEN voxelized > 0 THEN voxelized ELSE filtered END / input), 6) AS ratio FROM s""")
def scan_means(spark: SparkSession, d: str) -> DataFrame:
    """What the scan pipeline leaves of a frame, in the mean."""
    s = lidar.reduction(scan_pipeline(spark, d))
    return rounded(s.agg(F.count("*").alias("frames"), *[F.avg(c).alias(c) for c in ("input", "filtered", "voxelized", "ratio")]), "input", "filtered", "voxelized", "ratio")


@query()
def geometry_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Ground by plane, normals, clusters of the rest with their descriptors and mean local shape, a row of figures for each frame."""
    ground = pl.ground_by_plane(points(spark, d), threshold=0.4, max_angle=45.0, min_inliers=5)
    rest = ground.filter("NOT ground").select("pid", "frame", *XYZ, "height")
    rest = cut(cl.normals(rest, 10).select("pid", "frame", *XYZ, "height", *cl.LOCAL))
    found = cl.descriptors(cl.clusters(rest, 0.8, 2), "height", min_height=0.0)
    per = found.groupBy("frame").agg(F.count("*").alias("clusters"), F.sum("n").alias("clustered"), F.max("h_max").alias("highest"), F.count_if(F.col("shape") == "linear").alias("linear"), F.avg("mean_curvature").alias("curvature"))
    out = pl.ground_statistics(ground).select("frame", "n", "ground_n", "slope").join(per, "frame", "left").fillna(0, ["clusters", "clustered", "linear"])
    return rounded(out, "slope", "highest", "curvature")


def _sweep_sql(tolerance: float) -> str:
    c = _COMPONENTS.replace("RECURSIVE ", "").replace("<= 0.64", f"<= {tolerance * tolerance!r}")
    return f"""(WITH RECURSIVE {c}, z AS (SELECT frame, size FROM s WHERE size >= 2)
SELECT {tolerance!r}::DOUBLE AS tolerance, (SELECT count(*) FROM z) AS clusters, (SELECT max(size) FROM z) AS largest, (SELECT quantile_cont(size, 0.5) FROM z) AS median,
 round((SELECT sum(size) FROM z) / (SELECT count(*) FROM pts), 6) AS clustered_share, (SELECT count(*) FROM s WHERE size < 2) AS rejected, (SELECT count(*) FROM e WHERE a < b) AS pairs)"""


@query(" UNION ALL ".join(f"SELECT * FROM {_sweep_sql(t)}" for t in (0.5, 0.8)))
def cluster_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How the tolerance changes the clusters of two points or more."""
    p, rows = points(spark, d), None
    figures = ("clusters", "largest", "median", "inside", "pairs", "total", "rejected")
    for t in (0.5, 0.8):
        every = cut(cl.clusters(p, t, 2).groupBy("frame", "component").agg(F.count("*").alias("size"), F.max("cluster_id").alias("cluster_id")))
        sizes = every.filter("cluster_id >= 0")
        found = [
            sizes.agg(F.count("*").alias("clusters"), F.max("size").alias("largest"), F.percentile("size", F.lit(0.5)).alias("median"), F.sum("size").alias("inside")),
            nb.radius_pairs(p, t).agg(F.count("*").alias("pairs")), p.agg(F.count("*").alias("total")), every.filter("cluster_id < 0").agg(F.count("*").alias("rejected")),
        ]
        for part in found:
            part = part.withColumn("tolerance", F.lit(t))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    out = rows.groupBy("tolerance").agg(*[F.max(c).alias(c) for c in figures])
    out = out.select("tolerance", "clusters", "largest", "median", (F.col("inside").cast("double") / F.col("total")).alias("clustered_share"), "rejected", "pairs")
    return rounded(out, "clustered_share")


@query(f"""WITH {_COMPONENTS}, h AS (SELECT frame, cluster_id, count(*) AS n, max(z) AS h_max FROM clu WHERE cluster_id >= 0 GROUP BY frame, cluster_id)
SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY cluster_id) - 1 AS cluster_id, n, h_max FROM h WHERE h_max >= 0.5""")
def tall_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = cl.descriptors(cl.clusters(points(spark, d), 0.8, 2), min_height=0.5)
    return out.select("frame", F.col("cluster_id").cast("long").alias("cluster_id"), "n", "h_max")


@query("SELECT o_custkey AS image_id, o_orderkey AS det_idx, (o_orderkey * 13 % 8) * 193 % 256 AS r0, ((o_orderkey * 13 % 8) * 193 + 37) % 256 AS r, ((o_orderkey * 13 % 8) * 97 + 113) % 256 AS g, ((o_orderkey * 13 % 8) * 53 + 71) % 256 AS b FROM orders")
def class_colors(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("image_id", "det_idx", (F.col("class_id").cast("long") * 193 % 256).alias("r0"), *[c.alias(n) for n, c in g.class_color(F.col("class_id")).items()])


@query(f"WITH {ST}, n AS (SELECT seq, topic, row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS i FROM st) SELECT seq, topic, i % 5 = 0 AS quality, i % 20 = 0 AND i < 200 AS saved FROM n WHERE i % 5 = 0")
def sampling_stride(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth message is judged; every twentieth is saved too, ten of a topic at most."""
    s = ts.every_nth(stamps(spark, d), 5, "topic", "seq").withColumn("i", F.col("received") - 1)
    return s.select("seq", "topic", (F.col("i") % 5 == 0).alias("quality"), ((F.col("i") % 20 == 0) & (F.col("i") < 200)).alias("saved"))


@query("SELECT frame, n FROM (SELECT l_suppkey AS frame, count(*) AS n FROM lineitem GROUP BY l_suppkey) WHERE n >= 590")
def frame_guard(spark: SparkSession, d: str) -> DataFrame:
    """Frames that have points enough to be registered."""
    return bulk_points(spark, d).groupBy("frame").agg(F.count("*").alias("n")).filter("n >= 590")


@query("SELECT DISTINCT CAST(floor(l_quantity / 5.0) AS BIGINT) AS ix, CAST(floor(l_extendedprice / 2500 / 5.0) AS BIGINT) AS iy, CAST(floor((l_discount + l_tax) * 10 / 5.0) AS BIGINT) AS iz FROM lineitem ORDER BY ix, iy, iz LIMIT 25")
def published_voxels(spark: SparkSession, d: str) -> DataFrame:
    """The first voxels by key, as many as are published."""
    return observations(spark, d).select(*g.voxel_keys(5.0)).distinct().orderBy("ix", "iy", "iz").limit(25)


@query(f"WITH {PTS} SELECT pid, round(x * 0.48 + y * 0.6 + z * 0.64 - 0.25, 6) + 0.0 AS height, round(degrees(acos(least(abs(z) / nullif(sqrt(x * x + y * y + z * z), 0), 1.0))), 4) AS tilt FROM pts")
def plane_heights(spark: SparkSession, d: str) -> DataFrame:
    """Distance to a fixed plane, and the angle between each point's direction and the vertical."""
    up = F.try_divide(F.abs("z"), g.norm())
    return rounded(rounded(points(spark, d).select("pid", g.plane_distance((0.48, 0.6, 0.64, -0.25)).alias("height"), g.angle_degrees(up).alias("tilt")), "height"), "tilt", digits=4)


@query(f"""WITH {PTS}, b AS (SELECT frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM pts GROUP BY frame), n AS (SELECT unnest(range(8)) AS corner)
SELECT frame, CAST(corner AS INTEGER) AS corner, round(CASE WHEN corner % 2 = 1 THEN x1 ELSE x0 END, 6) + 0.0 AS x, round(CASE WHEN corner // 2 % 2 = 1 THEN y1 ELSE y0 END, 6) + 0.0 AS y, round(CASE WHEN corner // 4 = 1 THEN z1 ELSE z0 END, 6) + 0.0 AS z FROM b, n""")
def box_corners(spark: SparkSession, d: str) -> DataFrame:
    b = points(spark, d).groupBy("frame").agg(*[((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in XYZ], *[(F.max(c) - F.min(c)).alias(f"e{c}") for c in XYZ])
    b = b.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = g.corner([F.col(f"c{c}") for c in XYZ], [F.col(f"e{c}") for c in XYZ], F.col("corner"))
    return rounded(b.select("frame", "corner", *[a.alias(c) for a, c in zip(at, XYZ, strict=True)]), *XYZ)


@query(f"""WITH {_POSE}, s AS (SELECT e.user_id, e.event_id AS seq, epoch_us(e.ts) AS t, e.event_type AS topic, u.* EXCLUDE (event_id) FROM events e JOIN unitp u USING (event_id)),
o AS (SELECT * FROM s WHERE topic <> 'click'), r AS (SELECT user_id, seq, t FROM s WHERE topic = 'click'),
b AS (SELECT r.user_id, r.seq, r.t, o.t AS t0, o.tx AS x0, o.qx AS a0, o.qy AS b0, o.qz AS c0, o.qw AS d0 FROM r ASOF JOIN o ON r.user_id = o.user_id AND r.t >= o.t),
a AS (SELECT b.*, o.t AS t1, o.tx AS x1, o.qx AS a1, o.qy AS b1, o.qz AS c1, o.qw AS d1 FROM b ASOF JOIN o ON b.user_id = o.user_id AND b.t <= o.t),
p AS (SELECT *, COALESCE((t - t0) / nullif(t1 - t0, 0), 0.0) AS p, a0 * a1 + b0 * b1 + c0 * c1 + d0 * d1 AS d FROM a),
w AS (SELECT *, acos(least(abs(d), 1.0)) AS g, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS sg FROM p),
k AS (SELECT *, CASE WHEN g < 1e-4 THEN 1 - p ELSE sin((1 - p) * g) / sin(g) END AS wa, CASE WHEN g < 1e-4 THEN p ELSE sin(p * g) / sin(g) END * sg AS wb FROM w)
SELECT user_id, seq AS key, round(x0 + p * (x1 - x0), 5) AS tx, round(wa * a0 + wb * a1, 5) + 0.0 AS qx, round(wa * b0 + wb * b1, 5) + 0.0 AS qy, round(wa * c0 + wb * c1, 5) + 0.0 AS qz, round(wa * d0 + wb * d1, 5) + 0.0 AS qw FROM k""")
def pose_at_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Position and orientation at each click, between the other events of its user."""
    s = stamps(spark, d).join(poses(spark, d).withColumnRenamed("event_id", "seq"), "seq")
    q = ("qx", "qy", "qz", "qw")
    out = ts.interpolated_pose(s.filter("topic = 'click'"), s.filter("topic <> 'click'"), "user_id", ("tx",), q, timeout=1 << 60)
    return rounded(out.drop("stamp"), "tx", *q, digits=5)


@query(f"WITH {_POSE}, {_MATRIX} SELECT event_id, round(m00, 6) + 0.0 AS x, round(m10, 6) + 0.0 AS y, round(m20, 6) + 0.0 AS z FROM mat")
def rotated_axis(spark: SparkSession, d: str) -> DataFrame:
    """The x axis turned by each pose's quaternion, as v + 2 q x (q x v + w v)."""
    q, w = [F.col(f"q{c}") for c in XYZ], F.col("qw")
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    v = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    inner = [a + w * b for a, b in zip(cross(q, v), v, strict=True)]
    out = [a + 2 * b for a, b in zip(v, cross(q, inner), strict=True)]
    return rounded(poses(spark, d).select("event_id", *[o.alias(c) for o, c in zip(out, XYZ, strict=True)]), *XYZ)


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 * 1000000000 + epoch_us(ts) % 1000000 * 1000 AS BIGINT) AS stamp_ns FROM events")
def header_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamps read from the heads of serialized messages, the rest of which is not touched."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    head = F.concat(cloud.header_bytes(us), F.encode("props", "UTF-8"))
    return table(spark, d, "events").select("event_id", head.alias("data")).select("event_id", cloud.header_stamp_ns().alias("stamp_ns"))


@query(f"""WITH {PTS}, r AS (SELECT pid, frame, row_number() OVER (PARTITION BY frame ORDER BY (pid * 2654435761 + 12345) % 4294967296, pid) AS draw FROM pts) SELECT pid, frame, draw FROM r WHERE draw <= 20""")
def sampled_points(spark: SparkSession, d: str) -> DataFrame:
    """Twenty points of each frame, drawn without replacement: those whose mixed ids are least."""
    return sm.sample_rows(points(spark, d), 20, "frame", "pid", 12345).select("pid", "frame", F.col("draw").cast("long").alias("draw"))


@query(f"""WITH {PTS}, m AS (SELECT a.pid, b.pid AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN pts b ON a.frame = b.frame)
SELECT pid, count(*) AS n, list(other ORDER BY round(d2, 12), other) AS neighbours, round(sqrt(max(d2)), 6) AS farthest FROM m WHERE d2 <= 0.49 GROUP BY pid""")
def radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The points within a radius of each, the nearest first."""
    p = points(spark, d)
    return rounded(nb.radius_lists(p, p, 0.7), "farthest")


@query(f"""WITH {PTS}, h AS (SELECT pid, frame, round(z, 6) AS z, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (z - (SELECT quantile_cont(z, 0.02) FROM pts)) / (SELECT quantile_cont(z, 0.98) - quantile_cont(z, 0.02) FROM pts))) AS ramp FROM pts)
SELECT pid, frame, round(ramp, 6) + 0.0 AS ramp, round((class_id * 0.618033988749895::DOUBLE) % 1.0::DOUBLE, 6) AS hue FROM h JOIN (SELECT pid, class_id FROM pts) USING (pid)""")
def point_colors(spark: SparkSession, d: str) -> DataFrame:
    """Height as a ramp between the second and the 98th percentile, and a hue by class that keeps neighbours apart."""
    p = points(spark, d)
    ends = ts.quantiles(p.withColumn("all", F.lit(0)), ("all",), {"low": (F.col("z"), 0.02), "high": (F.col("z"), 0.98)}).select("low", "high")
    return rounded(p.join(F.broadcast(ends)).select("pid", "frame", g.ramp(F.col("z"), F.col("low"), F.col("high")).alias("ramp"), g.golden_hue(F.col("class_id")).alias("hue")), "ramp", "hue")
