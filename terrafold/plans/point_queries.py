"""Queries on point tables: filters, voxels, quality, neighbours, clusters, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.geometry import XYZ, all_finite, angle_degrees, dominant_shape, eigenvalues, shape_features, with_eigen
from terrafold.operators import clusters as cl
from terrafold.operators import filters as fl
from terrafold.operators import neighbors as nb
from terrafold.operators import planes as pl
from terrafold.plans import lidar
from terrafold.plans.registry import BULK, PTS, RAW, query, r6, rounded
from terrafold.session import cut
from terrafold.sources.tables import bulk_points, points, raw_points

_STAGES = {"nonfinite": True, "zero_eps": 1e-6, "range": (0.5, 3.0), "crop": ((-0.5, -0.5, -0.5), (0.5, 0.5, 0.5), True)}
_INSIDE = "(x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 AND z BETWEEN -0.5 AND 0.5)"
_REMOVED = f"CASE WHEN NOT ok THEN 'nonfinite' WHEN NOT (abs(x) > 1e-6 OR abs(y) > 1e-6 OR abs(z) > 1e-6) THEN 'zero' WHEN NOT (s BETWEEN 0.25 AND 9.0) THEN 'range' WHEN {_INSIDE} THEN 'crop' END"


@query(f"WITH {RAW} SELECT pid, frame, x, y, z FROM fin WHERE ok AND (abs(x) > 1e-6 OR abs(y) > 1e-6 OR abs(z) > 1e-6)")
def finite_zero_filter(spark: SparkSession, d: str) -> DataFrame:
    return raw_points(spark, d).filter(all_finite() & fl.nonzero()).select("pid", "frame", *XYZ)


@query(f"WITH {RAW} SELECT pid, frame, intensity FROM fin WHERE ok AND s BETWEEN 0.25 AND 9.0")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    return raw_points(spark, d).filter(all_finite() & fl.in_range(0.5, 3.0)).select("pid", "frame", "intensity")


@query(f"WITH {RAW} SELECT pid, frame, COALESCE(NOT isnan(x) AND {_INSIDE}, false) AS inside FROM raw")
def crop_box(spark: SparkSession, d: str) -> DataFrame:
    return raw_points(spark, d).select("pid", "frame", fl.in_box((-0.5,) * 3, (0.5,) * 3).alias("inside"))


@query(f"WITH {PTS} SELECT pid, frame FROM pts WHERE x * 0.6 + y * 0.0 + z * 0.8 <= 0.5")
def ground_candidates(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).filter(fl.below_height((0.6, 0.0, 0.8), 0.5)).select("pid", "frame")


@query(f"""WITH {RAW}, m AS (SELECT frame, {_REMOVED} AS r FROM fin)
SELECT frame, count(*) AS input, count(*) FILTER (r = 'nonfinite') AS removed_nonfinite, count(*) FILTER (r = 'zero') AS removed_zero,
 count(*) FILTER (r = 'range') AS removed_range, count(*) FILTER (r = 'crop') AS removed_crop, count(*) FILTER (r IS NULL) AS filtered FROM m GROUP BY frame""")
def removal_accounting(spark: SparkSession, d: str) -> DataFrame:
    stages = fl.removal_stages(_STAGES)
    return fl.removal_counts(fl.with_removed_by(raw_points(spark, d), stages), stages)


@query(f"WITH {RAW}, m AS (SELECT *, {_REMOVED} AS r FROM fin) SELECT pid, frame, CASE WHEN r IS NULL THEN x END AS x, CASE WHEN r IS NULL THEN y END AS y, CASE WHEN r IS NULL THEN z END AS z, intensity, r IS NULL AS kept FROM m")
def organized_mask(spark: SparkSession, d: str) -> DataFrame:
    return fl.organized(fl.with_removed_by(raw_points(spark, d), fl.removal_stages(_STAGES))).select("pid", "frame", *XYZ, "intensity", "kept")


@query(f"WITH {RAW}, m AS (SELECT *, {_REMOVED} AS r FROM fin) SELECT frame, bool_and(r IS NULL) AS organized_dense, count(*) FILTER (r IS NULL) AS filtered_width, bool_and(r IS NOT NULL OR ok) AS filtered_dense FROM m GROUP BY frame")
def frame_density(spark: SparkSession, d: str) -> DataFrame:
    return fl.frame_density(fl.with_removed_by(raw_points(spark, d), fl.removal_stages(_STAGES)))


_KEYS = "CAST(floor(x / {s}) AS BIGINT) AS ix, CAST(floor(y / {s}) AS BIGINT) AS iy, CAST(floor(z / {s}) AS BIGINT) AS iz"


@query(f"""WITH {RAW}, v AS (SELECT frame, {_KEYS.format(s=1.0)}, x, y, z, intensity FROM fin WHERE ok AND s BETWEEN 0.25 AND 9.0)
SELECT frame, ix, iy, iz, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, round(avg(intensity), 6) AS intensity, count(*) AS point_count FROM v GROUP BY ALL""")
def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    config = lidar.ScanConfig(zero_eps=None, range=(0.5, 3.0), voxel=1.0)
    return rounded(lidar.run_scan(raw_points(spark, d), config)["voxelized"], *XYZ, "intensity")


@query(f"WITH {PTS}, v AS (SELECT {_KEYS.format(s=1.0)}, x FROM pts) SELECT ix, iy, iz, round(avg(x), 6) + 0.0 AS x, count(*) AS point_count FROM v GROUP BY ix, iy, iz HAVING count(*) >= 3")
def voxel_min_points(spark: SparkSession, d: str) -> DataFrame:
    v = fl.voxel_grid(points(spark, d), 1.0, min_points=3, by=())
    return rounded(v.select("ix", "iy", "iz", "x", "point_count"), "x")


@query(f"""WITH {PTS}, k AS (SELECT pid, frame, {_KEYS.format(s=1.0)} FROM pts), c AS (SELECT frame, ix, iy, iz, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ix, iy, iz) - 1 AS voxel FROM c)
SELECT pid, frame, COALESCE(voxel, -1) AS voxel FROM k LEFT JOIN r USING (frame, ix, iy, iz)""")
def voxel_point_map(spark: SparkSession, d: str) -> DataFrame:
    return fl.point_to_voxel(points(spark, d), 1.0, 2).select("pid", "frame", F.col("voxel").cast("long").alias("voxel"))


@query(f"WITH {BULK}, v AS (SELECT frame, {_KEYS.format(s=5.0)}, intensity FROM bulk) SELECT frame, ix, iy, iz, round(avg(intensity), 6) AS intensity, count(*) AS point_count FROM v GROUP BY ALL")
def bulk_voxel_stats(spark: SparkSession, d: str) -> DataFrame:
    v = fl.voxel_grid(bulk_points(spark, d), 5.0, ("intensity",))
    return rounded(v.select("frame", "ix", "iy", "iz", "intensity", "point_count"), "intensity")


_QUALITY = f"""{RAW}, g AS (SELECT *, ok AND (abs(x) > 1e-6 OR abs(y) > 1e-6 OR abs(z) > 1e-6) AS good, sqrt(s) AS r FROM fin),
q AS (SELECT frame, count(*) AS n, count(*) FILTER (NOT ok) AS nonfinite, count(*) FILTER (ok AND NOT good) AS zero, count(*) FILTER (good) AS valid,
 round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 6) AS valid_share, round(min(r) FILTER (good), 6) AS range_min, round(quantile_cont(r, 0.5) FILTER (good), 6) AS range_median,
 round(quantile_cont(r, 0.99) FILTER (good), 6) AS range_p99, round(max(r) FILTER (good), 6) AS range_max, count(DISTINCT class_id) AS rings, max(pid) - min(pid) AS t_span FROM g GROUP BY frame)"""
_RANGES = ("valid_share", "range_min", "range_median", "range_p99", "range_max")


@query(f"WITH {_QUALITY} SELECT * FROM q")
def cloud_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lidar.cloud_quality(raw_points(spark, d), ring="class_id", time="pid"), *_RANGES)


@query(f"WITH {_QUALITY}, u AS (SELECT metric, v FROM (SELECT CAST(valid AS DOUBLE) AS valid, valid_share, range_max FROM q) UNPIVOT (v FOR metric IN (valid, valid_share, range_max))) SELECT metric, round(avg(v), 5) AS mean, round(min(v), 5) AS min, round(max(v), 5) AS max FROM u GROUP BY metric")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lidar.quality_summary(cloud_quality(spark, d), ["valid", "valid_share", "range_max"]), "mean", "min", "max", digits=5)


@query(f"""WITH {RAW}, t(max_range) AS (VALUES (1.0::DOUBLE), (2.0), (3.0), (5.0)), n AS (SELECT count(*) AS n, count(DISTINCT frame) AS f FROM raw)
SELECT max_range, count(*) AS kept, round(count(*) / any_value(f), 6) AS mean_kept, round(count(*) / any_value(n), 6) AS share
FROM fin, t, n WHERE ok AND s >= 0.25 AND s <= max_range * max_range GROUP BY max_range""")
def range_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lidar.range_sweep(raw_points(spark, d), 0.5, [1.0, 2.0, 3.0, 5.0]), "mean_kept", "share")


@query(f"WITH {RAW}, b AS (SELECT CASE WHEN sqrt(s) = 5.0 THEN 9 ELSE CAST(floor(sqrt(s) / 0.5) AS INTEGER) END AS bin FROM fin WHERE ok) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin")
def range_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lidar.range_histogram(raw_points(spark, d), 0.5, 10)


@query(f"""WITH {PTS}, t(size) AS (VALUES (0.5::DOUBLE), (1.0), (2.0)), k AS (SELECT size, frame, x, y, z, floor(x / size) AS ix, floor(y / size) AS iy, floor(z / size) AS iz FROM pts, t),
v AS (SELECT size, frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM k GROUP BY size, frame, ix, iy, iz),
e AS (SELECT size, pid, min(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) AS e FROM pts JOIN v USING (frame) GROUP BY size, pid),
c AS (SELECT size, count(*) AS voxels FROM v GROUP BY size), m AS (SELECT size, avg(e) AS error_mean, quantile_cont(e, 0.95) AS error_p95 FROM e GROUP BY size)
SELECT size, voxels, round(error_mean, 6) AS error_mean, round(error_p95, 6) AS error_p95, round(voxels / (SELECT count(*) FROM pts), 6) AS reduction FROM c JOIN m USING (size)""")
def voxel_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lidar.voxel_sweep(points(spark, d), [0.5, 1.0, 2.0]), "error_mean", "error_p95", "reduction")


@query(f"""WITH {RAW}, k AS (SELECT frame, {_KEYS.format(s=1.0)}, {_REMOVED} AS r FROM fin), v AS (SELECT frame, count(DISTINCT (ix, iy, iz)) AS voxelized FROM k WHERE r IS NULL GROUP BY frame)
SELECT k.frame, round(CASE WHEN COALESCE(any_value(voxelized), 0) > 0 THEN any_value(voxelized) ELSE count(*) FILTER (r IS NULL) END / count(*), 6) AS ratio FROM k LEFT JOIN v ON k.frame = v.frame GROUP BY k.frame""")
def reduction_ratio(spark: SparkSession, d: str) -> DataFrame:
    config = lidar.ScanConfig(range=(0.5, 3.0), crop=_STAGES["crop"], voxel=1.0, averages=())
    return rounded(lidar.reduction(lidar.run_scan(raw_points(spark, d), config)["stats"]).select("frame", "ratio"), "ratio")


_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"WITH {PTS} SELECT a.pid, count(*) AS n FROM pts a JOIN pts b ON a.frame = b.frame AND {_D2} <= 0.25 GROUP BY a.pid")
def radius_count(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return nb.radius_count(p, p, 0.5)


@query(f"WITH {PTS} SELECT a.frame, a.pid AS a, b.pid AS b, round(sqrt({_D2}), 6) AS distance FROM pts a JOIN pts b ON a.frame = b.frame AND a.pid < b.pid AND {_D2} <= 0.36")
def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nb.radius_pairs(points(spark, d), 0.6), "distance")


@query(f"WITH {PTS} SELECT a.pid, a.frame, count(*) >= 2 AS kept FROM pts a JOIN pts b ON a.frame = b.frame AND {_D2} <= 0.49 GROUP BY a.pid, a.frame")
def radius_outlier(spark: SparkSession, d: str) -> DataFrame:
    return nb.radius_outliers(points(spark, d), 0.7, 2).select("pid", "frame", "kept")


_KNN = f"""{PTS}, nn AS (SELECT a.pid AS q, b.pid AS p, sqrt({_D2}) AS distance, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS rank, a.frame FROM pts a JOIN pts b ON a.frame = b.frame)"""
_KNN_OTHERS = _KNN.replace("b ON a.frame = b.frame)", "b ON a.frame = b.frame AND a.pid <> b.pid)")


@query(f"WITH {_KNN} SELECT q, p, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM nn WHERE rank <= 5")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(nb.knn(p, p, 5), "distance")


@query(f"""WITH {_KNN_OTHERS}, m AS (SELECT q, frame, avg(distance) AS m FROM nn WHERE rank <= 8 GROUP BY q, frame), l AS (SELECT frame, avg(m) + 1.5 * stddev_pop(m) AS most FROM m GROUP BY frame)
SELECT q AS pid, m.frame, round(m, 6) AS mean_distance, m <= most AS kept FROM m JOIN l ON m.frame = l.frame""")
def statistical_outlier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nb.statistical_outliers(points(spark, d), 8, 1.5).select("pid", "frame", "mean_distance", "kept"), "mean_distance")


@query(f"""WITH {PTS}, c AS (SELECT frame, floor(x) AS ix, floor(y) AS iy, floor(z) AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY frame, floor(x), floor(y), floor(z))
SELECT a.pid, round(min(sqrt({_D2})), 6) AS error FROM pts a JOIN c b ON a.frame = b.frame GROUP BY a.pid""")
def chamfer_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lidar.centroid_error(points(spark, d), 1.0), "error")


@query(f"""WITH {_KNN_OTHERS}, r AS (SELECT pid, frame, sqrt(x * x + y * y + z * z) AS r FROM pts),
m AS (SELECT q, frame, avg(distance) AS m FROM nn WHERE rank <= 8 GROUP BY q, frame), l AS (SELECT frame, avg(m) + 1.5 * stddev_pop(m) AS most FROM m GROUP BY frame),
c AS (SELECT 'statistical' AS method, q AS pid, m <= most AS kept FROM m JOIN l ON m.frame = l.frame UNION ALL
 SELECT 'radius', a.pid, count(*) >= 2 FROM pts a JOIN pts b ON a.frame = b.frame AND {_D2} <= 0.49 GROUP BY a.pid)
SELECT method, count(*) FILTER (NOT kept) AS removed, round(avg(CASE WHEN kept THEN 0.0 ELSE 1.0 END), 6) AS removed_share,
 round(quantile_cont(r, 0.5) FILTER (NOT kept), 6) AS median_removed, round(quantile_cont(r, 0.5) FILTER (kept), 6) AS median_kept FROM c JOIN r USING (pid) GROUP BY method""")
def outlier_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    found = lidar.outlier_comparison(p, {"statistical": nb.statistical_outliers(p, 8, 1.5), "radius": nb.radius_outliers(p, 0.7, 2)})
    return rounded(found, "removed_share", "median_removed", "median_kept")


_COMPONENTS = f"""RECURSIVE {PTS}, e AS (SELECT a.pid AS a, b.pid AS b FROM pts a JOIN pts b ON a.frame = b.frame AND {_D2} <= 0.64),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS pid, min(b) AS component FROM reach GROUP BY a), s AS (SELECT frame, component, count(*) AS size FROM comp JOIN pts USING (pid) GROUP BY ALL),
ranked AS (SELECT frame, component, row_number() OVER (PARTITION BY frame ORDER BY size DESC, component) - 1 AS cluster_id FROM s WHERE size >= 2),
clu AS (SELECT pts.*, comp.component, s.size, COALESCE(ranked.cluster_id, -1) AS cluster_id FROM pts JOIN comp USING (pid) JOIN s USING (frame, component) LEFT JOIN ranked USING (frame, component))"""


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return cl.clusters(points(spark, d), 0.8, 2)


@query(f"WITH {_COMPONENTS} SELECT pid, frame, component, size, cluster_id FROM clu")
def euclidean_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d).select("pid", "frame", "component", "size", F.col("cluster_id").cast("long").alias("cluster_id"))


@query(f"WITH {_COMPONENTS} SELECT frame, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters, max(size) AS largest, count(*) FILTER (cluster_id < 0) AS rejected FROM clu GROUP BY frame")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))
    return _clustered(spark, d).groupBy("frame").agg(F.countDistinct(known).alias("clusters"), F.max("size").alias("largest"), F.count_if(F.col("cluster_id") < 0).alias("rejected"))


@query(f"""WITH {_COMPONENTS} SELECT frame, cluster_id, count(*) AS n, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz,
 min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, min(z) AS h_min, max(z) AS h_max FROM clu WHERE cluster_id >= 0 GROUP BY frame, cluster_id""")
def cluster_descriptor(spark: SparkSession, d: str) -> DataFrame:
    out = cl.descriptors(_clustered(spark, d)).drop("curvature", "linearity", "planarity", "scattering", "shape")
    return rounded(out.withColumn("cluster_id", F.col("cluster_id").cast("long")), "cx", "cy", "cz")


@query(f"""WITH {_COMPONENTS} SELECT frame, cluster_id, round((min(x) + max(x)) / 2, 6) + 0.0 AS cx, round(max(x) - min(x), 6) AS ex, round(max(y) - min(y), 6) AS ey, round(max(z) - min(z), 6) AS ez,
 round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 6) AS volume FROM clu WHERE cluster_id >= 0 GROUP BY frame, cluster_id""")
def aabb_boxes(spark: SparkSession, d: str) -> DataFrame:
    span = {c: F.max(c) - F.min(c) for c in XYZ}
    out = _clustered(spark, d).filter("cluster_id >= 0").groupBy("frame", F.col("cluster_id").cast("long").alias("cluster_id"))
    out = out.agg(((F.min("x") + F.max("x")) / 2).alias("cx"), *[s.alias(f"e{c}") for c, s in span.items()], (span["x"] * span["y"] * span["z"]).alias("volume"))
    return rounded(out, "cx", "ex", "ey", "ez", "volume")


_MOMENTS = f"""{_KNN}, mo AS (SELECT q, count(*) AS n, covar_pop(b.x, b.x) AS xx, covar_pop(b.x, b.y) AS xy, covar_pop(b.x, b.z) AS xz, covar_pop(b.y, b.y) AS yy, covar_pop(b.y, b.z) AS yz, covar_pop(b.z, b.z) AS zz
 FROM nn JOIN pts b ON nn.p = b.pid WHERE rank <= 10 GROUP BY q)"""
_EIGEN = _MOMENTS + """, e1 AS (SELECT *, (xx + yy + zz) / 3 AS m, xy * xy + xz * xz + yz * yz AS o FROM mo),
e2 AS (SELECT *, sqrt(greatest(((xx - m) ** 2 + (yy - m) ** 2 + (zz - m) ** 2 + 2 * o) / 6, 0)) AS p,
 (xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz) AS det FROM e1),
e3 AS (SELECT *, acos(least(greatest(det / (2 * p * p * p), -1.0), 1.0)) / 3 AS phi FROM e2),
e4 AS (SELECT *, m + 2 * p * cos(phi) AS l2, m + 2 * p * cos(phi + 2 * pi() / 3) AS l0 FROM e3), e5 AS (SELECT *, 3 * m - l2 - l0 AS l1 FROM e4)"""


def _moments(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return cl.neighborhood_moments(p, p, 10)


@query(f"WITH {_MOMENTS} SELECT q, n, round(xx, 6) AS xx, round(xy, 6) + 0.0 AS xy, round(xz, 6) + 0.0 AS xz, round(yy, 6) AS yy, round(yz, 6) + 0.0 AS yz, round(zz, 6) AS zz FROM mo")
def knn_covariance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_moments(spark, d), *cl.MOMENTS)


@query(f"""WITH {_EIGEN} SELECT q, round(l0, 5) + 0.0 AS l0, round(l1, 5) AS l1, round(l2, 5) AS l2, round(l0 / (l0 + l1 + l2), 4) AS curvature, round((l2 - l1) / l2, 4) AS linearity, round((l1 - l0) / l2, 4) AS planarity,
 round(l0 / l2, 4) AS scattering, CASE WHEN l2 - l1 >= l1 - l0 AND l2 - l1 >= l0 THEN 'linear' WHEN l1 - l0 >= l0 THEN 'planar' ELSE 'scattered' END AS shape FROM e5""")
def eigen_features(spark: SparkSession, d: str) -> DataFrame:
    values = eigenvalues(cl.as_matrix())
    out = _moments(spark, d).select("q", *[v.alias(f"l{i}") for i, v in enumerate(values)])
    out = out.withColumns(shape_features([F.col(f"l{i}") for i in range(3)]))
    out = out.withColumn("shape", dominant_shape(F.col("linearity"), F.col("planarity"), F.col("scattering")))
    return rounded(rounded(out, "l0", "l1", "l2", digits=5), "curvature", "linearity", "planarity", "scattering", digits=4)


@query()
def point_normals(spark: SparkSession, d: str) -> DataFrame:
    out = cl.normals(points(spark, d), 10)
    return out.select("pid", "frame", *[r6(F.col(f"n{c}")).alias(f"n{c}") for c in XYZ], r6(F.col("curvature")).alias("curvature"), r6(F.col("verticality")).alias("verticality"))


@query()
def normals_by_k(spark: SparkSession, d: str) -> DataFrame:
    """For each number of neighbours: points with a normal, their curvature, the angle to the widest, and the share of ground points whose normal agrees with the ground's. One search serves all."""
    p, ks = cut(points(spark, d).select("pid", "frame", *XYZ)), (6, 10, 16)
    near = cut(nb.knn(p, p, max(ks)).join(p.select(F.col("pid").alias("p"), *XYZ), "p"))
    each = F.explode(F.array(*[F.lit(k) for k in ks]))
    m = near.withColumn("k", each).filter(F.col("rank") <= F.col("k")).groupBy("q", "k").agg(F.count("*").alias("n"), *cl.moments())
    n = cut(with_eigen(cut(m), cl.as_matrix()).select("q", "k", *[F.when(F.col("n") >= 5, F.col("normal")[i]).alias(f"n{c}") for i, c in enumerate(XYZ)], *[c.alias(f) for f, c in shape_features([F.col(f"l{i}") for i in range(3)]).items() if f == "curvature"]))
    widest = n.filter(F.col("k") == max(ks)).select("q", *[F.col(f"n{c}").alias(f"w{c}") for c in XYZ])
    ground = pl.ground_by_plane(p, threshold=0.4, max_angle=45.0, min_inliers=5).filter("ground").select(F.col("pid").alias("q"), *[F.col(f"n{c}").alias(f"g{c}") for c in XYZ])
    between = lambda a: angle_degrees(F.abs(F.col("nx") * F.col(f"{a}x") + F.col("ny") * F.col(f"{a}y") + F.col("nz") * F.col(f"{a}z")))
    both = n.join(widest, "q").join(ground, "q", "left")
    out = both.groupBy("k").agg(F.avg(F.col("nx").isNotNull().cast("double")).alias("valid_share"), F.avg("curvature").alias("curvature"), F.avg(between("w")).alias("angle_to_widest"), F.avg((between("g") < 15).cast("double")).alias("ground_agrees"))
    return rounded(out, "valid_share", "curvature", "angle_to_widest", "ground_agrees", digits=4)


_LOCAL = _EIGEN.split(PTS, 1)[1].lstrip(", ")


@query(f"""WITH {_COMPONENTS}, {_LOCAL}, f AS (SELECT q, l0 / (l0 + l1 + l2) AS curvature, (l2 - l1) / l2 AS linearity, (l1 - l0) / l2 AS planarity, l0 / l2 AS scattering FROM e5)
SELECT frame, cluster_id, count(*) AS n, round(avg(curvature), 4) AS mean_curvature, round(avg(linearity), 4) AS mean_linearity, round(avg(planarity), 4) AS mean_planarity, round(avg(scattering), 4) AS mean_scattering
FROM clu JOIN f ON clu.pid = f.q WHERE cluster_id >= 0 GROUP BY frame, cluster_id""")
def cluster_local_shape(spark: SparkSession, d: str) -> DataFrame:
    """Of each cluster the means of its points' local shape."""
    p = points(spark, d)
    local = cl.normals(p, 10).select("pid", *cl.LOCAL)
    out = cl.descriptors(cut(_clustered(spark, d).join(local, "pid")))
    return rounded(out.select("frame", F.col("cluster_id").cast("long").alias("cluster_id"), "n", *[f"mean_{c}" for c in cl.LOCAL]), *[f"mean_{c}" for c in cl.LOCAL], digits=4)
