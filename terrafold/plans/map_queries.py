"""Queries on cameras, detections, transforms and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.geometry import XYZ
from terrafold.operators import camera as cam
from terrafold.operators import semantic_map as sm
from terrafold.plans.registry import NUDGE, PTS, query, rounded
from terrafold.sources.tables import points, table

CAMERA = {"width": 64, "height": 48, "fx": 20.0, "fy": 20.0, "cx": 32.0, "cy": 24.0, "distortion": (0.1, -0.02, 0.001, -0.002, 0.003)}
# The transform from the body to the sensor.
BODY_SENSOR = {"t": (0.03595682, -0.01764054, 0.03291798), "q": (-0.0006598046, 0.0018554325, -0.0041559715, 0.999989425)}
NAMES = ["ground", "tree", "rock", "grass", "person", "vehicle"]

_POSE = """pose AS (SELECT event_id, value AS tx, CAST(event_id % 13 AS DOUBLE) AS ty, CAST(user_id AS DOUBLE) / 10 AS tz,
 sin(value / 20) AS qx0, cos(value / 30) * 0.5 AS qy0, CAST(user_id % 7 AS DOUBLE) / 10 - 0.3 AS qz0, 0.6 AS qw0 FROM events),
unitp AS (SELECT event_id, tx, ty, tz, qx0 / n AS qx, qy0 / n AS qy, qz0 / n AS qz, qw0 / n AS qw FROM (SELECT *, sqrt(qx0 * qx0 + qy0 * qy0 + qz0 * qz0 + qw0 * qw0) AS n FROM pose))"""
_MATRIX = """mat AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS m00, 2 * (qx * qy - qz * qw) AS m01, 2 * (qx * qz + qy * qw) AS m02, 2 * (qx * qy + qz * qw) AS m10, 1 - 2 * (qx * qx + qz * qz) AS m11, 2 * (qy * qz - qx * qw) AS m12,
 2 * (qx * qz - qy * qw) AS m20, 2 * (qy * qz + qx * qw) AS m21, 1 - 2 * (qx * qx + qy * qy) AS m22 FROM unitp)"""


def poses(spark: SparkSession, d: str) -> DataFrame:
    """A pose for each event: event_id, tx, ty, tz and a unit quaternion."""
    v, u = F.col("value"), F.col("user_id")
    p = table(spark, d, "events").select("event_id", v.alias("tx"), (F.col("event_id") % 13).cast("double").alias("ty"), (u.cast("double") / 10).alias("tz"), F.sin(v / 20).alias("qx"), (F.cos(v / 30) * 0.5).alias("qy"), ((u % 7).cast("double") / 10 - 0.3).alias("qz"), F.lit(0.6).alias("qw"))
    n = F.sqrt(g.square_sum(("qx", "qy", "qz", "qw")))
    return p.withColumn("n", n).withColumns({q: F.col(q) / F.col("n") for q in ("qx", "qy", "qz", "qw")}).drop("n")


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on small images: image_id, det_idx, class_id, confidence, x, y, w, h."""
    k = F.col("o_orderkey")
    as_int = lambda c: c.cast("int")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("image_id"), k.alias("det_idx"), as_int(k * 13 % 8).alias("class_id"), (F.col("o_totalprice") % 100 / 100).alias("confidence"),
        as_int(k * 7919 % 70 - 4).alias("x"), as_int(k * 104729 % 54 - 4).alias("y"), as_int(k % 12 + 4).alias("w"), as_int(k % 9 + 3).alias("h"),
    )


_DET = "det AS (SELECT o_custkey AS image_id, o_orderkey AS det_idx, CAST(o_orderkey * 13 % 8 AS INTEGER) AS class_id, o_totalprice % 100 / 100 AS confidence, CAST(o_orderkey * 7919 % 70 - 4 AS INTEGER) AS x, CAST(o_orderkey * 104729 % 54 - 4 AS INTEGER) AS y, CAST(o_orderkey % 12 + 4 AS INTEGER) AS w, CAST(o_orderkey % 9 + 3 AS INTEGER) AS h FROM orders)"
_CLIP = _DET + ", cl AS (SELECT image_id, det_idx, class_id, confidence, least(greatest(x, 0), 64) AS x, least(greatest(y, 0), 48) AS y, least(greatest(x + w, 0), 64) - least(greatest(x, 0), 64) AS w, least(greatest(y + h, 0), 48) - least(greatest(y, 0), 48) AS h FROM det)"
_MAP = _CLIP + """, px AS (SELECT image_id, v, unnest(range(x, x + w)) AS u, class_id, confidence, det_idx FROM (SELECT *, unnest(range(y, y + h)) AS v FROM cl WHERE w > 0 AND h > 0)),
cmap AS (SELECT image_id, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, class_id, confidence FROM px QUALIFY row_number() OVER (PARTITION BY image_id, v, u ORDER BY confidence DESC, det_idx) = 1)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Classified points in time, of line items: x, y, z, class_id (-1 unknown), confidence, stamp_us."""
    return table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2500).alias("y"), ((F.col("l_discount") + F.col("l_tax")) * 10).alias("z"), (F.col("l_linenumber") - 2).alias("class_id"), (F.col("l_discount") * 12).alias("confidence"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate AS timestamp_ntz))").alias("stamp_us"),
    )


_OBS = "obs AS (SELECT l_quantity AS x, l_extendedprice / 2500 AS y, (l_discount + l_tax) * 10 AS z, l_linenumber - 2 AS class_id, l_discount * 12 AS confidence, epoch_us(l_shipdate) AS stamp_us FROM lineitem), key AS (SELECT *, CAST(floor(x / 5.0) AS BIGINT) AS ix, CAST(floor(y / 5.0) AS BIGINT) AS iy, CAST(floor(z / 5.0) AS BIGINT) AS iz FROM obs)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Points moved before the camera."""
    return points(spark, d).withColumn("z", F.col("z") + 2.0)


_FRONT = PTS + ", front AS (SELECT pid, frame, x, y, z + 2.0 AS z FROM pts)"
_PROJ = _FRONT + ", pr AS (SELECT *, 20.0 * x / z + 32.0 AS u, 20.0 * y / z + 24.0 AS v, z AS depth FROM front WHERE z > 0), vis AS (SELECT * FROM pr WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48 AND depth BETWEEN 0.1 AND 50)"


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return cam.project(_frames(spark, d), g.pinhole(CAMERA), CAMERA, 0.1, 50.0)


@query(f"WITH {_POSE}, {_MATRIX} SELECT event_id, round(m00 * 1 + m01 * 2 + m02 * 3 + tx, 6) + 0.0 AS x, round(m10 * 1 + m11 * 2 + m12 * 3 + ty, 6) + 0.0 AS y, round(m20 * 1 + m21 * 2 + m22 * 3 + tz, 6) + 0.0 AS z FROM mat")
def transform_points(spark: SparkSession, d: str) -> DataFrame:
    m = g.quaternion_matrix("qx", "qy", "qz", "qw")
    r = g.rotate(m, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rounded(poses(spark, d).select("event_id", *[(a + F.col(f"t{c}")).alias(c) for a, c in zip(r, XYZ, strict=True)]), *XYZ)


_B = BODY_SENSOR


@query(f"""WITH {_POSE}, {_MATRIX}, p AS (SELECT event_id, qx * {_B['q'][3]} + qw * {_B['q'][0]} + qy * {_B['q'][2]} - qz * {_B['q'][1]} AS x, qw * {_B['q'][1]} - qx * {_B['q'][2]} + qy * {_B['q'][3]} + qz * {_B['q'][0]} AS y,
 qw * {_B['q'][2]} + qx * {_B['q'][1]} - qy * {_B['q'][0]} + qz * {_B['q'][3]} AS z, qw * {_B['q'][3]} - qx * {_B['q'][0]} - qy * {_B['q'][1]} - qz * {_B['q'][2]} AS w,
 m00 * {_B['t'][0]} + m01 * {_B['t'][1]} + m02 * {_B['t'][2]} + tx AS ox, m10 * {_B['t'][0]} + m11 * {_B['t'][1]} + m12 * {_B['t'][2]} + ty AS oy, m20 * {_B['t'][0]} + m21 * {_B['t'][1]} + m22 * {_B['t'][2]} + tz AS oz FROM mat)
SELECT event_id, round(ox, 6) + 0.0 AS tx, round(oy, 6) + 0.0 AS ty, round(oz, 6) + 0.0 AS tz, round(abs(w), 5) AS qw, round(x * w, 5) + 0.0 AS xw, round(y * w, 5) + 0.0 AS yw, round(z * w, 5) + 0.0 AS zw FROM p""")
def compose_poses(spark: SparkSession, d: str) -> DataFrame:
    """Composed by matrices and taken back to a quaternion; its sign is free, so products with w are shown."""
    a = g.quaternion_matrix("qx", "qy", "qz", "qw")
    b = g.quaternion_matrix(*[F.lit(q) for q in _B["q"]])
    p = poses(spark, d).select("event_id", *[F.col(f"t{c}") for c in XYZ], *[a[i][j].alias(f"a{i}{j}") for i in range(3) for j in range(3)], *[b[i][j].alias(f"b{i}{j}") for i in range(3) for j in range(3)])
    cell = lambda n, i, j: F.col(f"{n}{i}{j}")
    p = p.select("event_id", *[sum((cell("a", i, k) * cell("b", k, j) for k in (1, 2)), cell("a", i, 0) * cell("b", 0, j)).alias(f"c{i}{j}") for i in range(3) for j in range(3)], *[(sum((cell("a", i, k) * F.lit(_B["t"][k]) for k in (1, 2)), cell("a", i, 0) * F.lit(_B["t"][0])) + F.col(f"t{c}")).alias(f"t{c}") for i, c in enumerate(XYZ)])
    q = g.matrix_quaternion([[cell("c", i, j) for j in range(3)] for i in range(3)])
    p = p.select("event_id", "tx", "ty", "tz", *[c.alias(n) for n, c in zip(("x", "y", "z", "w"), q, strict=True)])
    n = F.sqrt(g.square_sum(("x", "y", "z", "w")))
    p = p.withColumn("n2", n * n)
    p = p.select("event_id", "tx", "ty", "tz", F.abs(F.col("w") / F.sqrt("n2")).alias("qw"), *[(F.col(c) * F.col("w") / F.col("n2")).alias(f"{c}w") for c in XYZ])
    return rounded(rounded(p, "tx", "ty", "tz"), "qw", "xw", "yw", "zw", digits=5)


@query(f"WITH {_POSE}, {_MATRIX} SELECT event_id, round(sqrt(tx * tx + ty * ty + tz * tz), 6) AS translation_m, round(degrees(acos(least(greatest((m00 + m11 + m22 - 1) / 2, -1.0), 1.0))), 4) AS rotation_deg FROM mat")
def transform_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = g.quaternion_matrix("qx", "qy", "qz", "qw")
    p = poses(spark, d).select("event_id", g.norm(("tx", "ty", "tz")).alias("translation_m"), g.rotation_degrees(m).alias("rotation_deg"))
    return rounded(rounded(p, "translation_m"), "rotation_deg", digits=4)


@query(f"WITH {_PROJ} SELECT pid, frame, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, depth FROM vis")
def project_pinhole(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_projected(spark, d).select("pid", "frame", "u", "v", "depth"), "u", "v")


@query(f"""WITH {_FRONT}, n AS (SELECT pid, x / z AS a, y / z AS b FROM front WHERE z > 0.1), r AS (SELECT *, a * a + b * b AS r2 FROM n), s AS (SELECT *, 1 + 0.1 * r2 - 0.02 * r2 * r2 + 0.003 * r2 * r2 * r2 AS k FROM r)
SELECT pid, round(20.0 * (a * k + 2 * 0.001 * a * b - 0.002 * (r2 + 2 * a * a)) + 32.0, 5) + 0.0 AS u, round(20.0 * (b * k + 0.001 * (r2 + 2 * b * b) - 2 * 0.002 * a * b) + 24.0, 5) + 0.0 AS v FROM s""")
def project_distorted(spark: SparkSession, d: str) -> DataFrame:
    u, v, good = g.distorted(CAMERA, 0.1)
    return rounded(_frames(spark, d).filter(good).select("pid", u.alias("u"), v.alias("v")), "u", "v", digits=5)


@query(f"""WITH {_PROJ}, p AS (SELECT pid, frame, floor(u + 0.5) AS pu, floor(v + 0.5) AS pv, depth FROM vis)
SELECT a.pid, any_value(a.frame) AS frame FROM p a JOIN p b ON a.frame = b.frame AND abs(a.pu - b.pu) <= 1 AND abs(a.pv - b.pv) <= 1 GROUP BY a.pid HAVING any_value(a.depth) <= min(b.depth) + 0.15""")
def zbuffer_visible(spark: SparkSession, d: str) -> DataFrame:
    return cam.visible(_projected(spark, d)).select("pid", "frame")


_LOOKED = _PROJ + ", " + _MAP + ", pp AS (SELECT pid, frame, CAST(floor(u + 0.5) AS INTEGER) AS pu, CAST(floor(v + 0.5) AS INTEGER) AS pv FROM vis), fm AS (SELECT image_id AS frame, u, v, class_id, confidence FROM cmap)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """The class maps of the images that points are looked up in, no others."""
    seen = points(spark, d).select(F.col("frame").alias("image_id")).distinct()
    return cam.class_map(cam.clip_boxes(detections(spark, d).join(seen, "image_id", "left_semi"), 64, 48)).withColumnRenamed("image_id", "frame")


@query(f"WITH {_LOOKED} SELECT pid, pp.frame, COALESCE(class_id, -1) AS pixel_class, round(COALESCE(confidence, 0.0), 6) AS pixel_confidence FROM pp LEFT JOIN fm ON pp.frame = fm.frame AND pu = u AND pv = v")
def pixel_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cam.pixel_lookup(_projected(spark, d), _pixels(spark, d)).select("pid", "frame", "pixel_class", "pixel_confidence"), "pixel_confidence")


@query(f"""WITH {_LOOKED}, h AS (SELECT pid, class_id, confidence, v - pv AS dv, u - pu AS du FROM pp JOIN fm ON pp.frame = fm.frame AND abs(u - pu) <= 2 AND abs(v - pv) <= 2),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY pid ORDER BY confidence DESC, dv, du) = 1)
SELECT pid, frame, COALESCE(class_id, -1) AS pixel_class, round(COALESCE(confidence, 0.0), 6) AS pixel_confidence FROM pp LEFT JOIN b USING (pid)""")
def pixel_neighborhood_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cam.pixel_neighborhood(_projected(spark, d), _pixels(spark, d), 2).select("pid", "frame", "pixel_class", "pixel_confidence"), "pixel_confidence")


@query(f"""WITH {_LOOKED}, l AS (SELECT pp.frame, COALESCE(class_id, -1) AS c, COALESCE(confidence, 0.0) AS k FROM pp LEFT JOIN fm ON pp.frame = fm.frame AND pu = u AND pv = v),
s AS (SELECT frame, count(*) AS projected, count(*) FILTER (k >= 0.25 AND c BETWEEN 0 AND 5) AS assigned, count(*) FILTER (k >= 0.25 AND NOT c BETWEEN 0 AND 5) AS "unknown", count(*) FILTER (k < 0.25) AS low_conf FROM l GROUP BY frame)
SELECT f.frame, input, COALESCE(projected, 0) AS projected, COALESCE(assigned, 0) AS assigned, COALESCE("unknown", 0) AS "unknown", COALESCE(low_conf, 0) AS low_conf, input - COALESCE(projected, 0) AS invalid
FROM (SELECT frame, count(*) AS input FROM front GROUP BY frame) f LEFT JOIN s ON f.frame = s.frame""")
def fusion_counters(spark: SparkSession, d: str) -> DataFrame:
    routed = cam.fusion_status(cam.pixel_lookup(_projected(spark, d), _pixels(spark, d)), 0.25, 6)
    return cam.fusion_counters(_frames(spark, d), routed)


@query(f"WITH {_CLIP} SELECT image_id, det_idx, x, y, w, h FROM cl")
def detection_clip(spark: SparkSession, d: str) -> DataFrame:
    return cam.clip_boxes(detections(spark, d), 64, 48).select("image_id", "det_idx", "x", "y", "w", "h")


@query(f"WITH {_MAP} SELECT image_id, v, u, class_id, round(confidence, 6) AS confidence FROM cmap")
def class_map_argmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cam.class_map(cam.clip_boxes(detections(spark, d), 64, 48)), "confidence")


@query(f"""WITH {_MAP}, o AS (SELECT image_id, v, u, class_id, confidence, 1 AS o FROM cmap UNION ALL
 SELECT image_id, CAST(y + det_idx % 3 AS INTEGER), CAST(x + det_idx % 4 AS INTEGER), class_id, confidence * (0.5 + (det_idx % 2)), -det_idx - 1 FROM cl)
SELECT image_id, v, u, class_id, round(confidence, 6) AS confidence FROM o QUALIFY row_number() OVER (PARTITION BY image_id, v, u ORDER BY confidence DESC, o DESC) = 1""")
def class_map_masked(spark: SparkSession, d: str) -> DataFrame:
    boxes = cam.clip_boxes(detections(spark, d), 64, 48)
    k = F.col("det_idx")
    masks = boxes.select("image_id", "det_idx", (F.col("y") + k % 3).cast("int").alias("v"), (F.col("x") + k % 4).cast("int").alias("u"), (0.5 + (k % 2)).alias("weight"))
    return rounded(cam.masked_class_map(boxes, masks), "confidence")


@query(f"""WITH {_DET} SELECT image_id, det_idx, class_id, CASE class_id {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))} ELSE 'class_' || class_id END AS class_name FROM det""")
def class_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(NAMES)), "class_id int, class_name string")
    return cam.class_names(detections(spark, d).select("image_id", "det_idx", "class_id"), names)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, [l_discount, l_tax, l_quantity / 500] AS sc FROM lineitem), m AS (SELECT *, list_max(sc) AS top FROM s)
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(list_position(sc, top) - 1 AS INTEGER) AS class_id, top AS confidence FROM m WHERE top >= 0.05""")
def candidate_best_class(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.array("l_discount", "l_tax", F.col("l_quantity") / 500).alias("scores"))
    return cam.best_class(c, "scores", 0.05).drop("scores")


@query("""WITH c AS (SELECT p_partkey, p_size * 12.0 AS cx, p_retailprice / 4 AS cy, 20.0 + p_size AS bw, 30.0 + p_size AS bh FROM part)
SELECT p_partkey, CAST(round((cx - bw / 2 - 0.0) / 0.5) AS INTEGER) AS x, CAST(round((cy - bh / 2 - 140.0) / 0.5) AS INTEGER) AS y, CAST(round(bw / 0.5) AS INTEGER) AS w, CAST(round(bh / 0.5) AS INTEGER) AS h FROM c""")
def letterbox_decode(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 12.0).alias("cx"), (F.col("p_retailprice") / 4).alias("cy"), (20.0 + F.col("p_size")).alias("bw"), (30.0 + F.col("p_size")).alias("bh"))
    return cam.decode_boxes(c, (640, 640), (1280, 720)).select("p_partkey", "x", "y", "w", "h")


@query(f"""WITH {_CLIP}, i AS (SELECT a.image_id, a.det_idx AS det_a, b.det_idx AS det_b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS o, a.w * a.h + b.w * b.h AS t
 FROM cl a JOIN cl b ON a.image_id = b.image_id AND a.det_idx < b.det_idx WHERE a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0) SELECT image_id, det_a, det_b, round(o / (t - o), 6) AS iou FROM i WHERE o > 0""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cam.iou_pairs(cam.clip_boxes(detections(spark, d), 64, 48)), "iou")


_LAP = "greatest(0, least(b.x + b.w, d.x + d.w) - greatest(b.x, d.x)) * greatest(0, least(b.y + b.h, d.y + d.h) - greatest(b.y, d.y))"


@query(f"""WITH RECURSIVE {_CLIP}, d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_idx) AS k FROM cl WHERE w > 0 AND h > 0),
r(image_id, k, boxes, kept) AS (SELECT image_id, k, [{{'x': x, 'y': y, 'w': w, 'h': h}}], true FROM d WHERE k = 1 UNION ALL
 SELECT image_id, k, CASE WHEN free THEN list_append(boxes, box) ELSE boxes END, free FROM (SELECT d.image_id, d.k, r.boxes, {{'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h}} AS box,
  len(list_filter(r.boxes, lambda b: {_LAP} > 0 AND CAST({_LAP} AS DOUBLE) / (b.w * b.h + d.w * d.h - {_LAP}) > 0.45)) = 0 AS free FROM r JOIN d ON d.image_id = r.image_id AND d.k = r.k + 1))
SELECT d.image_id, d.det_idx, d.class_id, d.confidence FROM r JOIN d USING (image_id, k) WHERE r.kept""")
def nms(spark: SparkSession, d: str) -> DataFrame:
    return cam.suppress(cam.clip_boxes(detections(spark, d), 64, 48).filter("w > 0 AND h > 0")).select("image_id", "det_idx", "class_id", "confidence")


@query(f"""WITH {_OBS}, c AS (SELECT ix, iy, iz, class_id, sum(confidence) AS s, max(confidence) AS mx, count(*) AS n, sum(z) AS sz, min(z) AS lz, max(z) AS hz, max(stamp_us) AS t FROM key WHERE confidence >= 0.1 GROUP BY ALL),
t AS (SELECT ix, iy, iz, sum(s) AS tot, max(mx) AS mx, CAST(sum(n) AS BIGINT) AS n, sum(sz) / sum(n) AS mz, min(lz) AS lz, max(hz) AS hz, max(t) AS t FROM c GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, round(s, 9) AS rs FROM c) WHERE class_id >= 0 AND s > 0 QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY rs DESC, class_id) = 1)
SELECT ix, iy, iz, COALESCE(class_id, -1) AS class_id, round(COALESCE(s / tot, 0.0), 6) AS share, t.n AS observations, round(t.mx, 6) AS confidence_max, round(mz + 3e-9, 6) AS mean_z, round(t.lz, 6) AS min_z, round(t.hz, 6) AS max_z, t.t AS last_stamp FROM t LEFT JOIN b USING (ix, iy, iz)""")
def semantic_voxel_map(spark: SparkSession, d: str) -> DataFrame:
    m = sm.voxel_map(observations(spark, d), 5.0, 0.1).select("ix", "iy", "iz", "class_id", "share", "observations", "confidence_max", "mean_z", "min_z", "max_z", "last_stamp")
    return rounded(rounded(m, "share", "confidence_max", "min_z", "max_z"), "mean_z", nudge=NUDGE)


_VALID = _OBS + ", ok AS (SELECT ix, iy, iz, class_id, least(confidence, 1.0) AS c, z, stamp_us FROM key WHERE class_id BETWEEN 0 AND 19 AND isfinite(confidence) AND confidence > 0)"


def _evidence_sql(weight: str, prior: str) -> str:
    return f"""WITH {_VALID}, e AS (SELECT *, max(stamp_us) OVER v AS t1, min(stamp_us) OVER v AS t0 FROM ok WINDOW v AS (PARTITION BY ix, iy, iz)),
c AS (SELECT ix, iy, iz, class_id, sum({weight}) AS s, any_value({prior}) AS p, count(*) AS n, sum(z) AS sz, sum(z * z) AS szz FROM e GROUP BY ALL),
t AS (SELECT ix, iy, iz, sum(s) + 20 * max(p) AS tot, CAST(sum(n) AS BIGINT) AS n, sum(sz) / sum(n) AS mz, sum(szz) / sum(n) - (sum(sz) / sum(n)) ** 2 AS vz FROM c GROUP BY ALL),
b AS (SELECT *, round(s + p, 9) AS rs FROM c QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY rs DESC, class_id) = 1)
SELECT ix, iy, iz, class_id, round((s + p) / tot, 6) AS posterior, t.n AS observations, round(mz + 3e-9, 6) AS mean_z, round(greatest(vz, 0.0) + 3e-9, 5) AS var_z FROM t JOIN b USING (ix, iy, iz)"""


def evidence_rounded(df: DataFrame) -> DataFrame:
    return rounded(rounded(rounded(df, "posterior"), "mean_z", nudge=NUDGE), "var_z", digits=5, nudge=NUDGE)


@query(_evidence_sql("c", "0.001"))
def evidence_fusion(spark: SparkSession, d: str) -> DataFrame:
    return evidence_rounded(sm.evidence_map(observations(spark, d), 5.0))


@query(_evidence_sql("c * exp(-(t1 - stamp_us) / 1e6 / 31536000.0)", "0.001 * exp(-(t1 - t0) / 1e6 / 31536000.0)"))
def evidence_decay(spark: SparkSession, d: str) -> DataFrame:
    return evidence_rounded(sm.evidence_map(observations(spark, d), 5.0, tau=31_536_000.0))


@query(f"WITH {_OBS} SELECT count(*) AS voxels FROM (SELECT DISTINCT ix, iy, iz FROM key)")
def voxel_count(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select(*g.voxel_keys(5.0)).distinct().groupBy().agg(F.count("*").alias("voxels"))


@query(f"""WITH RECURSIVE {PTS}, o AS (SELECT class_id, confidence, CAST(floor(x / 2.0) AS BIGINT) AS ix, CAST(floor(y / 2.0) AS BIGINT) AS iy, CAST(floor(z / 2.0) AS BIGINT) AS iz, pid FROM pts WHERE class_id >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY pid) AS n, count(*) OVER (PARTITION BY ix, iy, iz) AS total FROM o),
r(ix, iy, iz, n, slots) AS (SELECT ix, iy, iz, n, [{{'s': confidence, 'c': class_id}}] FROM k WHERE n = 1 UNION ALL
 SELECT k.ix, k.iy, k.iz, k.n, CASE WHEN len(list_filter(slots, lambda x: x.c = k.class_id)) > 0 THEN list_transform(slots, lambda x: CASE WHEN x.c = k.class_id THEN {{'s': x.s + k.confidence, 'c': x.c}} ELSE x END)
  WHEN len(slots) < 4 THEN list_append(slots, {{'s': k.confidence, 'c': k.class_id}})
  WHEN k.confidence > list_sort(slots)[1].s THEN list_append(list_sort(slots)[2:], {{'s': k.confidence, 'c': k.class_id}}) ELSE slots END
 FROM r JOIN k ON k.ix = r.ix AND k.iy = r.iy AND k.iz = r.iz AND k.n = r.n + 1)
SELECT r.ix, r.iy, r.iz, list_transform(list_sort(slots), lambda x: x.c) AS classes, round(list_sum(list_transform(slots, lambda x: x.s)), 6) AS score FROM r JOIN k ON k.ix = r.ix AND k.iy = r.iy AND k.iz = r.iz AND k.n = r.n WHERE k.n = k.total""")
def class_slots(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumnRenamed("pid", "seq")
    out = sm.slots_in_order(p, 2.0, 4)
    return out.select("ix", "iy", "iz", F.transform("slots", lambda s: s["class_id"]).alias("classes"), F.round(F.aggregate("slots", F.lit(0.0), lambda a, s: a + s["score"]), 6).alias("score"))
