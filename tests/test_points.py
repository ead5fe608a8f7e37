"""Point operators on literal rows and on scenes whose truth is known."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators import camera, clusters, components, filters, neighbors, planes, registration, semantic_map, timeseries
from terrafold.operators.components import connected_components
from terrafold.plans.lidar import ScanConfig, reduction, run_scan
from terrafold.sources import bag, cloud

NAN = float("nan")


def frame(spark, rows, columns="pid long, frame long, x double, y double, z double"):
    return spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(rows)], columns)


def kept(df):
    return sorted(r.pid for r in df.collect())


def test_filters_on_literals(spark):
    p = frame(spark, [(0, 0, 0), (NAN, 1, 1), (1, 0, 0), (10, 0, 0), (0.1, 0.1, 0.1), (math.inf, 0, 0)])
    assert kept(p.filter(g.all_finite())) == [0, 2, 3, 4]
    assert kept(p.filter(filters.nonzero())) == [1, 2, 3, 4, 5]
    assert kept(p.filter(filters.in_range(0.5, 5))) == [2]
    assert kept(p.filter(filters.in_box((-0.2,) * 3, (0.2,) * 3))) == [0, 4]
    assert kept(p.filter(~filters.in_box((-0.2,) * 3, (0.2,) * 3))) == [1, 2, 3, 5]


def test_accounts_add_up(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 2, (400, 3)).tolist() + [(0, 0, 0)] * 20 + [(NAN, 0, 0)] * 10
    out = run_scan(frame(spark, rows).withColumn("intensity", F.col("pid") * 1.0), ScanConfig(range=(0.5, 4.0), crop=((-0.5,) * 3, (0.5,) * 3, True), voxel=0.5))
    s = reduction(out["stats"]).first()
    removed = s.removed_nonfinite + s.removed_zero + s.removed_range + s.removed_crop
    assert (s.input, s.removed_nonfinite, s.removed_zero) == (430, 10, 20) and removed + s.filtered == 430 == s.input
    assert out["voxelized"].agg(F.sum("point_count")).first()[0] == s.filtered and s.voxelized == out["voxelized"].count()
    for bad in ({"range": (2, 1)}, {"averages": ("x",)}, {"outlier": "none such"}, {"crop": ((1,) * 3, (0,) * 3, True)}):
        with pytest.raises(ValueError):
            ScanConfig(**bad)


def test_voxels_on_literals(spark):
    rows = [(0.01, 0.01, 0.01), (0.03, 0.03, 0.03), (0.51, 0, 0), (-0.01, 0, 0)]
    p = frame(spark, rows).withColumn("intensity", F.element_at(F.array(*map(F.lit, (1.0, 3.0, 10.0, 7.0))), (F.col("pid") + 1).cast("int")))
    v = {(r.ix, r.iy, r.iz): r for r in filters.voxel_grid(p, 0.1, ("intensity",)).collect()}
    assert set(v) == {(0, 0, 0), (5, 0, 0), (-1, 0, 0)}
    r = v[0, 0, 0]
    assert r.point_count == 2 and r.intensity == 2.0 and abs(r.x - 0.02) < 1e-12
    q = frame(spark, [(0.01, 0, 0), (0.02, 0, 0), (5, 0, 0)])
    assert [r.voxel for r in filters.point_to_voxel(q, 0.1, 2).orderBy("pid").collect()] == [0, 0, -1]
    assert filters.voxel_grid(q.limit(0), 0.1).count() == 0


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-10, 10, (800, 3))
    x = np.vstack([x, [[200.0, 0, 0]]])
    p = frame(spark, x.tolist())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    n = {r.pid: r.n for r in neighbors.radius_count(p, p, 1.5).collect()}
    assert n == {i: int((d[i] <= 1.5).sum()) for i in range(len(x))}
    got = {}
    for r in neighbors.knn(p, p, 4).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.p, r.distance)
    for i in range(len(x)):
        best = np.argsort(d[i], kind="stable")[:4]
        assert [got[i][k + 1][0] for k in range(4)] == best.tolist() and abs(got[i][4][1] - d[i][best[3]]) < 1e-9
    assert neighbors.knn(p.limit(0), p.limit(0), 3).count() == 0


@pytest.mark.parametrize("include_self", [True, False])
def test_neighbours_across_blocks(spark, monkeypatch, include_self):
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    rng = np.random.default_rng(21)
    x = np.vstack([rng.uniform(-10, 10, (400, 3)), rng.normal(0, 0.01, (200, 3)), np.repeat([[3.0, 3.0, 3.0]], 60, 0), [[500.0, -500, 0]]]).round(3)
    p = frame(spark, x.tolist())
    got = {}
    for r in neighbors.knn(p, p, 6, include_self=include_self).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.p, r.distance)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])).tolist() if include_self or j != i][:6]
        assert [got[i][n + 1][0] for n in range(6)] == order
    q = frame(spark, (rng.uniform(-12, 12, (50, 3))).tolist()).withColumn("pid", F.col("pid") + 1000)
    found = {}
    for r in neighbors.knn(q, p, 3).collect():
        found.setdefault(r.q, []).append((r["rank"], r.p))
    for r in q.collect():
        e = ((x - [r.x, r.y, r.z]) ** 2).sum(1)
        assert [n for _, n in sorted(found[r.pid])] == np.lexsort((np.arange(len(x)), e))[:3].tolist()


def test_outliers(spark):
    rng = np.random.default_rng(2)
    p = frame(spark, [*rng.normal(0, 0.05, (300, 3)).tolist(), (5, 5, 5)])
    far = neighbors.statistical_outliers(p, 20, 2.0).filter("NOT kept").collect()
    assert 300 in [r.pid for r in far] and len(far) < 30
    assert [r.pid for r in neighbors.radius_outliers(p, 0.2, 5).filter("NOT kept").collect()] == [300]
    two = frame(spark, [(0, 0, 0), (10, 0, 0)])
    assert neighbors.radius_outliers(two, 1.0, 1).filter("kept").count() == 2 and neighbors.radius_outliers(two, 1.0, 2).filter("kept").count() == 0
    assert neighbors.statistical_outliers(two, 20).filter("kept").count() == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 500), (None, 3), (139, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 500: 500}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    words = {r.node: r.component for r in connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "src string, dst string")).collect()}
    assert words == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


@pytest.mark.parametrize("alone", [0, 10**6])
def test_components_in_rounds_and_alone(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    rng = np.random.default_rng(31)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 500, (330, 2))] + [(1000 + i, 1001 + i) for i in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()}
    top = {n: n for e in edges for n in e}
    for _ in range(len(top)):
        if not any(top[a] != top[b] for a, b in edges):
            break
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == top


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [*rng.normal(0, 0.1, (120, 3)).tolist(), *(rng.normal(0, 0.1, (60, 3)) + 5).tolist(), (20, 0, 0), (20.1, 0, 0)]
    c = clusters.clusters(frame(spark, rows), 0.4, 5)
    sizes = {r.cluster_id: r["count"] for r in c.groupBy("cluster_id").count().collect()}
    assert sizes == {0: 120, 1: 60, -1: 2}
    line = frame(spark, [(i * 0.2, 0, 0) for i in range(50)])
    assert clusters.clusters(line, 0.25).select("component").distinct().count() == 1
    assert clusters.clusters(line, 0.15).select("component").distinct().count() == 50
    assert clusters.clusters(line, 0.25, 1, 10).filter("cluster_id >= 0").count() == 0


def test_normals_and_shapes(spark):
    rng = np.random.default_rng(4)
    flat = frame(spark, np.column_stack([rng.uniform(-2, 2, (150, 2)), np.full(150, -1.0)]).tolist())
    n = clusters.normals(flat, 12).agg(F.min("nz"), F.max("curvature"), F.min("planarity")).first()
    assert n[0] > 0.999 and n[1] < 1e-6
    ball = rng.normal(size=(400, 3))
    ball = 2 * ball / np.linalg.norm(ball, axis=1, keepdims=True)
    radial = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")) / 2
    assert clusters.normals(frame(spark, ball.tolist()), 10).agg(F.avg(radial)).first()[0] > 0.95
    shapes = {"linear": np.outer(np.linspace(0, 4, 80), [1, 0.2, 0]), "planar": np.column_stack([rng.uniform(0, 3, (80, 2)), np.zeros(80)]), "scattered": rng.normal(0, 1, (300, 3))}
    for name, points in shapes.items():
        one = frame(spark, points.tolist()).withColumn("cluster_id", F.lit(0))
        assert clusters.descriptors(one).first()["shape"] == name
    assert clusters.normals(frame(spark, [(0, 0, 0), (1, 1, 1)]), 5).filter("nx IS NOT NULL").count() == 0


def test_boxes(spark):
    rng = np.random.default_rng(5)
    a = math.radians(30)
    corners = np.array([(x, y, z) for x in (-2, 2) for y in (-0.5, 0.5) for z in (-0.5, 0.5)])
    p = np.vstack([corners, rng.uniform(-1, 1, (200, 3)) * [2, 0.5, 0.5]]) @ np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
    c = frame(spark, p.tolist()).withColumn("cluster_id", F.lit(0))
    box = {k: clusters.boxes(c, k).first() for k in ("upright", "axis", "pca")}
    assert np.allclose(sorted(box["upright"].extent), [1, 1, 4], atol=1e-6) and box["upright"].volume <= box["axis"].volume and box["pca"].volume < box["axis"].volume
    r = np.array(box["upright"].rotation)
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0
    assert clusters.boxes(frame(spark, [(1, 2, 3)]).withColumn("cluster_id", F.lit(0)), "upright").first().volume == 0


def scene(spark, rng, slope=0.0, waves=0.0, n=3000):
    xy = rng.uniform(-15, 15, (n, 2))
    z = -0.5 + xy[:, 0] * math.tan(math.radians(slope)) + waves * np.sin(xy[:, 0] / 3) + rng.normal(0, 0.01, n)
    wall = np.column_stack([np.full(500, -10.0), rng.uniform(-3, 3, 500), rng.uniform(0.1, 2, 500) - 0.5 + 4])
    rows = np.vstack([np.column_stack([xy, z]), wall])
    return frame(spark, rows.tolist()).withColumn("truth", F.col("pid") < n)


@pytest.mark.parametrize("slope", [0.0, 8.0])
def test_ground_by_plane(spark, slope):
    s = scene(spark, np.random.default_rng(6), slope)
    found = planes.ground_by_plane(s, 0.08, max_angle=20.0, min_inliers=100)
    r = found.agg(F.count_if(F.col("truth") & F.col("ground")), F.count_if("truth"), F.count_if("ground")).first()
    assert r[0] / r[1] > 0.98 and r[0] / r[2] > 0.97
    assert abs(planes.ground_statistics(found).first().slope - slope) < 0.5


def test_grid_follows_waves(spark):
    s = scene(spark, np.random.default_rng(7), waves=0.6)
    recall = lambda df: df.filter("truth").agg(F.avg(F.col("ground").cast("double"))).first()[0]
    one = recall(planes.ground_by_plane(s, 0.08))
    many = planes.ground_by_grid(s, 2.0, 10, 0.08, 25.0, 1.5, base={"max_angle": 5.0})
    assert recall(many) > one + 0.3
    cells = planes.cell_counts(many).first()
    assert cells.cells == sum(cells[2:]) > 100 and cells.accepted > 50
    assert {r[0] for r in many.select("cell_status").distinct().collect()} <= {"too_few_points", "no_plane_within_tilt", "height_offset", "tilt", "accepted"}


def test_plane_guards(spark):
    assert planes.iterations_needed(0.0) == math.inf and planes.iterations_needed(1.0) == 1
    assert planes.iterations_needed(0.5) == math.ceil(math.log(0.001) / math.log(1 - 0.125))
    few = planes.planes(frame(spark, [(0, 0, 0), (1, 0, 0)])).first()
    assert few.status == "too_few_candidates" and few.nx is None
    assert planes.planes(frame(spark, [(0, 0, z) for z in range(50)])).first().status == "no_plane_within_angle"


@pytest.mark.parametrize("method", ["point_to_point", "point_to_plane"])
def test_registration_finds_the_motion(spark, method):
    rng = np.random.default_rng(8)
    p = rng.uniform(-3, 3, (250, 2))
    p = np.column_stack([p, np.sin(p[:, 0]) + np.cos(p[:, 1])])
    t = registration.small_motion(np.array([0.01, -0.02, 0.03, 0.05, -0.04, 0.02]))
    source = frame(spark, p.tolist()).select("pid", "x", "y", "z")
    target = registration.transformed(source, t)
    if method == "point_to_plane":
        target = registration.with_normals(target)
    found = registration.icp(source, target, 0.6, 12, method=method)
    assert np.abs(found["transform"] - t).max() < 0.01 and found["correspondences"] > 200
    with pytest.raises(ValueError):
        registration.multiscale_icp(source, target, (0.2,), (1, 2), (3,))


def test_consecutive_frames_are_registered_at_once(spark):
    rng = np.random.default_rng(16)
    xy = rng.uniform(-3, 3, (250, 2))
    p = np.column_stack([xy, np.sin(xy[:, 0]) + np.cos(xy[:, 1])])
    rows, at, steps = [], np.eye(4), []
    for f in range(3):
        rows += [(1000 * f + i, f, *map(float, (at @ [*x, 1])[:3])) for i, x in enumerate(p)]
        steps.append(registration.small_motion(np.array([0.01, -0.01, 0.02, 0.04, 0.03 * f, -0.02])))
        at = steps[-1] @ at
    rows += [(9000, 9, 0.0, 0.0, 0.0)]
    got = registration.register_frames(spark.createDataFrame(rows, "pid long, frame long, x double, y double, z double"), 0.5, 15).orderBy("current").collect()
    assert [(r.previous, r.current) for r in got] == [(0, 1), (1, 2)]
    for r, step in zip(got, steps, strict=False):
        t = np.array([[r[f"t{i}{j}"] for j in range(4)] for i in range(3)])
        assert np.abs(t - np.linalg.inv(step)[:3]).max() < 0.01 and r.n > 200 and r.rmse < 0.02
    m = registration.motion_metrics(steps[1] @ steps[0], steps[0])
    assert abs(m["translation_m"] - np.linalg.norm(steps[1][:3, 3])) < 1e-9


@pytest.mark.parametrize("method", ["point_to_point", "point_to_plane"])
def test_all_frames_are_registered_coarse_to_fine(spark, method):
    rng = np.random.default_rng(18)
    xy = rng.uniform(-3, 3, (700, 2))
    p = np.column_stack([xy, np.sin(xy[:, 0]) + np.cos(xy[:, 1])])
    step = registration.small_motion(np.array([0.02, -0.03, 0.05, 0.12, -0.1, 0.06]))
    rows, at = [], np.eye(4)
    for f in range(3):
        rows += [(1000 * f + i, f, *map(float, (at @ [*x, 1])[:3])) for i, x in enumerate(p)]
        at = step @ at
    df = spark.createDataFrame(rows, "pid long, frame long, x double, y double, z double")
    got = registration.register_scales(df, (0.4, 0.0), (2.0, 1.0), (12, 12), method).collect()
    assert sorted((r.previous, r.current) for r in got) == [(0, 1), (1, 2)]
    for r in got:
        t = np.array([[r[f"t{i}{j}"] for j in range(4)] for i in range(3)])
        assert np.abs(t - np.linalg.inv(step)[:3]).max() < 0.02 and r.n > 500
    with pytest.raises(ValueError):
        registration.register_scales(df, (0.1,), (1.0, 2.0), (1,))


def test_multiscale_registration(spark):
    rng = np.random.default_rng(17)
    xy = rng.uniform(-3, 3, (250, 2))
    source = frame(spark, np.column_stack([xy, np.sin(xy[:, 0]) + np.cos(xy[:, 1])]).tolist()).select("pid", "x", "y", "z")
    t = registration.small_motion(np.array([0.02, -0.02, 0.03, 0.1, -0.08, 0.05]))
    found = registration.multiscale_icp(source, registration.transformed(source, t), (0.4, 0.0), (2.0, 1.0), (6, 8))
    assert found["correspondences"] > 0 and np.abs(found["transform"] - t).max() < 0.1


def test_evidence_of_one_class(spark):
    rows = [(0.01, 0.01, 0.1, 3, 0.91, 10), (0.02, 0.02, 0.2, 3, 0.83, 20), (0.03, 0.03, 0.3, 3, 0.95, 30), (0.01, 0.01, 0.1, 25, 0.9, 5), (0.01, 0.01, 0.1, 3, NAN, 5), (0.01, 0.01, 0.1, 3, 0.0, 5)]
    o = spark.createDataFrame(rows, "x double, y double, z double, class_id int, confidence double, stamp_us long")
    r = semantic_map.evidence_map(o.withColumn("z", F.lit(0.05)), 0.1).first()
    assert r.class_id == 3 and abs(r.posterior - 2.691 / 2.710) < 1e-9 and r.observations == 3
    m = semantic_map.voxel_map(o.filter("confidence > 0 AND NOT isnan(confidence)").withColumn("z", F.lit(0.05)).withColumn("class_id", F.when(F.col("class_id") == 25, -1).otherwise(F.col("class_id"))), 0.1).first()
    assert m.class_id == 3 and abs(m.share - 2.69 / 3.59) < 1e-9 and m.observations == 4


def test_evidence_fades_as_a_sequence_would(spark):
    rng = np.random.default_rng(9)
    seq = sorted((int(t), int(c), float(k)) for t, c, k in zip(rng.integers(1, 10**8, 60), rng.integers(0, 4, 60), rng.uniform(0.1, 1, 60), strict=True))
    e, last = np.full(5, 0.01), None
    for t, c, k in seq:
        if last is not None:
            e *= math.exp(-(t - last) / 1e6 / 20)
        e[c] += k
        last = t
    o = spark.createDataFrame([(0.0, 0.0, 0.0, c, k, t) for t, c, k in seq], "x double, y double, z double, class_id int, confidence double, stamp_us long")
    r = semantic_map.evidence_map(o, 1.0, 5, 0.01, 20.0).first()
    assert r.class_id == int(e.argmax()) and abs(r.posterior - e.max() / e.sum()) < 1e-9


def test_class_slots_fold_in_order(spark):
    rows = [(0, 1, 0.5), (1, 2, 0.3), (2, 3, 0.2), (3, 4, 0.4), (4, 2, 0.9), (5, 1, 0.1)]
    o = spark.createDataFrame([(s, 0.0, 0.0, 0.0, c, k) for s, c, k in rows], "seq long, x double, y double, z double, class_id int, confidence double")
    slots = semantic_map.slots_in_order(o, 1.0, 2).first().slots
    # By hand: 1 and 2 take the places; 3 (0.2) is no more than 2 (0.3); 4 (0.4) takes 2's place; 2 (0.9) takes 4's; 1 grows by 0.1.
    assert {s.class_id: round(s.score, 9) for s in slots} == {1: 0.6, 2: 0.9}


def test_stamps(spark):
    times = [i * 100_000 for i in range(100) if i != 50]
    s = spark.createDataFrame([(i, t, "a") for i, t in enumerate(times)], "seq long, stamp_us long, topic string")
    r = timeseries.stamp_statistics(s).first()
    assert abs(r.median_dt - 0.1) < 1e-9 and r.gaps == 1 and r.non_monotonic == 0 and r.n == 99
    ref = spark.createDataFrame([(i, t, "a") for i, t in enumerate((0, 100, 200))], "seq long, stamp_us long, topic string")
    other = spark.createDataFrame([(i, t, "a") for i, t in enumerate((10, 60, 110, 160, 210))], "seq long, stamp_us long, topic string")
    assert [r.offset for r in timeseries.nearest_offsets(ref, other, "topic").orderBy("key").collect()] == [10, 10, 10]
    tie = spark.createDataFrame([(0, 50, "a"), (1, 150, "a")], "seq long, stamp_us long, topic string")
    assert [r.offset for r in timeseries.nearest_offsets(ref.filter("seq = 1"), tie, "topic").collect()] == [-50]
    one = spark.createDataFrame([(0, 500, "a")], "seq long, stamp_us long, topic string")
    assert timeseries.nearest_offsets(ref.filter("seq = 2"), one, "topic").first().offset == 300


@pytest.mark.parametrize("run", [50, 1 << 40])
def test_streams_cut_into_runs_are_as_whole(spark, run):
    rng = np.random.default_rng(14)
    t = np.sort(rng.integers(0, 3000, 400)).tolist()
    r = spark.createDataFrame([(i, x, "a") for i, x in enumerate(t)] + [(9000, 5, None)], "seq long, stamp_us long, topic string")
    o = spark.createDataFrame([(i, int(x), "a", float(x)) for i, x in enumerate(rng.choice([*range(0, 900), *range(2000, 2100)], 60, replace=False))] + [(70, 7, None, 7.0)], "seq long, stamp_us long, topic string, v double")
    stamps = np.array(sorted(x.stamp_us for x in o.filter("topic = 'a'").collect()))
    got = {x.key: x.other_stamp for x in timeseries.nearest_offsets(r, o, "topic", run=run).collect()}
    last = {x.key: x.v for x in timeseries.latest_value(r, o, "topic", "v", run=run).collect()}
    assert got.pop(9000) == 7 and last.pop(9000) is None
    for i, x in enumerate(t):
        assert got[i] == min(stamps.tolist(), key=lambda s: (abs(s - x), s))
        before = stamps[stamps <= x]
        assert last[i] == (float(before[-1]) if len(before) else None)
    rolled = timeseries.in_runs(r.filter("topic = 'a'"), "topic", "seq", 4, 10)
    parts = rolled[0].withColumn("own", rolled[1]).collect()
    assert sorted(p.seq for p in parts if p.own) == list(range(400)) and sum(not p.own for p in parts) == 39 * 4


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "SKETCH", 20)
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 1, 3000), np.zeros(800), rng.exponential(1e6, 200)])
    rows = [(int(k % 3), float(v)) for k, v in enumerate(x)] + [(7, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in timeseries.quantiles(df, ("g",), {"a": (F.col("v"), 0.5), "b": (F.abs("v"), 0.95), "c": (F.col("v"), 0.0), "d": (F.col("v"), 1.0)}).collect()}
    for g in range(3):
        v = x[g::3]
        assert np.allclose([got[g].a, got[g].b, got[g].c, got[g].d], [np.quantile(v, 0.5), np.quantile(np.abs(v), 0.95), v.min(), v.max()], rtol=1e-12)
    assert got[7].a == got[7].b == 1.5 and 8 not in got


def test_suppression_and_masks(spark):
    boxes = spark.createDataFrame([(1, 0, 1, 0.9, 0, 0, 10, 10), (1, 1, 2, 0.8, 1, 1, 10, 10), (1, 2, 3, 0.7, 30, 30, 5, 5), (2, 3, 1, 0.5, 0, 0, 10, 10)], "image_id long, det_idx long, class_id int, confidence double, x int, y int, w int, h int")
    assert sorted(r.det_idx for r in camera.suppress(boxes, 0.45).collect()) == [0, 2, 3]
    assert [(r.det_a, r.det_b) for r in camera.iou_pairs(boxes).collect()] == [(0, 1)]
    m = {(r.v, r.u): r.class_id for r in camera.class_map(boxes.filter("image_id = 1")).collect()}
    assert m[5, 5] == 1 and m[10, 10] == 2 and m[31, 31] == 3 and (20, 20) not in m
    assert camera.clip_boxes(boxes.withColumn("x", F.lit(99)), 64, 48).filter("w > 0").count() == 0


def test_quaternions(spark):
    rng = np.random.default_rng(10)
    q = rng.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "i long, qx double, qy double, qz double, qw double")
    back = g.matrix_quaternion(g.quaternion_matrix("qx", "qy", "qz", "qw"))
    for r in df.select("i", *[c.alias(n) for n, c in zip("xyzw", back, strict=True)]).collect():
        assert abs(abs(np.dot(q[r.i], [r.x, r.y, r.z, r.w])) - 1) < 1e-9
    assert g.rpy_matrix(0, 0, 0) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    a, b, c = 0.3, -0.5, 1.1
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    assert np.allclose(g.rpy_matrix(a, b, c), rz @ ry @ rx)
    with pytest.raises(ValueError):
        g.unit((0, 0, 0))


FIELDS = [{"name": "x", "offset": 0, "datatype": 7, "count": 1}, {"name": "y", "offset": 4, "datatype": 7, "count": 1}, {"name": "z", "offset": 8, "datatype": 7, "count": 1}, {"name": "", "offset": 12, "datatype": 2, "count": 4}, {"name": "ring", "offset": 16, "datatype": 4, "count": 1}, {"name": "cov", "offset": 20, "datatype": 7, "count": 2}]


@pytest.mark.parametrize("big", [False, True])
def test_clouds_decode(spark, big):
    dtype = cloud.layout_dtype(FIELDS, 28, big)
    a = np.zeros(6, dtype)
    a["x"], a["ring"], a["cov"] = np.arange(6), 65_000 + np.arange(6), [[1, 2]] * 6
    line = a.tobytes()
    padded = line[: 28 * 3] + b"\0" * 8 + line[28 * 3 :] + b"\0" * 8
    df = spark.createDataFrame([(1, 2, 3, 28 * 3 + 8, padded), (2, 0, 0, 0, b"")], "frame long, height int, width int, row_step int, data binary")
    got = cloud.decode_clouds(df, FIELDS, 28, big).orderBy("point_idx").collect()
    assert [r.x for r in got] == list(range(6)) and got[5].ring == 65_005 and got[0].cov == [1.0, 2.0] and len(got) == 6
    with pytest.raises(ValueError):
        cloud.decode_buffer(padded[:-20], dtype, 2, 3, 28 * 3 + 8)


@pytest.mark.parametrize("fields, step", [([FIELDS[0]], 0), ([FIELDS[0], FIELDS[0]], 28), ([{"name": "x", "offset": 26, "datatype": 7}], 28), ([{"name": "x", "offset": 0, "datatype": 9}], 28)])
def test_bad_layouts(fields, step):
    with pytest.raises(ValueError):
        cloud.layout_dtype(fields, step)


def test_bags(spark, tmp_path):
    for n in range(2):
        db = sqlite3.connect(tmp_path / f"b_{n}.db3")
        db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/a", "A"), (2, "/b", "B"), (3, "/none", "N")])
        head = b"\0\x01\0\0" + struct.pack("<iI", 100 + n, 5)
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, 1 + i % 2, i, head) for i in range(6)])
        db.commit()
        db.close()
    bag.register(spark)
    m = spark.read.format("bag").option("messages", 4).load(str(tmp_path))
    assert {(r.topic, r.type, r.n) for r in bag.topics(spark, str(tmp_path)).collect()} == {("/a", "A", 6), ("/b", "B", 6), ("/none", "N", 0)}
    assert m.rdd.getNumPartitions() == 4 and [r.id for r in m.filter(F.col("file").endswith("b_0.db3")).collect()] == [0, 1, 2, 3, 4, 5]
    some = m.filter("topic = '/a'")
    assert some.count() == 6 and {r[0] for r in some.select(cloud.header_stamp_ns()).collect()} == {100_000_000_005, 101_000_000_005}
    assert cloud.header_stamp(b"\0\0\0\0" + struct.pack(">iI", 7, 8)) == (7, 8)
    made = str(tmp_path / "made")
    bag.write_bags(m.filter(F.col("file").endswith("b_0.db3")), bag.topics(spark, str(tmp_path)), made, 2)
    back = spark.read.format("bag").load(made)
    assert sorted((r.id, r.topic, r.timestamp) for r in back.collect()) == [(i, "/ab"[0] + "ab"[i % 2], i) for i in range(6)] and bag.topics(spark, made).count() == 3
    with pytest.raises(FileNotFoundError):
        bag.find_bags(str(tmp_path / "none"))


def test_neighbours_of_strays_and_points_that_are_not_finite(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.uniform(-1, 1, (300, 3)), [[5e5, 0, 0]], [[NAN, 0, 0]], [[0, math.inf, 0]]])
    p = frame(spark, x.tolist()).withColumn("frame", (F.col("pid") % 2).cast("long"))
    got = {}
    for r in neighbors.knn(p, p, 3).collect():
        got.setdefault(r.q, []).append((r["rank"], r.p))
    assert set(got) == set(range(301))
    for i in range(301):
        same = [j for j in range(i % 2, 301, 2)]
        d = ((x[same] - x[i]) ** 2).sum(1)
        assert [p for _, p in sorted(got[i])] == [same[j] for j in np.argsort(d, kind="stable")[:3]]
    few = frame(spark, [(0, 0, 0), (1, 1, 1), (NAN, 1, 1)])
    assert sorted((r.q, r.p) for r in neighbors.knn(few, few, 20, include_self=False).collect()) == [(0, 1), (1, 0)]
    assert [r.pid for r in neighbors.statistical_outliers(few, 20).filter("NOT kept").collect()] == [2]
    far = frame(spark, [(100, 0, 0)])
    assert [r.p for r in neighbors.knn(far, few, 1).collect()] == [1]


def test_axes_of_lines_and_balls(spark):
    line = {"xx": 4.0, "xy": 2.0, "xz": 0.0, "yy": 1.0, "yz": 0.0, "zz": 0.0}
    rows = [tuple(line.values()), (1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (0.0,) * 6, (2.0, 0.0, 0.0, 3.0, 0.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{m} double" for m in line))
    got = {r.i: r.normal for r in g.with_eigen(df, {m: F.col(m) for m in line}).collect()}
    along = np.array([2.0, 1, 0]) / math.sqrt(5)
    assert abs(np.dot(got[0], along)) < 1e-6 and abs(np.linalg.norm(got[0]) - 1) < 1e-9
    assert got[1] == [0, 0, 1] and got[2] is None and np.allclose(np.abs(got[3]), [0, 0, 1])


def test_fits_do_not_depend_on_order_and_count_their_draws(spark):
    s = scene(spark, np.random.default_rng(12), n=600)
    a, b = (planes.planes(x, max_iterations=100).first() for x in (s, s.orderBy(F.desc("z")).repartition(5)))
    assert np.allclose(list(a)[1:7], list(b)[1:7]) and a.status == "ok" and 1 <= a.iterations <= 100 and a.iterations == b.iterations
    noise = frame(spark, np.random.default_rng(13).uniform(-5, 5, (400, 3)).tolist())
    assert planes.planes(noise, max_iterations=100, min_inliers=3).first().iterations == 100


def test_upright_box_of_a_turned_plan_is_exact():
    square = np.array([(0, 0), (2, 1), (1, 3), (-1, 2)], float)
    assert np.allclose(clusters.plan_direction(square), np.array([2, 1]) / math.sqrt(5))
    assert clusters.plan_direction(np.array([[1.0, 1.0]])).tolist() == [1, 0] and np.allclose(clusters.plan_direction(np.array([[0.0, 0], [0, 3]])), [1, 0])


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    from terrafold.session import scratch_path
    from terrafold.streaming import maps

    source, out, place = str(tmp_path / "in"), scratch_path(spark, "rows"), scratch_path(spark, "stream")
    schema = "user_id long, seq long, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for part in ([(1, 1, 1.0), (2, 2, 2.0)], [(1, 4, 4.0), (1, 3, 3.0)], [(2, 5, 5.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        found = maps.collected(maps.with_previous(stream, "user_id", "seq", "value"), path=out, checkpoint=place)
    assert sorted((r.seq, r.previous, r.previous_value) for r in found.collect()) == [(1, None, None), (2, None, None), (3, 1, 1.0), (4, 3, 3.0), (5, 2, 2.0)]
    seen: list = []
    counts = stream.groupBy("user_id").count()
    q = maps.publish(counts, lambda df, batch: seen.append({r.user_id: r["count"] for r in df.collect()}), scratch_path(spark, "stream"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == {1: 3, 2: 2} and len(seen) == 3


def test_rows_without_an_order_come_first_and_stay(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", None, 9.0), (None, 5, 5.0), (None, None, 6.0), ("a", 3_000_000, 3.0)]
    df = spark.createDataFrame(rows, "topic string, seq long, v double")
    assert timeseries.every_nth(df, 1, "topic", "seq").count() == 6 and timeseries.rolling(df, 2, "v", "topic", "seq").count() == 6 and timeseries.with_steps(df.withColumn("stamp_us", F.col("seq"))).count() == 6
    got = {(r.topic, r.seq): r.received for r in timeseries.every_nth(df, 1, "topic", "seq").collect()}
    assert got == {("a", None): 1, ("a", 1): 2, ("a", 2): 3, ("a", 3_000_000): 4, (None, None): 1, (None, 5): 2}
    assert {(r.topic, r.seq): r.age for r in timeseries.last_n(df, 3, "topic", "seq").collect()} == {("a", 3_000_000): 1, ("a", 2): 2, ("a", 1): 3, (None, 5): 1, (None, None): 2}
    assert timeseries.last_n(df, 9, "topic", "seq").count() == 6


def test_far_boxes_and_null_images_are_painted_by_tiles(spark):
    kind = "image_id long, det_idx int, class_id int, confidence double, x int, y int, w int, h int"
    big = (1 << 53) + 1
    rows = [(1, 0, 1, 0.5, -5, 0, 10, 10), (1, 1, 2, 0.6, 40_000, 40_000, 10, 10), (None, 0, 3, 0.5, 0, 0, 3, 3), (None, 1, 4, 0.9, 2, 2, 2, 2), (big, 0, 5, 0.5, 60, 60, 10, 1), (big - 1, 0, 6, 0.5, 60, 60, 10, 1)]
    got = [tuple(r) for r in camera.class_map(spark.createDataFrame(rows, kind)).collect()]
    count = lambda i: sum(g[0] == i for g in got)
    assert [count(i) for i in (1, None, big, big - 1)] == [200, 12, 10, 10] and len(set(got)) == len(got) == 232
    assert (None, 2, 2, 4, 0.9) in got and (1, 0, -5, 1, 0.5) in got


def test_suppression_is_greedy_in_long_chains(spark):
    rng = np.random.default_rng(14)
    rows = [(i % 3 or None, i, 1, float(rng.integers(1, 30)) / 30, int(rng.integers(0, 200)), int(rng.integers(0, 60)), 20, 20) for i in range(400)]
    rows += [(9, i, 1, 0.9 - i / 100, 5 * i, 0, 20, 20) for i in range(30)] + [(9, 99, 1, 0.1, 5, 5, 0, 4)]
    df = spark.createDataFrame(rows, "image_id int, det_idx int, class_id int, confidence double, x int, y int, w int, h int")
    want = set()
    for image in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[3], r[1])):
            over = lambda a, b: max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])) * max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
            if not any(over(r, o) / (r[6] * r[7] + o[6] * o[7] - over(r, o)) > 0.45 for o in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert {(r.image_id, r.det_idx) for r in camera.suppress(df).collect()} == want


def test_upright_boxes_stand_along_any_direction(spark):
    rng = np.random.default_rng(41)
    corners = np.array([(x, y, z) for x in (-2, 2) for y in (-0.5, 0.5) for z in (-1.5, 1.5)])
    p = np.vstack([corners, rng.uniform(-1, 1, (100, 3)) * [2, 0.5, 1.5]])
    turn = registration.small_motion(np.array([0.7, -0.4, 0.5, 3.0, 1.0, -2.0]))
    c = frame(spark, (p @ turn[:3, :3].T + turn[:3, 3]).tolist()).withColumn("cluster_id", F.lit(0))
    up = tuple((2.5 * turn[:3, 2]).tolist())
    box = clusters.boxes(c, "upright", up=up).first()
    assert np.allclose(sorted(box.extent), [1, 3, 4], atol=1e-6) and abs(box.extent[2] - 3) < 1e-6 and np.allclose(box.center, turn[:3, 3], atol=1e-6)
    r = np.array(box.rotation)
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0 and np.allclose(r[:, 2], turn[:3, 2])
    assert clusters.boxes(c, "upright").first().volume > box.volume


@pytest.mark.parametrize("tiles", [1, 3, 1024])
def test_class_maps_are_those_of_plain_painting(spark, monkeypatch, tiles):
    """Tiles that go over batches, several tiles of an image, ties of boxes and masks: pixel by pixel."""
    monkeypatch.setattr(camera, "TILES", tiles)
    rng = np.random.default_rng(23)
    boxes = [(int(i) if i else None, k, int(rng.integers(0, 5)), float(rng.integers(1, 5)) / 4, *map(int, rng.integers(-10, 150, 2)), *map(int, rng.integers(0, 90, 2))) for k, i in enumerate(rng.integers(0, 4, 60))]
    masks = [(b[0], b[1], b[5] + 1, b[4] + 2, 1.0 if b[1] % 2 else 1.25) for b in boxes if b[0] is not None]
    plain, order = {}, {}
    for i, k, c, s, x, y, w, h in boxes:
        for v in range(y, y + h):
            for u in range(x, x + w):
                if order.get((i, v, u), (-1,)) < (s, 1, -k):
                    order[i, v, u], plain[i, v, u] = (s, 1, -k), (c, s)
    df = spark.createDataFrame(boxes, "image_id long, det_idx long, class_id int, confidence double, x int, y int, w int, h int")
    got = [tuple(r) for r in camera.class_map(df).collect()]
    assert len(got) == len(plain) and {g[:3]: g[3:] for g in got} == plain
    by_id = {(b[0], b[1]): b for b in boxes}
    for i, k, v, u, weight in masks:
        s = by_id[i, k][3] * weight
        if order.get((i, v, u), (-1,)) < (s, 0, -k):
            order[i, v, u], plain[i, v, u] = (s, 0, -k), (by_id[i, k][2], s)
    found = camera.masked_class_map(df, spark.createDataFrame(masks, "image_id long, det_idx long, v int, u int, weight double"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(plain) and {g[:3]: g[3:] for g in got} == plain
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_nearest_within_a_radius_is_that_of_all_pairs(spark):
    from terrafold.operators import neighbors as nb

    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.2, (1500, 3)), rng.uniform(-3, 3, (300, 3)), [[0.5, 0.0, 0.0], [-0.5, 0.0, 0.0], [9.0, 9.0, 9.0]]])
    rows = [(i, int(i % 2), *map(float, r)) for i, r in enumerate(x)] + [(5000, 0, float("nan"), 0.0, 0.0), (5001, 1, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "pid long, frame long, x double, y double, z double")
    q = p.withColumn("pid", F.col("pid") + 10_000).withColumn("x", F.col("x") + 0.05).unionByName(spark.createDataFrame([(1, 0, 9.5, 9.0, 9.0), (2, 0, 9.6, 9.0, 9.0)], p.schema))
    pairs = nb.radius_join(q, p, 0.5)
    want = pairs.groupBy("q_pid").agg(F.min_by(F.struct("p_pid", "d2"), F.struct("d2", "p_pid")).alias("b")).select("q_pid", "b.*")
    want = {(r.q_pid, r.p_pid, r.d2) for r in want.collect()}
    assert pairs.count() > 100 * len(want) > 100_000
    for block in (nb.BLOCK, 200, 10):
        nb.BLOCK, was = block, nb.BLOCK
        try:
            got = nb.nearest_finder(p, 0.5)(q).select("q_pid", "p_pid", "d2").collect()
        finally:
            nb.BLOCK = was
        assert len(got) == len(want) and {tuple(r) for r in got} == want
