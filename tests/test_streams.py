"""Streams of several batches: order, lateness, restarts, rings, maps by version."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrafold.operators.semantic_map import evidence_map
from terrafold.session import scratch_path
from terrafold.streaming import keyed, maps
from terrafold.streaming.store import MapStore

HOUR = 3_600_000_000
EVENTS = "user_id long, seq long, value double, stamp_us long"


def batches(spark, *parts, end=True, schema=EVENTS, path=None):
    path = path or scratch_path(spark, "in")
    last = [(None,) * (len(schema.split(",")) - 1) + (keyed.END_US,)] if end else []
    for part in (*parts, *([last] if end else [])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rows_wait_for_the_watermark_and_late_ones_are_told(spark):
    stream = batches(
        spark, [(1, 1, 1.0, 10 * HOUR), (1, 3, 3.0, 12 * HOUR), (2, 2, None, 11 * HOUR)], [(1, 2, 2.0, 11 * HOUR), (2, 5, 5.0, 14 * HOUR)], [(1, 4, 4.0, 13 * HOUR), (2, 4, 4.0, 9 * HOUR), (None, 9, 1.0, 13 * HOUR)]
    )
    rows = maps.collected(maps.with_previous(stream, "user_id", "seq", "value", "stamp_us", "2 hours"), "update").collect()
    got = sorted((r.user_id or 0, r.seq, r.previous, r.previous_value, r.late) for r in rows)
    assert got == [(0, 9, None, None, False), (1, 1, None, None, False), (1, 2, 1, 1.0, False), (1, 3, 2, 2.0, False), (1, 4, 3, 3.0, False), (2, 2, None, None, False), (2, 4, None, None, True), (2, 5, 2, None, False)]


def test_evidence_of_shuffled_batches_is_that_of_the_table(spark):
    rng = np.random.default_rng(5)
    schema = "x double, y double, z double, class_id int, confidence double, stamp_us long"
    rows = [(float(x), float(y), 1e8 + float(z), int(c), float(k), int(t) * HOUR) for x, y, z, c, k, t in zip(*rng.uniform(0, 1, (3, 300)), rng.integers(-1, 4, 300), rng.uniform(-0.2, 1.2, 300), rng.integers(100, 200, 300), strict=True)]
    table = spark.createDataFrame(rows, schema)
    want = {(r.ix, r.iy, r.iz): r for r in evidence_map(table, 0.5, 5, tau=86_400.0).collect()}
    parts = [rows[i::6] for i in range(6)]
    for delay in (None, "200 hours"):
        stream = batches(spark, *parts, schema=schema)
        got = maps.latest(maps.collected(maps.evidence_stream(stream, 0.5, 5, tau=86_400.0, delay=delay), "update"), "ix", "iy", "iz").collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r.ix, r.iy, r.iz]
            assert (r.class_id, r.observations, r.late) == (w.class_id, w.observations, 0) and abs(r.posterior - w.posterior) < 1e-9
            assert abs(r.var_z - w.var_z) < 1e-6 and 0.005 < w.var_z < 0.04  # heights near 1e8 keep their spread


def test_late_observations_are_counted_and_change_nothing(spark):
    schema = "x double, y double, z double, class_id int, confidence double, stamp_us long"
    one = lambda c, h: (0.1, 0.1, 0.1, c, 0.9, h * HOUR)
    stream = batches(spark, [one(1, 10)], [one(1, 20)], [one(2, 11), one(2, 12)], [one(1, 30)], schema=schema)
    rows = maps.collected(maps.evidence_stream(stream, 1.0, 4, delay="2 hours"), "update")
    last = maps.latest(rows, "ix", "iy", "iz").first()
    assert (last.class_id, last.observations, last.late) == (1, 3, 2)


def test_a_ring_keeps_the_newest_as_they_came(spark):
    parts = [[(u, 10 * b + i, float(i), 0) for u in (1, 2) for i in range(5 if u == 1 else 1)] for b in range(4)]
    stream = batches(spark, *parts, end=False)
    got = maps.bounded(stream.select("user_id", "seq", "value"), 7, "user_id", "seq").collect()
    assert sorted(r.seq for r in got if r.user_id == 1) == [23, 24, 30, 31, 32, 33, 34] and sorted(r.seq for r in got if r.user_id == 2) == [0, 10, 20, 30]


def test_versions_of_a_map(spark):
    df = lambda rows: spark.createDataFrame(rows, "k long, v double")
    store = MapStore(spark, scratch_path(spark, "map"), df([]).schema, ["k"], ranges=8)
    store.apply(df([(i, 0.0) for i in range(100)]), 0)
    store.apply(df([(1, 1.0), (200, 1.0)]), 1)
    store.compact(1)
    store.apply(df([(1, 2.0), (None, 2.0)]), 2)
    store.apply(df([(1, 2.5)]), 2)  # a batch that is repeated replaces itself
    as_dict = lambda v=None: {r.k: r.v for r in store.read(v).collect()}
    assert as_dict(0) == dict.fromkeys(range(100), 0.0)
    assert as_dict(1) == dict.fromkeys(range(100), 0.0) | {1: 1.0, 200: 1.0}
    assert as_dict() == as_dict(1) | {1: 2.5}
    # A tick writes what it changed, compaction the ranges that changed.
    files = store._files()
    assert files.filter("kind = 'delta' AND version = 2").count() == 1
    before = as_dict()
    store.compact(2)
    touched = store._files().filter("kind = 'base' AND version = 2").select("range").distinct().count()
    assert touched == 1 and as_dict() == before
    store.vacuum(2)
    assert as_dict() == before


def test_latest_goes_by_number_where_stamps_start_again(spark, tmp_path):
    """Events of one user from two recorders, numbered on, with the same stamps: the SQL's order is the number."""
    import datetime

    import duckdb

    import __spark_entry__

    at = datetime.datetime(2024, 1, 1)
    rows = [(100 * r + i, at + datetime.timedelta(hours=i), None if i % 13 == 5 else 1, ("view", "click")[i % 2], float(r * 100 + i)) for r in range(2) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.user_id or 0, r.seq, r.latest) for r in __spark_entry__.queries()["streaming_latest"](spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted((u or 0, s, v) for u, s, v in duckdb.sql(f"SELECT user_id, seq, latest FROM ({__spark_entry__.oracle_sql()['streaming_latest']})").fetchall())
    assert got == want and len(want) > 20


def test_keys_are_folded_by_buckets(spark):
    """Many keys make few calls to the state: as many pieces reach it as buckets, whatever the number of keys."""
    rows = spark.range(5000).selectExpr("id AS user_id", "id AS seq", "1.0D AS value", "id AS stamp_us").coalesce(1)
    dealt = rows.select((F.col("user_id") % keyed.BUCKETS).cast("int").alias("bucket"), *rows.columns)
    assert dealt.mapInArrow(keyed._packed, "bucket int, rows binary").count() == keyed.BUCKETS


def test_a_ring_is_packed_anew_when_it_has_doubled(spark, monkeypatch):
    monkeypatch.setattr(keyed, "RING_ROWS", 4)
    parts = [[(u, 10 * b + i, None, 0) for u in (1, None) for i in range(5)] for b in range(4)]
    got = maps.bounded(batches(spark, *parts, end=False).select("user_id", "seq", "value"), 7, "user_id", "seq").collect()
    for u in (1, None):
        assert sorted(r.seq for r in got if r.user_id == u) == [23, 24, 30, 31, 32, 33, 34]


def test_state_lies_in_few_partitions_however_many_tables_are_shuffled_to(spark):
    """Each batch opens and commits every partition of the state, so their number must not grow with that of the tables."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        place = scratch_path(spark, "stream")
        parts = [[(u, 10 * b + u, 1.0, b * HOUR) for u in range(6)] for b in range(2)]
        got = maps.collected(maps.every_nth_arrival(batches(spark, *parts), 2, "user_id", "seq", "stamp_us", "1 hours"), "update", checkpoint=place).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.user_id, r.seq, r.received) for r in got) == [(u, u, 1) for u in range(6)]
    assert {r.numPartitions for r in spark.read.format("state-metadata").load(place).collect()} == {16}


def test_batches_without_rows_do_not_shift_those_behind_them(spark):
    rows = spark.range(800).withColumn("b", F.when(F.col("id") % 4 > 0, F.col("id") % 4 + 2))
    got = maps.collected(maps.replayed(rows, F.col("b"), 8)).groupBy("batch").agg(F.collect_set("b").alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert [(r.b, r.n) for r in got] == [([3], 200), ([4], 200), ([5], 200)]


def test_the_ring_lies_in_few_partitions_too(spark, monkeypatch):
    places, path = [], maps.scratch_path
    monkeypatch.setattr(maps, "scratch_path", lambda s, name: places.append((name, path(s, name))) or places[-1][1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = maps.bounded(batches(spark, [(1, i, 1.0, 0) for i in range(9)], end=False).select("user_id", "seq", "value"), 2, "user_id", "seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.seq for r in got) == [7, 8]
    assert {r.numPartitions for r in spark.read.format("state-metadata").load(dict(places)["stream"]).collect()} == {16}


def test_a_ring_is_brought_only_the_newest_of_a_key(spark):
    """A user with most of the events: the task of the bucket gets a few of them from each part of a batch, not all; the ring is as before."""

    class Seen(keyed.RingFold):
        def settle(self, rows):
            yield pa.table({"held": pa.array([rows.num_rows], pa.int64())})

    rows = [[(None if i % 3 == 1 else 1, 10_000 * b + i, float(i), 0) for i in range(3000)] + [(2, 10_000 * b, None, 0)] for b in range(2)]
    stream = lambda: batches(spark, *rows, end=False).select("user_id", "seq", "value")
    seen = maps.collected(keyed.grouped(stream(), Seen(["user_id"], ["seq"], None, n=4), "held long", False), "update").agg(F.sum("held")).first()[0]
    assert 2 * (4 + 4 + 1) <= seen < 100  # of 6,002
    got = maps.bounded(stream(), 4, "user_id", "seq").collect()
    assert {u: sorted(r.seq for r in got if r.user_id == u) for u in (None, 1, 2)} == {None: [12989, 12992, 12995, 12998], 1: [12994, 12996, 12997, 12999], 2: [0, 10_000]}


def test_dealt_rows_are_brought_in_parts_batch_by_batch(spark):
    rows = maps.dealt(spark.range(800), F.col("id") % 4 * 2)
    path, out, place = (scratch_path(spark, n) for n in ("replay", "rows", "stream"))
    for part in (range(3), range(3, 8)):
        found = maps.collected(maps.brought(rows, part, path), "append", out, place)
    got = found.groupBy("batch").agg(F.collect_set(F.col("id") % 4 * 2).alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert [(r.b, r.n) for r in got] == [([0], 200), ([2], 200), ([4], 200), ([6], 200)]


def test_rows_are_numbered_by_key():
    code, at = keyed.numbered(np.array([5, 5, -1, 5, -1]), np.array([1, 2, 1, 1, 1]))
    assert code.tolist() == [0, 1, 2, 0, 2] and at.tolist() == [3, 1, 4]
