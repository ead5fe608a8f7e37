"""Live bags: what is added is read once, written files appear whole or not at all."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from terrafold.session import scratch_path
from terrafold.sources import bag
from terrafold.streaming.maps import collected


def grow(path, ids, topic=1):
    new = not os.path.exists(path)
    db = sqlite3.connect(path)
    if new:
        db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/a", "A"), (2, "/b", "B")])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, topic, i, b"x") for i in ids])
    db.commit()
    db.close()


def test_a_bag_that_grows_is_read_on_without_repeats(spark, tmp_path):
    bag.register(spark)
    folder, rows, place = str(tmp_path), scratch_path(spark, "rows"), scratch_path(spark, "stream")
    stream = lambda: spark.readStream.format("bag").option("messages", 3).load(folder)
    grow(f"{folder}/one.db3", range(5))
    assert sorted(r.id for r in collected(stream(), path=rows, checkpoint=place).collect()) == list(range(5))
    grow(f"{folder}/one.db3", range(10, 14), topic=2)
    grow(f"{folder}/two.db3", [7, 10**15, 5 * 10**17])  # ids that are stamps
    assert sorted((os.path.basename(r.file), r.id, r.topic) for r in collected(stream(), path=rows, checkpoint=place).collect()) == sorted(
        [("one.db3", i, "/a") for i in range(5)] + [("one.db3", i, "/b") for i in range(10, 14)] + [("two.db3", i, "/a") for i in (7, 10**15, 5 * 10**17)]
    )
    assert collected(stream(), path=rows, checkpoint=place).count() == 12


def test_partitions_follow_messages_not_the_span_of_ids(spark, tmp_path):
    grow(f"{tmp_path}/far.db3", [i * 10**14 for i in range(10)])
    bag.register(spark)
    df = spark.read.format("bag").option("messages", 4).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 10
    assert df.filter("topic IN ('/b')").count() == 0


def test_a_stream_is_written_by_batches(spark, tmp_path):
    bag.register(spark)
    source, target = f"{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "id long, topic string, timestamp long, data binary"
    for part in ([(1, "/a", 1, b"1"), (2, "/b", 2, b"2")], [(3, "/a", 3, b"3")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    place = scratch_path(spark, "stream")
    for _ in range(2):  # run again, it adds nothing
        q = stream.writeStream.format("bag").option("path", target).option("topics", '[["/a", "A"], ["/b", "B"], ["/c", "C"]]').option("checkpointLocation", place).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.id, r.topic, r.type) for r in spark.read.format("bag").load(target).collect()} == {(1, "/a", "A"), (2, "/b", "B"), (3, "/a", "A")}
    assert {(r.topic, r.n) for r in bag.topics(spark, target).collect()} == {("/a", 2), ("/b", 1), ("/c", 0)}
    assert all(not n.startswith("_") for n in os.listdir(f"{tmp_path}/out"))


def test_a_write_that_fails_shows_nothing(spark, tmp_path):
    bag.register(spark)
    rows = spark.range(20).select("id", F.when(F.col("id") == 13, "/unknown").otherwise("/a").alias("topic"), F.col("id").alias("timestamp"), F.lit(b"x").alias("data"))
    with pytest.raises(Exception):
        bag.write_bags(rows, spark.createDataFrame([("/a", "A")], "topic string, type string"), f"{tmp_path}/out", 4)
    assert not os.path.exists(f"{tmp_path}/out") or not [n for n in os.listdir(f"{tmp_path}/out") if n.endswith(".db3")]
    with pytest.raises(FileNotFoundError):
        bag.find_bags(f"{tmp_path}/out")
