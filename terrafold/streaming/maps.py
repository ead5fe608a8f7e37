"""Live maps and streams: the same operators over what arrives, with state that Spark keeps by key."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from terrafold.functions.geometry import voxel_keys
from terrafold.operators.semantic_map import is_evidence
from terrafold.session import scratch_path
from terrafold.streaming import keyed

#: Rows of a file of a replayed batch, about.
FILE_ROWS = 500_000


def arriving(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A stream of the files of a table, at most so many a batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parquet*")


def dealt(rows: DataFrame, batch: Column) -> DataFrame:
    """``rows`` with their ``__batch``, written once by batch, so that each batch is told once and read once."""
    spark = rows.sparkSession
    path = scratch_path(spark, "dealt")
    rows.withColumn("__batch", batch.cast("int")).write.partitionBy("__batch").parquet(path)
    return spark.read.schema(StructType([*rows.schema.fields, StructField("__batch", IntegerType())])).parquet(path)


def brought(rows: DataFrame, batches: range, path: str | None = None, stamp: str | None = None) -> DataFrame:
    """A stream that brings ``batches`` of dealt rows one by one, in files below ``path``, and with ``stamp`` a last row that ends it (see ``keyed.END_US``).

    A batch is written as so many files, by the number of all rows, and read as as many: rounds of the cores, if more than a few. One of fewer rows than files comes together
    with rows of the next. Rows of no or another batch do not come, and a batch without rows has no file.
    """
    spark = rows.sparkSession
    path, fields = path or scratch_path(spark, "replay"), [f for f in rows.schema.fields if f.name != "__batch"]
    sizes = {r["__batch"]: r["count"] for r in rows.groupBy("__batch").count().collect() if r["__batch"] in batches}  # a row a batch
    files, cores = max(4, math.ceil(sum(sizes.values()) / max(1, len(sizes)) / FILE_ROWS)), spark.sparkContext.defaultParallelism
    files = files if files == 4 else math.ceil(files / cores) * cores
    for i in sorted(sizes) or batches[:1]:
        rows.filter(F.col("__batch") == i).drop("__batch").repartition(files).write.mode("append").parquet(path)
    if stamp:
        last = [F.lit(keyed.END_US if f.name == stamp else None).cast(f.dataType).alias(f.name) for f in fields]
        spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(StructType(fields)).option("maxFilesPerTrigger", files).parquet(path)


def replayed(rows: DataFrame, batch: Column, batches: int, path: str | None = None, stamp: str | None = None) -> DataFrame:
    """A stream that brings ``rows`` as ``batch`` (from 0) tells; see ``brought``."""
    return brought(dealt(rows, batch), range(batches), path, stamp)


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: two rounds of the cores at most, whatever number of partitions the session shuffles tables to.

    Each batch opens, folds and commits the state of each partition, also where it has no rows, and a stream keeps the number it started with.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(16, 2 * spark.sparkContext.defaultParallelism))


def started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """The stream that ``start`` starts, with ``state_partitions``: it takes the session's settings over when it starts, which are then as before."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions(spark)))
    try:
        return start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Runs a stream until what has arrived is read; batches go to ``write``, state and offsets to ``checkpoint``, a new place in the shared folder if not given.

    A stream that is run again with the checkpoint of an earlier run goes on where that ended.
    """
    place = checkpoint or scratch_path(stream.sparkSession, "stream")
    started(stream.sparkSession, stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start).awaitTermination()


def publish(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", mode: str = "complete") -> StreamingQuery:
    """A live query that gives its whole result to ``write`` on a timer, such as a map once a second; stop it by its handle, start it again with the same checkpoint."""
    return started(stream.sparkSession, stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start)


def snapshot(stream: DataFrame) -> DataFrame:
    """The last complete result of an aggregation over a stream, from the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, "snapshot")
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{batch}")
        last.append(batch)

    drain(stream, "complete", write)
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{path}/{last[-1]}")


def collected(stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All rows that a stream gives, with their ``batch``; a batch that is written again after a failure replaces itself. With ``path`` and ``checkpoint`` of an earlier run it adds to that."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "rows")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/part={batch}")

    drain(stream, mode, write, checkpoint)
    return spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/part=*")


def voxel_counts(points: DataFrame, size: float) -> DataFrame:
    """A growing map: per voxel observations, confidence, heights. Works on tables and streams alike."""
    return points.groupBy(*voxel_keys(size)).agg(F.count("*").alias("observations"), F.sum("confidence").alias("confidence_sum"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def bounded(stream: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The newest n rows of each key, as they came, of all that a stream brought; columns are numbers or strings.

    The state of a key is a ring of chunks in RocksDB; what is left in it when the stream has been read is taken from the state itself.
    """
    spark = stream.sparkSession
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    place = scratch_path(spark, "stream")
    fold = keyed.RingFold([by], [order], None, n=n)
    drain(keyed.grouped(stream, fold, "held long", False), "update", lambda df, batch: df.write.format("noop").mode("overwrite").save(), place)
    chunks = spark.read.format("statestore").option("stateVarName", "chunks").load(place)
    rows = keyed.unpacked(chunks.select(F.col("user_map_key.at").alias("at"), F.col("user_map_value.rows").alias("rows")), kinds)
    # The oldest chunks reach further back than n rows.
    newest = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("place"))
    return rows.withColumn("__age", F.row_number().over(newest)).filter(F.col("__age") <= n).select(*stream.columns)


def evidence_stream(observations: DataFrame, size: float, classes: int = 20, prior: float = 0.001, tau: float = 0.0, delay: str | None = None) -> DataFrame:
    """A voxel's class whenever its evidence changes, and how many of its observations came too ``late``. The state of a voxel is bounded by the number of classes; with a ``delay``, what comes further behind the newest stamp is late.

    Fading has a closed form, so what a voxel comes to
    does not depend on the order of those that are taken, and none waits for others: the table form, ``evidence_map``, gives the same.
    """
    by = ["ix", "iy", "iz"]
    fold = keyed.EvidenceFold(by, classes, prior, tau, delay is not None)
    rows = keyed.timed(observations, "stamp_us", delay, is_evidence(classes)).select(*voxel_keys(size), "class_id", F.least("confidence", F.lit(1.0)).alias("confidence"), "z", "stamp_us")
    return keyed.grouped(rows, fold, keyed.EVIDENCE, delay is not None)


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last row of each key by batch."""
    w = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "batch")


# Streams whose rows depend on those of their key before them.


def with_previous(stream: DataFrame, by: str, order: str, value: str, stamp: str | None = None, delay: str | None = None) -> DataFrame:
    """by, order, value (a number), those of the row of its key before it, ``previous`` and ``previous_value`` (the first row of a key has none), and whether it came too ``late`` to be told."""
    out = f"{by} long, {order} long, {value} double, previous long, previous_value double, late boolean"
    return _in_order(stream, by, keyed.PreviousFold, [(order, "long"), (value, "double")], [order], stamp, delay, out)


def every_nth_arrival(stream: DataFrame, n: int, by: str, order: str, stamp: str | None = None, delay: str | None = None) -> DataFrame:
    """by, order, received: the first row of each key and every n-th after it; late rows do not count."""
    return _in_order(stream, by, keyed.EveryNthFold, [(order, "long")], [order], stamp, delay, f"{by} long, {order} long, received long", n=n)


def with_latest(stream: DataFrame, by: str, order: str, is_side: str, value: str, stamp: str | None = None, delay: str | None = None, by_order: bool = False) -> DataFrame:
    """by, order, latest: the rows of a stream that are not of the side input (``is_side``), each with the value of the side row of its key that came last before it, by ``stamp`` and order.

    ``by_order``: by order alone, which stamps need not follow. No watermark then tells that a row can have no other before it, so rows that are not late wait in the state for the stream's end.
    """
    return _in_order(stream, by, keyed.LatestFold, [(order, "long"), (is_side, "boolean"), (value, "double")], [order, "__after"], stamp, delay, f"{by} long, {order} long, latest double", by_order)


def _in_order(stream: DataFrame, by: str, fold: type, fields: list[tuple[str, str]], order: list[str], stamp: str | None, delay: str | None, out: str, by_order: bool = False, **more) -> DataFrame:
    """``stamp`` (microseconds) and ``delay`` tell how long rows are waited for; without them the batches themselves must be in order."""
    if delay is not None and stamp not in [f for f, _ in fields]:
        fields = [*fields, (stamp, "long")]
    rows = (stream if delay is None else keyed.timed(stream, stamp, delay)).select(F.col(by).cast("long"), *[F.col(f).cast(k) for f, k in fields])
    timed = delay is not None
    return keyed.grouped(rows, fold([by], [stamp, *order] if timed and not by_order else order, stamp if timed else None, by_order and timed, **more), out, timed)
