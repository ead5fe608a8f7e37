"""A versioned map in files: each version writes the rows that it changed, ranges of keys are compacted on their own, any version can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrafold.session import scratch_path
from terrafold.streaming.maps import drain

#: Ranges that the keys of a map are dealt to.
RANGES = 64


class MapStore:
    """Rows by key below ``path``, in ``kind=delta`` and ``kind=base`` folders by version and range.

    Writing a version again replaces it, so a batch that is repeated after a failure changes nothing. Compacting
    touches the ranges that have changed since they were compacted last, and no others. Keys are never removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], ranges: int = RANGES):
        self.spark, self.path, self.schema, self.key, self.ranges = spark, path.rstrip("/"), schema, key, ranges

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        dealt = rows.withColumn("range", F.pmod(F.xxhash64(*self.key), F.lit(self.ranges)).cast("int"))
        dealt.repartition("range").write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/kind={kind}/version={version}")

    def _files(self) -> DataFrame:
        typed = StructType.fromDDL("kind string, version long, range int").fields
        return self.spark.read.schema(StructType([*self.schema.fields, *typed])).option("basePath", self.path).parquet(self.path)

    def _parts(self, version: int | None) -> DataFrame:
        """range, base (the version of its newest base, -1 if none), newest: one row a range."""
        at = self._files().select("kind", "version", "range")
        at = at if version is None else at.filter(F.col("version") <= version)
        return at.groupBy("range").agg(F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("version"))), F.lit(-1)).alias("base"), F.max("version").alias("newest"))

    def apply(self, changed: DataFrame, version: int) -> None:
        """Stores the rows that are new in ``version`` (from 0), one for each key."""
        self._write(changed.select(self.schema.names), "delta", version)

    def read(self, version: int | None = None) -> DataFrame:
        """The map as it was in a version, or as it is."""
        return self._latest(self._parts(version), version).select(self.schema.names)

    def _latest(self, parts: DataFrame, version: int | None) -> DataFrame:
        rows = self._files() if version is None else self._files().filter(F.col("version") <= version)
        held = rows.join(F.broadcast(parts.select("range", "base")), "range")  # as many rows as ranges
        held = held.filter((F.col("version") > F.col("base")) | ((F.col("version") == F.col("base")) & (F.col("kind") == "base")))
        rest: list[Column] = [F.col(c) for c in self.schema.names if c not in self.key]
        # The base of a version holds what its delta does.
        newest = held.groupBy(*self.key, "range").agg(F.max_by(F.struct(*rest), F.col("version")).alias("row"))
        return newest.select(*self.key, "range", "row.*")

    def compact(self, version: int) -> None:
        """One base in place of base and deltas, for ranges with deltas behind their base, up to ``version``."""
        parts = self._parts(version).filter(F.col("newest") > F.col("base"))
        self._write(self._latest(parts, version).select(self.schema.names), "base", version)

    def vacuum(self, version: int) -> None:
        """Removes what no version from ``version`` on needs: deltas and bases before the oldest base that is read then."""
        oldest = self._parts(version).agg(F.min("base")).first()[0]
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind in ("delta", "base"):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/kind={kind}")
            for status in fs.listStatus(folder) if oldest is not None and oldest > 0 and fs.exists(folder) else []:
                at = int(status.getPath().getName().split("=")[1])
                if at < oldest or (kind == "delta" and at == oldest):
                    fs.delete(status.getPath(), True)


def stored(stream: DataFrame, key: list[str], path: str | None = None, checkpoint: str | None = None, compact_every: int = 8) -> MapStore:
    """Runs a stream of changed rows, such as an aggregation, into a store; its batches are the versions. With ``path`` and ``checkpoint`` of an earlier run it goes on with that."""
    spark = stream.sparkSession
    store = MapStore(spark, path or scratch_path(spark, "map"), stream.schema, key)

    def write(df: DataFrame, batch: int) -> None:
        store.apply(df, batch)
        if (batch + 1) % compact_every == 0:
            store.compact(batch)

    drain(stream, "update", write, checkpoint)
    return store
