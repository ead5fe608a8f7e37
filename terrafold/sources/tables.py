"""The model tables, as views of the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """pid, frame, x, y, z, intensity, class_id, confidence, of embeddings."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("pid"), (F.col("vec_id") % 10).alias("frame"), (e(0) * 10).alias("x"), (e(1) * 10).alias("y"), (e(2) * 10).alias("z"),
        F.abs(e(3)).alias("intensity"), F.col("label").alias("class_id"), F.least(F.abs(e(4)) * 4, F.lit(1.0)).alias("confidence"),
    )


def raw_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points with returns missing: pid % 17 = 0 lies at the origin, else pid % 23 = 0 has no x."""
    zero, none = F.col("pid") % 17 == 0, F.col("pid") % 23 == 0
    p = points(spark, folder)
    return p.withColumns({"x": F.when(zero, 0.0).when(none, float("nan")).otherwise(F.col("x")), "y": F.when(zero, 0.0).otherwise(F.col("y")), "z": F.when(zero, 0.0).otherwise(F.col("z"))})


def bulk_points(spark: SparkSession, folder: str) -> DataFrame:
    """frame, x, y, z, intensity of line items: many rows, no key."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2500).alias("y"),
        ((F.col("l_discount") + F.col("l_tax")) * 10).alias("z"), F.col("l_extendedprice").alias("intensity"),
    )


def stamps(spark: SparkSession, folder: str) -> DataFrame:
    """seq, stamp_us, user_id, topic, value of events; the stamp in microseconds, so no step of it is lost."""
    return table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("stamp_us"), "user_id", F.col("event_type").alias("topic"), "value")
