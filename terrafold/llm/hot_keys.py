"""Joins on keys of which a few hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are split, at most: one is if it holds more than this part of all rows, so there are fewer of them than that.
KEYS_SPLIT = 4096
#: Rows of a key that are never too many.
ROWS_LEAST = 500


def join_split(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``, which is never null and unique in ``table``; ``sizes``: (key, n), the rows of each key, of ``total``.

    A key that holds more than its share of the rows is dealt into parts, and its row of ``table`` into as many copies. The
    keys so dealt are fewer than KEYS_SPLIT at any size, so they are broadcast. ``rows`` should be a written table: its parts go by place in it.
    """
    most = max(ROWS_LEAST, total // KEYS_SPLIT)
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(F.col(key), F.ceil(F.col("n") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.withColumn("__at", F.monotonically_increasing_id()).join(hot, key, "left").withColumn("__part", F.pmod(F.col("__at"), parts).cast("int")).drop("__at", "__parts")
    right = table.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"], "left").drop("__part")
