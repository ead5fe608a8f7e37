"""Names of queries, the functions that make them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PTS = """pts AS (SELECT vec_id AS pid, vec_id % 10 AS frame, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z,
 abs(CAST(embedding[4] AS DOUBLE)) AS intensity, label AS class_id, least(abs(CAST(embedding[5] AS DOUBLE)) * 4, 1.0) AS confidence FROM embeddings)"""
RAW = PTS + """, raw AS (SELECT pid, frame, CASE WHEN pid % 17 = 0 THEN 0.0 WHEN pid % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x,
 CASE WHEN pid % 17 = 0 THEN 0.0 ELSE y END AS y, CASE WHEN pid % 17 = 0 THEN 0.0 ELSE z END AS z, intensity, class_id, confidence FROM pts),
fin AS (SELECT *, isfinite(x) AND isfinite(y) AND isfinite(z) AS ok, x * x + y * y + z * z AS s FROM raw)"""
BULK = "bulk AS (SELECT l_suppkey AS frame, l_quantity AS x, l_extendedprice / 2500 AS y, (l_discount + l_tax) * 10 AS z, l_extendedprice AS intensity FROM lineitem)"
ST = "st AS (SELECT event_id AS seq, epoch_us(ts) AS stamp_us, user_id, event_type AS topic, value FROM events)"


def query(sql: str | None = None):
    """Registers a query under its function's name; without SQL only its rows are checked."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Means of few decimals lie just between two roundings often; this much above, the order of adding does not decide.
NUDGE = 3e-9


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Sums of floats depend on their order: columns rounded, on both sides alike, with no negative zero."""
    return df.withColumns({c: r6(F.col(c) + nudge if nudge else F.col(c), digits) for c in columns})


def r6(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)
