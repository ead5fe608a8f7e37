"""Queries on streams in time: topics, steps and gaps, nearest and latest stamps, rolling windows, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import timeseries as ts
from terrafold.plans.registry import ST, query, rounded
from terrafold.sources.tables import stamps


@query("SELECT event_type AS topic, 'event' AS type, count(*) AS n FROM events GROUP BY event_type")
def topic_catalog(spark: SparkSession, d: str) -> DataFrame:
    return stamps(spark, d).groupBy("topic").agg(F.first(F.lit("event")).alias("type"), F.count("*").alias("n"))


@query(f"WITH {ST} SELECT seq, topic, stamp_us FROM st WHERE topic IN ('click', 'view')")
def message_scan(spark: SparkSession, d: str) -> DataFrame:
    return stamps(spark, d).filter(F.col("topic").isin("click", "view")).select("seq", "topic", "stamp_us")


@query(f"""WITH {ST}, s AS (SELECT *, (stamp_us - lag(stamp_us) OVER (PARTITION BY topic ORDER BY seq)) / 1e6 AS dt FROM st),
m AS (SELECT topic, quantile_cont(dt, 0.5) FILTER (dt > 0) AS md FROM s GROUP BY topic)
SELECT s.topic, count(*) AS n, round((max(stamp_us) - min(stamp_us)) / 1e6, 6) AS duration, round((count(*) - 1) / ((max(stamp_us) - min(stamp_us)) / 1e6), 6) AS rate, round(avg(dt), 4) AS mean_dt,
 round(any_value(md), 6) AS median_dt, round(stddev_pop(dt), 4) AS std_dt, round(min(dt), 6) AS min_dt, round(max(dt), 6) AS max_dt, round(quantile_cont(abs(dt - md), 0.95), 6) AS jitter_p95,
 count(*) FILTER (dt > 1.5 * md) AS gaps, count(*) FILTER (dt <= 0) AS non_monotonic FROM s JOIN m USING (topic) GROUP BY s.topic""")
def stamp_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = ts.stamp_statistics(stamps(spark, d))
    return rounded(rounded(out, "duration", "rate", "median_dt", "min_dt", "max_dt", "jitter_p95"), "mean_dt", "std_dt", digits=4)


_NEAREST = f"""{ST}, r AS (SELECT * FROM st WHERE topic = 'click'), o AS (SELECT DISTINCT user_id, stamp_us AS t FROM st WHERE topic = 'view'),
b AS (SELECT r.user_id, r.seq, r.stamp_us, o.t AS before FROM r ASOF LEFT JOIN o ON r.user_id = o.user_id AND r.stamp_us >= o.t),
a AS (SELECT b.*, o.t AS after FROM b ASOF LEFT JOIN o ON b.user_id = o.user_id AND b.stamp_us <= o.t),
n AS (SELECT user_id, seq AS key, stamp_us AS stamp, CASE WHEN before IS NULL OR after - stamp_us < stamp_us - before THEN after ELSE before END AS other_stamp FROM a)"""


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    s = stamps(spark, d)
    return ts.nearest_offsets(s.filter("topic = 'click'"), s.filter("topic = 'view'"), "user_id")


@query(f'WITH {_NEAREST} SELECT user_id, key, stamp, other_stamp, other_stamp - stamp AS "offset" FROM n')
def nearest_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


@query(f"""WITH {_NEAREST}, f AS (SELECT user_id, CAST(other_stamp - stamp AS DOUBLE) AS o FROM n)
SELECT user_id, count(o) AS n, round(avg(o), 3) AS mean, round(quantile_cont(o, 0.5), 3) AS median, round(avg(abs(o)), 3) AS mean_abs, round(quantile_cont(abs(o), 0.95), 3) AS p95_abs, max(abs(o)) AS max_abs FROM f GROUP BY user_id""")
def offset_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.offset_statistics(_nearest(spark, d), "user_id"), "mean", "median", "mean_abs", "p95_abs", digits=3)


@query(f"""WITH {ST}, o AS (SELECT * FROM st WHERE topic = 'view') SELECT r.user_id, r.seq AS key, r.stamp_us AS stamp, o.value
FROM (SELECT * FROM st WHERE topic = 'click') r ASOF LEFT JOIN o ON r.user_id = o.user_id AND r.stamp_us >= o.stamp_us""")
def latest_value(spark: SparkSession, d: str) -> DataFrame:
    s = stamps(spark, d)
    return ts.latest_value(s.filter("topic = 'click'"), s.filter("topic = 'view'"), "user_id", "value")


@query(f"""WITH {ST}, o AS (SELECT user_id, stamp_us AS t, value FROM st WHERE topic <> 'click'), r AS (SELECT * FROM st WHERE topic = 'click'),
b AS (SELECT r.user_id, r.seq, r.stamp_us, o.t AS t0, o.value AS v0 FROM r ASOF JOIN o ON r.user_id = o.user_id AND r.stamp_us >= o.t),
a AS (SELECT b.*, o.t AS t1, o.value AS v1 FROM b ASOF JOIN o ON b.user_id = o.user_id AND b.stamp_us <= o.t)
SELECT user_id, seq AS key, stamp_us AS stamp, round(v0 + COALESCE((stamp_us - t0) / nullif(t1 - t0, 0), 0.0) * (v1 - v0), 4) AS value FROM a WHERE stamp_us - t0 <= 36000000000 AND t1 - stamp_us <= 36000000000""")
def interpolated_pose(spark: SparkSession, d: str) -> DataFrame:
    s = stamps(spark, d)
    return rounded(ts.interpolated_pose(s.filter("topic = 'click'"), s.filter("topic <> 'click'"), "user_id", ("value",), timeout=36_000_000_000), "value", digits=4)


@query(f"""WITH {ST} SELECT seq, topic, round(avg(value) OVER w, 6) AS rolling_mean, max(value) OVER w AS rolling_max, round(quantile_cont(value, 0.95) OVER w, 6) AS rolling_p95, avg(value) OVER w > 10.0 AS over_budget
FROM st WINDOW w AS (PARTITION BY topic ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ts.rolling(stamps(spark, d), 10, "value", "topic", "seq", 10.0)
    return rounded(out.select("seq", "topic", "rolling_mean", "rolling_max", "rolling_p95", "over_budget"), "rolling_mean", "rolling_p95")


@query(f"WITH {ST}, n AS (SELECT seq, topic, row_number() OVER (PARTITION BY topic ORDER BY seq) AS received FROM st) SELECT * FROM n WHERE (received - 1) % 7 = 0")
def every_nth_frame(spark: SparkSession, d: str) -> DataFrame:
    return ts.every_nth(stamps(spark, d), 7, "topic", "seq").select("seq", "topic", F.col("received").cast("long").alias("received"))


@query(f"WITH {ST}, n AS (SELECT seq, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS age FROM st) SELECT * FROM n WHERE age <= 20")
def last_n_points(spark: SparkSession, d: str) -> DataFrame:
    return ts.last_n(stamps(spark, d), 20, "user_id", "seq").select("seq", "user_id", "value", F.col("age").cast("long").alias("age"))


@query("SELECT DISTINCT l_suppkey % 50 AS parent, l_linenumber AS child, round(l_discount, 9) AS tx, round(l_tax, 9) AS ty FROM lineitem")
def static_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 50).alias("parent"), F.col("l_linenumber").alias("child"), F.round("l_discount", 9).alias("tx"), F.round("l_tax", 9).alias("ty"))
    return t.dropDuplicates(["parent", "child", "tx", "ty"])


@query(f"""WITH {ST}, f AS (SELECT user_id, count(*) AS n FROM st GROUP BY user_id HAVING count(*) >= 20)
SELECT * FROM (SELECT lag(user_id) OVER w AS previous, user_id AS "current", lag(n) OVER w AS previous_n, n AS current_n FROM f WINDOW w AS (ORDER BY user_id)) WHERE previous IS NOT NULL""")
def frame_pairing(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.operators.registration import frame_pairs

    return frame_pairs(stamps(spark, d), "user_id")


@query(f"""WITH {_NEAREST}, v AS (SELECT user_id, stamp_us AS t, value FROM st WHERE topic <> 'click'),
b2 AS (SELECT r.user_id, r.seq, r.stamp_us, v.t AS t0, v.value AS v0 FROM r ASOF JOIN v ON r.user_id = v.user_id AND r.stamp_us >= v.t),
a2 AS (SELECT b2.*, v.t AS t1, v.value AS v1 FROM b2 ASOF JOIN v ON b2.user_id = v.user_id AND b2.stamp_us <= v.t)
SELECT a2.user_id, seq AS key, stamp_us AS stamp, round(v0 + COALESCE((stamp_us - t0) / nullif(t1 - t0, 0), 0.0) * (v1 - v0), 4) AS value, other_stamp AS image_stamp, other_stamp - stamp_us AS image_offset
FROM a2 JOIN n ON n.user_id = a2.user_id AND n.key = a2.seq WHERE stamp_us - t0 <= 36000000000 AND t1 - stamp_us <= 36000000000 AND abs(other_stamp - stamp_us) <= 7200000000""")
def synchronized_frames(spark: SparkSession, d: str) -> DataFrame:
    """Each click as a frame: the value between the other events around it, and the nearest view."""
    s = stamps(spark, d)
    out = ts.synchronized(s.filter("topic = 'click'"), s.filter("topic <> 'click'"), s.filter("topic = 'view'"), "user_id", ("value",), timeout=36_000_000_000, slack=7_200_000_000)
    return rounded(out, "value", digits=4)
