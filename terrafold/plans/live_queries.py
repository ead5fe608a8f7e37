"""Queries on streams of several batches, with rows that come out of order, late rows, a restart, and maps by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.plans.map_queries import _evidence_sql, evidence_rounded, observations
from terrafold.plans.registry import PTS, query, rounded
from terrafold.session import scratch_path
from terrafold.sources.tables import points, stamps
from terrafold.streaming import maps
from terrafold.streaming.store import stored

#: Batches that a table comes in.
BATCHES = 6
_VOXEL = "CAST(floor(x / 2.0) AS BIGINT) AS ix, CAST(floor(y / 2.0) AS BIGINT) AS iy, CAST(floor(z / 2.0) AS BIGINT) AS iz"


@query(f"WITH {PTS} SELECT {_VOXEL}, count(*) AS observations, round(sum(confidence), 6) AS confidence_sum, min(z) AS min_z, max(z) AS max_z FROM pts GROUP BY ALL")
def streaming_voxel_map(spark: SparkSession, d: str) -> DataFrame:
    """A map that grows by what arrives, kept as changed voxels by version."""
    p = points(spark, d).select("pid", "x", "y", "z", "confidence")
    stream = maps.replayed(p, F.col("pid") % BATCHES, BATCHES)
    return rounded(stored(maps.voxel_counts(stream, 2.0), ["ix", "iy", "iz"], compact_every=3).read(), "confidence_sum")


@query(f"""WITH {PTS}, v AS (SELECT {_VOXEL}, vec_id % {BATCHES} AS b FROM pts JOIN embeddings ON pid = vec_id)
SELECT range AS version, count(DISTINCT (ix, iy, iz)) AS voxels, count(*) AS observations FROM range({BATCHES}) JOIN v ON b <= range GROUP BY range""")
def map_versions(spark: SparkSession, d: str) -> DataFrame:
    """Voxels and observations of each version of a map, read back after all of them were written and some compacted."""
    p = points(spark, d).select("pid", "x", "y", "z", "confidence")
    store = stored(maps.voxel_counts(maps.replayed(p, F.col("pid") % BATCHES, BATCHES), 2.0), ["ix", "iy", "iz"], compact_every=3)
    each = [store.read(v).agg(F.count("*").alias("voxels"), F.sum("observations").alias("observations")).select(F.lit(v).cast("long").alias("version"), "voxels", "observations") for v in range(BATCHES)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


#: Months of a batch; every other observation comes as many months late.
MONTHS = 14


def _by_month(seen: DataFrame) -> Column:
    """Batches by stamp, every other row in the batch behind its own."""
    month = (F.col("stamp_us") - 788_918_400_000_000) / (30.44 * 86_400e6)
    return F.greatest(F.lit(0), F.floor(month / MONTHS) + F.pmod(F.xxhash64(*seen.columns), F.lit(2))).cast("int")


_FADED = _evidence_sql("c * exp(-(t1 - stamp_us) / 1e6 / 31536000.0)", "0.001 * exp(-(t1 - t0) / 1e6 / 31536000.0)")


@query(f"SELECT *, CAST(0 AS BIGINT) AS late FROM ({_FADED})")
def streaming_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of observations out of order by up to two batches, none too late. After the third batch the stream ends and starts again."""
    seen = observations(spark, d)
    path, rows, place = (scratch_path(spark, n) for n in ("replay", "rows", "stream"))
    dealt, found = maps.dealt(seen, _by_month(seen)), None
    for part in (range(3), range(3, 8)):
        stream = maps.brought(dealt, part, path, None if found is None else "stamp_us")
        found = maps.collected(maps.evidence_stream(stream, 5.0, tau=31_536_000.0, delay=f"{3 * 31 * MONTHS} days"), "update", rows, place)
    return evidence_rounded(maps.latest(found, "ix", "iy", "iz"))


_BATCH = f"least({BATCHES - 1}, event_id * {BATCHES} // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 10 = 3 THEN 3 ELSE 0 END)"
_STEP = f"(SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) // {BATCHES} // 1000 FROM events)"


def _late_events(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Events as they come, each tenth three batches behind, and a delay of one batch."""
    e = stamps(spark, d)
    ends = e.agg(F.max("seq"), F.min("stamp_us"), F.max("stamp_us")).first()
    batch = F.least(F.lit(BATCHES - 1), F.floor(F.col("seq") * BATCHES / F.lit(ends[0] + 1)) + F.when(F.col("seq") % 10 == 3, 3).otherwise(0))
    return maps.replayed(e, batch, BATCHES, stamp="stamp_us"), f"{(ends[2] - ends[1]) // BATCHES // 1000} milliseconds"


_LATE = f"""e AS (SELECT user_id, event_id AS seq, event_type AS topic, value, epoch_us(ts) AS t, {_BATCH} AS b FROM events),
m AS (SELECT b, max(t) // 1000 AS top FROM e GROUP BY b), w AS (SELECT b, coalesce(max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_STEP}, 0) AS mark FROM m),
l AS (SELECT e.*, mark > 0 AND t // 1000 <= mark AS late FROM e JOIN w USING (b))"""


@query(f"""WITH {_LATE} SELECT user_id, seq, value, lag(seq) OVER u AS previous, lag(value) OVER u AS previous_value, late FROM l WHERE NOT late WINDOW u AS (PARTITION BY user_id ORDER BY t, seq)
UNION ALL SELECT user_id, seq, value, NULL, NULL, late FROM l WHERE late""")
def streaming_previous(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the one of its user before it; those behind the watermark come out as late."""
    stream, delay = _late_events(spark, d)
    return maps.collected(maps.with_previous(stream, "user_id", "seq", "value", "stamp_us", delay), "update").drop("batch")


@query(f"WITH {_LATE} SELECT user_id, seq, received FROM (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY t, seq) AS received FROM l WHERE NOT late) WHERE (received - 1) % 5 = 0")
def streaming_every_nth(spark: SparkSession, d: str) -> DataFrame:
    stream, delay = _late_events(spark, d)
    return maps.collected(maps.every_nth_arrival(stream, 5, "user_id", "seq", "stamp_us", delay), "update").drop("batch")


@query(f"""WITH {_LATE} SELECT r.user_id, r.seq, o.value AS latest FROM (SELECT * FROM l WHERE topic = 'click' AND NOT late) r ASOF LEFT JOIN (SELECT * FROM l WHERE topic = 'view' AND NOT late) o ON r.user_id = o.user_id AND r.seq >= o.seq""")
def streaming_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each click with its user's view before it by number, whatever their stamps."""
    stream, delay = _late_events(spark, d)
    s = stream.withColumn("side", F.col("topic") == "view").filter(F.col("topic").isNull() | F.col("topic").isin("click", "view"))
    return maps.collected(maps.with_latest(s, "user_id", "seq", "side", "value", "stamp_us", delay, by_order=True), "update").drop("batch")


@query(f"SELECT event_id AS seq, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_BATCH} DESC, event_id DESC) <= 20")
def streaming_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty events of each user as they came."""
    e = stamps(spark, d)
    top = e.agg(F.max("seq")).first()[0]
    batch = F.least(F.lit(BATCHES - 1), F.floor(F.col("seq") * BATCHES / F.lit(top + 1)) + F.when(F.col("seq") % 10 == 3, 3).otherwise(0))
    return maps.bounded(maps.replayed(e.select("seq", "user_id", "value"), batch, BATCHES), 20, "user_id", "seq")
