"""Streams in time: gaps and jitter, nearest and latest stamps of another stream, rolling windows.

A stream can be one group with all the rows there are, so no window spans a whole one: streams are cut into runs of their
order, windows work within runs, and the little that a run needs of those before or behind it is a row a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.geometry import slerp
from terrafold.session import cut

#: A run of a stream: so many units of its order, which is a number. An hour of stamps in microseconds; as many sequence numbers.
RUN_STAMPS, RUN_NUMBERS = 3_600_000_000, 1_000_000
#: Runs that rows without an order are dealt to, and runs of a run of runs.
NULL_RUNS, RUNS = 64, 1000
#: Places of a sketch of values: ranks are known to one part in so many.
SKETCH = 2000


def carried(rows: DataFrame, by: str, t: str, values: dict[str, Column], run: int = RUN_STAMPS) -> DataFrame:
    """``rows`` with ``<name>_before`` and ``<name>_after`` for each value: the last one that is not null at or before the row's ``t``, and the first at or after it.

    Rows of one ``t`` see each other's. Within a run it is a frame that grows with the
    order, for what lies ahead in the order turned round; of the runs around one value each is handed on.
    """
    r = rows.withColumns({f"__{n}": v for n, v in values.items()}).withColumn("__run", F.floor(F.col(t) / run))
    w = Window.partitionBy(by, "__run")
    frame = lambda order: w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    for n in values:
        r = r.withColumns({f"{n}_before": F.last(f"__{n}", ignorenulls=True).over(frame(F.asc(t))), f"{n}_after": F.last(f"__{n}", ignorenulls=True).over(frame(F.desc(t)))})
    at = lambda n: F.when(F.col(f"__{n}").isNotNull(), F.col(t))
    base = rows.withColumns({f"__{n}": v for n, v in values.items()}).withColumn("__run", F.floor(F.col(t) / run))
    ends = base.groupBy(F.col(by).alias("__by"), F.col("__run").alias("__at")).agg(*[f(f"__{n}", at(n)).alias(f"__{k}_{n}") for n in values for k, f in (("last", F.max_by), ("first", F.min_by))])
    far = lambda order: Window.partitionBy("__by").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__by", "__at", *[F.last(f"__{k}_{n}", ignorenulls=True).over(far(o("__at"))).alias(f"__{s}_{n}") for n in values for k, o, s in (("last", F.asc, "b"), ("first", F.desc, "a"))])
    out = r.join(ends, r[by].eqNullSafe(ends["__by"]) & (r["__run"] == ends["__at"]), "left")
    out = out.withColumns({f"{n}_before": F.coalesce(f"{n}_before", f"__b_{n}") for n in values} | {f"{n}_after": F.coalesce(f"{n}_after", f"__a_{n}") for n in values})
    return out.select(*rows.columns, *[f"{n}_{s}" for n in values for s in ("before", "after")])


def run_of(rows: DataFrame, order: str, run: int) -> Column:
    """The run of each row. Rows without an order come before all others, in runs by a hash."""
    return F.coalesce(F.floor(F.col(order) / run), F.lit(-(1 << 62)) + F.pmod(F.xxhash64(*rows.columns), F.lit(NULL_RUNS)))


def numbered(rows: DataFrame, by: str, order: str, run: int = RUN_NUMBERS) -> DataFrame:
    """``rows`` with ``rn``, the place of each in its stream by ``order`` (a number; rows without one come first), from 1, and ``rn_total``, the rows of the stream."""
    r = rows.withColumn("__run", run_of(rows, order, run))
    sizes = r.groupBy(F.col(by).alias("__by"), F.col("__run").alias("__at")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__by")
    sizes = sizes.select("__by", "__at", (F.sum("__n").over(w.orderBy("__at")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("rn_total"))
    r = r.withColumn("__own", F.row_number().over(Window.partitionBy(by, "__run").orderBy(order)))
    out = r.join(sizes, r[by].eqNullSafe(sizes["__by"]) & (r["__run"] == sizes["__at"]))
    return out.withColumn("rn", F.col("__before") + F.col("__own")).select(*rows.columns, "rn", "rn_total")


def in_runs(rows: DataFrame, by: str, order: str, back: int, run: int = RUN_NUMBERS) -> tuple[DataFrame, Column]:
    """Rows with ``rn`` and ``__part``, runs of as many rows each, with the ``back`` rows before a run standing in it too; and whether a row stands there for itself."""
    length = max(run, back + 1)
    r = numbered(rows, by, order, run).withColumn("__part", F.floor((F.col("rn") - 1) / length))
    last = (F.col("__part") + 1) * length - F.col("rn")  # rows of the run behind it
    r = r.withColumn("__copy", F.explode(F.when((last < back) & (F.col("rn") + last < F.col("rn_total")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return r.withColumn("__part", F.col("__part") + F.col("__copy")), F.col("__copy") == 0


def quantiles(rows: DataFrame, by: tuple[str, ...], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """by and one column for each wanted (value, part): the exact quantile, between neighbours in proportion; nulls do not count.

    A sketch of the values says between which two the places lie that are asked for; what lies below is counted and only
    what lies between is put in order, a small part of the rows, equal values together.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v"), F.lit(float(p)).alias("part")) for n, (v, p) in wanted.items()])).alias("w")
    held = rows.select(*by, spread).select(*by, "w.*").filter(F.col("v").isNotNull())
    key = [*by, "name"]
    near, few = 2.0 / SKETCH, F.col("n") <= 2 * SKETCH
    cuts = None
    for p in sorted({float(p) for _, p in wanted.values()}):
        ends = F.percentile_approx("v", F.array(F.lit(max(0.0, p - near)), F.lit(min(1.0, p + near))), SKETCH)
        one = held.filter(F.col("part") == p).groupBy(*key).agg(F.count("*").alias("n"), F.min("part").alias("p"), F.min("v").alias("least"), F.max("v").alias("most"), ends.alias("e"))
        cuts = one if cuts is None else cuts.unionByName(one)
    # At either end of the values, and where they are few, the ends themselves: a sketch may fall short of them.
    cuts = cuts.select(*[F.col(c).alias(f"c_{c}") for c in key], "n", "p", F.when((F.col("p") <= near) | few, F.col("least")).otherwise(F.col("e")[0]).alias("low"), F.when((F.col("p") >= 1 - near) | few, F.col("most")).otherwise(F.col("e")[1]).alias("high"))
    same = held[key[0]].eqNullSafe(cuts[f"c_{key[0]}"])
    for c in key[1:]:
        same = same & held[c].eqNullSafe(cuts[f"c_{c}"])
    # What lies below is one row of each key, before the values between.
    upto = held.join(cuts, same).filter(F.col("v") <= F.col("high")).withColumn("v", F.when(F.col("v") >= F.col("low"), F.col("v")))
    inside = upto.groupBy(*key, "v").agg(F.count("*").alias("same"), F.first("n").alias("n"), F.first("p").alias("p"))
    ranked = inside.withColumn("upto", F.sum("same").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("v"))))
    place = F.col("p") * (F.col("n") - 1)
    covers = lambda i: (F.col("upto") > i) & (F.col("upto") - F.col("same") <= i)
    at = ranked.groupBy(*key).agg(F.first("n").alias("n"), F.first("p").alias("p"), F.max(F.when(covers(F.floor(place)), F.col("v"))).alias("lo"), F.max(F.when(covers(F.ceil(place)), F.col("v"))).alias("hi"))
    rest = place - F.floor(place)
    value = F.when(rest == 0, F.col("lo")).otherwise((1 - rest) * F.col("lo") + rest * F.col("hi"))
    at = at.withColumn("value", value)
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])


def with_steps(stamps: DataFrame, by: str = "topic", stamp: str = "stamp_us", order: str = "seq") -> DataFrame:
    """``dt``: seconds since the row before it in the stream."""
    r, own = in_runs(stamps, by, order, 1)
    step = (F.col(stamp) - F.lag(stamp).over(Window.partitionBy(by, "__part").orderBy("rn"))) / 1e6
    return r.withColumn("dt", step).filter(own).select(*stamps.columns, "dt")


def stamp_statistics(stamps: DataFrame, by: str = "topic", stamp: str = "stamp_us", order: str = "seq") -> DataFrame:
    """Per stream, in order of arrival: rate, steps, jitter (95th percentile of the distance to the median step), gaps over 1.5 medians, steps back."""
    steps = cut(with_steps(stamps, by, stamp, order))
    median = quantiles(steps, (by,), {"median_dt": (F.when(F.col("dt") > 0, F.col("dt")), 0.5)})
    streams = cut(steps.select(by).distinct().join(median, by, "left"))
    s = steps.join(streams, by)
    jitter = quantiles(s, (by,), {"jitter_p95": (F.abs(F.col("dt") - F.col("median_dt")), 0.95)})
    span = (F.max(stamp) - F.min(stamp)) / 1e6
    out = s.groupBy(by).agg(
        F.count("*").alias("n"), span.alias("duration"), F.try_divide(F.count("*") - 1, span).alias("rate"),
        F.avg("dt").alias("mean_dt"), F.first("median_dt").alias("median_dt"), F.stddev_pop("dt").alias("std_dt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"),
        F.count_if(F.coalesce(F.col("dt") > 1.5 * F.col("median_dt"), F.lit(False))).alias("gaps"), F.count_if(F.coalesce(F.col("dt") <= 0, F.lit(False))).alias("non_monotonic"),
    )
    return out.join(jitter, by, "left")


def nearest_offsets(ref: DataFrame, other: DataFrame, by: str, stamp: str = "stamp_us", key: str = "seq", run: int = RUN_STAMPS) -> DataFrame:
    """For each row of ``ref`` (by, key, stamp) the nearest stamp of ``other`` in the same group, ties to the earlier: ``other_stamp``, ``offset`` = other - ref.

    Both streams are put in one order of time; see ``carried``.
    """
    r = ref.select(by, F.col(key).alias("key"), F.col(stamp).alias("t"), F.lit(None).cast("long").alias("o"))
    o = other.select(by, F.lit(None).cast("long").alias("key"), F.col(stamp).alias("t"), F.col(stamp).cast("long").alias("o"))
    found = carried(r.unionByName(o), by, "t", {"o": F.col("o")}, run).filter(F.col("key").isNotNull())
    before, after, t = F.col("o_before"), F.col("o_after"), F.col("t")
    pick = F.when(before.isNull() | (after - t < t - before), after).otherwise(before)
    return found.select(by, "key", t.alias("stamp"), pick.alias("other_stamp"), (pick - t).alias("offset"))


def latest_value(ref: DataFrame, other: DataFrame, by: str, value: str, stamp: str = "stamp_us", key: str = "seq", run: int = RUN_STAMPS) -> DataFrame:
    """Each row of ``ref`` with the value of ``other`` that arrived last at or before it, however old."""
    r = ref.select(by, F.col(key).alias("key"), F.col(stamp).alias("t"), F.lit(1).alias("side"), F.lit(None).alias("v"))
    o = other.select(by, F.col(key).alias("key"), F.col(stamp).alias("t"), F.lit(0).alias("side"), F.struct(F.col(value).alias("v")).alias("v"))
    r = r.withColumn("v", F.col("v").cast(o.schema["v"].dataType))
    both = o.unionByName(r).withColumn("__run", F.floor(F.col("t") / run))
    w = Window.partitionBy(by, "__run").orderBy("t", "side", "key").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(F.col(by).alias("__by"), F.col("__run").alias("__at")).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "key"))).alias("__v"))
    ends = ends.withColumn("__v", F.last("__v", ignorenulls=True).over(Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)))
    found = both.withColumn("latest", F.last("v", ignorenulls=True).over(w)).filter("side = 1")
    found = found.join(ends, found[by].eqNullSafe(ends["__by"]) & (found["__run"] == ends["__at"]), "left")
    return found.select(by, "key", F.col("t").alias("stamp"), F.coalesce("latest", "__v")["v"].alias(value))


def interpolated_pose(ref: DataFrame, poses: DataFrame, by: str, columns: tuple[str, ...], quaternion: tuple[str, ...] = (), stamp: str = "stamp_us", key: str = "seq", timeout: int = 100_000, run: int = RUN_STAMPS) -> DataFrame:
    """Each row of ``ref`` with ``columns`` between the poses before and after it, in proportion of time, and the ``quaternion`` columns on the arc
    between theirs; dropped if either pose is missing or further than ``timeout``."""
    kept = F.struct(F.col(stamp).alias("t"), *[F.col(c).alias(c) for c in (*columns, *quaternion)])
    p = poses.select(by, F.lit(None).cast("long").alias("key"), F.col(stamp).alias("t"), kept.alias("p"))
    r = ref.select(by, F.col(key).alias("key"), F.col(stamp).alias("t"), F.lit(None).cast(p.schema["p"].dataType).alias("p"))
    found = carried(p.unionByName(r), by, "t", {"p": F.col("p")}, run).withColumnsRenamed({"p_before": "b", "p_after": "a"}).filter(F.col("key").isNotNull())
    found = found.filter((F.col("t") - F.col("b.t") <= timeout) & (F.col("a.t") - F.col("t") <= timeout))
    found = found.withColumn("part", F.coalesce(F.try_divide(F.col("t") - F.col("b.t"), F.col("a.t") - F.col("b.t")), F.lit(0.0)))
    part = F.col("part")
    turned = slerp([F.col(f"b.{q}") for q in quaternion], [F.col(f"a.{q}") for q in quaternion], part) if quaternion else []
    return found.select(by, "key", F.col("t").alias("stamp"), *[(F.col(f"b.{c}") + part * (F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in columns], *[c.alias(q) for q, c in zip(quaternion, turned, strict=True)])


def offset_statistics(offsets: DataFrame, by: str, offset: str = "offset") -> DataFrame:
    o = F.col(offset).cast("double")
    found = quantiles(offsets, (by,), {"median": (o, 0.5), "p95_abs": (F.abs(o), 0.95)})
    out = offsets.groupBy(by).agg(F.count(o).alias("n"), F.avg(o).alias("mean"), F.avg(F.abs(o)).alias("mean_abs"), F.max(F.abs(o)).alias("max_abs"))
    return out.join(found, by, "left").select(by, "n", "mean", "median", "mean_abs", "p95_abs", "max_abs")


def rolling(stats: DataFrame, n: int, value: str, by: str, order: str, budget: float | None = None) -> DataFrame:
    """Mean, largest and 95th percentile of the last ``n`` rows, and ``over_budget`` if the mean lies above it."""
    r, own = in_runs(stats, by, order, n - 1)
    w = Window.partitionBy(by, "__part").orderBy("rn").rowsBetween(-(n - 1), 0)
    out = r.withColumns({"rolling_mean": F.avg(value).over(w), "rolling_max": F.max(value).over(w), "rolling_p95": F.percentile(value, F.lit(0.95)).over(w)})
    out = out.filter(own).select(*stats.columns, "rolling_mean", "rolling_max", "rolling_p95")
    return out if budget is None else out.withColumn("over_budget", F.col("rolling_mean") > budget)


def every_nth(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first row of each stream and every n-th after it, with its place ``received``."""
    return numbered(rows, by, order).withColumnRenamed("rn", "received").drop("rn_total").filter((F.col("received") - 1) % n == 0)


def last_n(rows: DataFrame, n: int, by: str, order: str, run: int = RUN_NUMBERS) -> DataFrame:
    """The newest n rows of each stream, as a bounded buffer holds them, with ``age`` from 1; rows without an order are the oldest.

    Runs, then runs of runs, then streams keep n rows each, so no task orders a whole stream.
    """
    kept = rows.withColumn("__run", run_of(rows, order, run)).withColumn("__far", F.floor(F.col("__run") / RUNS))
    for part in (["__far", "__run"], ["__far"], []):
        newest = Window.partitionBy(by, *part).orderBy(F.desc("__run"), F.desc_nulls_last(order))
        kept = kept.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)
    return kept.select(*rows.columns, F.col("age").cast("long").alias("age"))


def synchronized(frames: DataFrame, poses: DataFrame, images: DataFrame, by: str, columns: tuple[str, ...], quaternion: tuple[str, ...] = (), stamp: str = "stamp_us", key: str = "seq", timeout: int = 100_000, slack: int = 50_000) -> DataFrame:
    """Frames at their own stamps with the pose between those around them and the nearest image: ``image_stamp`` and ``image_offset``; frames without a pose, or with no image within ``slack``, go."""
    posed = interpolated_pose(frames, poses, by, columns, quaternion, stamp, key, timeout)
    near = nearest_offsets(frames, images, by, stamp, key).filter(F.abs("offset") <= slack)
    return posed.join(near.select(by, "key", F.col("other_stamp").alias("image_stamp"), F.col("offset").alias("image_offset")), [by, "key"])
