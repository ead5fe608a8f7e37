"""Persistent maps: classes and their evidence by voxel, from all observations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geometry import voxel_keys
from terrafold.session import cut, ship_package

_KEY = ("ix", "iy", "iz")
#: Sums of floats differ by the order of adding: evidence equal to so many digits is equal.
TIE_DIGITS = 9


def voxel_map(observations: DataFrame, resolution: float = 0.1, min_confidence: float = 0.0, float32: bool = False, stamp: str = "stamp_us") -> DataFrame:
    """Per voxel: class (largest summed confidence, the lower of equals, -1 if none), its share of all confidence, counts, heights, last stamp.

    Observations of unknown class count in the total, so they lower the share. Two
    groupings on one partitioning: by voxel and class, then by voxel.
    """
    kept = observations.filter(F.col("confidence") >= min_confidence).select("*", *voxel_keys(resolution, float32=float32))
    by_class = kept.groupBy(*_KEY, "class_id").agg(
        F.sum("confidence").alias("s"), F.max("confidence").alias("c"), F.count("*").alias("n"), F.sum("z").alias("sz"), F.min("z").alias("lz"), F.max("z").alias("hz"), F.max(stamp).alias("t")
    )
    known = F.when((F.col("class_id") >= 0) & (F.col("s") > 0), F.struct(F.round("s", TIE_DIGITS).alias("e"), (-F.col("class_id")).alias("c"), "s"))
    total = F.sum("s")
    out = by_class.groupBy(*_KEY).agg(
        F.coalesce(-F.max(known)["c"], F.lit(-1)).alias("class_id"), F.coalesce(F.try_divide(F.max(known)["s"], total), F.lit(0.0)).alias("share"),
        F.sum("n").alias("observations"), total.alias("confidence_sum"), F.max("c").alias("confidence_max"), (F.sum("sz") / F.sum("n")).alias("mean_z"), F.min("lz").alias("min_z"), F.max("hz").alias("max_z"), F.max("t").alias("last_stamp"),
    )
    return out.withColumns({f"c{a}": (F.col(f"i{a}") + 0.5) * resolution for a in "xyz"})


def is_evidence(classes: int) -> Column:
    """Whether an observation has a known class and a finite confidence above 0."""
    c = F.col("confidence")
    return F.coalesce((F.col("class_id") >= 0) & (F.col("class_id") < classes) & ~F.isnan(c) & (F.abs(c) < float("inf")) & (c > 0), F.lit(False))


def valid_evidence(observations: DataFrame, classes: int) -> DataFrame:
    """Observations that are evidence, their confidence cut to 1."""
    return observations.filter(is_evidence(classes)).withColumn("confidence", F.least("confidence", F.lit(1.0)))


def evidence_map(observations: DataFrame, resolution: float = 0.1, classes: int = 20, prior: float = 0.001, tau: float = 0.0, min_posterior: float = 0.0, stamp: str = "stamp_us") -> DataFrame:
    """Per voxel: the class of most evidence, the lower of equals, and its part of all evidence, with mean and variance of height.

    Each class starts with ``prior``; an observation adds its confidence. With
    ``tau`` (seconds) above 0 evidence fades with time: what a sequence of
    updates in order of stamps would leave is, in closed form, each observation
    and the prior faded from its stamp to the voxel's last.
    """
    seen = valid_evidence(observations, classes).select("*", *voxel_keys(resolution))
    if tau > 0:
        ends = seen.groupBy(*_KEY).agg(F.max(stamp).alias("t1"), F.min(stamp).alias("t0"))
        seen = seen.join(ends, list(_KEY))
        faded = lambda t: F.exp(-(F.col("t1") - F.col(t)) / F.lit(1e6 * tau))
        seen = seen.withColumns({"w": F.col("confidence") * faded(stamp), "p": F.lit(prior) * faded("t0")})
    else:
        seen = seen.withColumns({"w": F.col("confidence"), "p": F.lit(prior)})
    z = F.col("z") - F.col("iz") * resolution  # heights from the voxel's floor: their squares lose nothing, however high it lies
    by_class = seen.groupBy(*_KEY, "class_id").agg(F.sum("w").alias("s"), F.first("p").alias("p"), F.count("*").alias("n"), F.sum("z").alias("sz"), F.sum(z).alias("sl"), F.sum(z * z).alias("szz"))
    best = F.max(F.struct(F.round(F.col("s") + F.col("p"), TIE_DIGITS).alias("r"), (-F.col("class_id")).alias("c"), (F.col("s") + F.col("p")).alias("e")))
    n = F.sum("n")
    mean, low = F.sum("sz") / n, F.sum("sl") / n
    out = by_class.groupBy(*_KEY).agg(
        (-best["c"]).cast("int").alias("class_id"), (best["e"] / (F.sum("s") + classes * F.max("p"))).alias("posterior"), n.alias("observations"),
        mean.alias("mean_z"), F.greatest(F.sum("szz") / n - low * low, F.lit(0.0)).alias("var_z"),
    )
    return out.filter(F.col("posterior") >= min_posterior)


_SLOTS = "array<struct<score:double,class_id:int>>"


def slots_in_order(observations: DataFrame, resolution: float, max_classes: int, order: str = "seq") -> DataFrame:
    """class scores of a voxel that keeps ``max_classes`` only: a new class takes the weakest one's place if it is more confident, else is not kept.

    A voxel that sees no more classes than it keeps has their sums, in whatever order. Only where classes contend does the result depend on it: those voxels' observations
    are sorted by it and folded as they come, with the slots in memory and nothing else.
    """
    ship_package(observations.sparkSession)
    kept = observations.filter("class_id >= 0").select(F.col(order).alias("__o"), F.col("class_id").cast("int").alias("class_id"), F.col("confidence").cast("double").alias("confidence"), *voxel_keys(resolution))
    sums = cut(kept.groupBy(*_KEY, "class_id").agg(F.sum("confidence").alias("score")))
    classes = sums.groupBy(*_KEY).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("score", "class_id"))).alias("slots"))  # one entry a class
    alone = classes.filter(F.col("n") <= max_classes).select(*_KEY, "slots")
    contended = kept.join(classes.filter(F.col("n") > max_classes).select(*_KEY), list(_KEY), "left_semi")
    dealt = contended.repartition(*_KEY).sortWithinPartitions(*_KEY, "__o", "class_id", "confidence")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, out = None, {}, []

        def made() -> pa.RecordBatch:
            keys = list(zip(*[k for k, _ in out], strict=True))
            rows = [[{"score": s, "class_id": c} for s, c in sorted((s, c) for c, s in held.items())] for _, held in out]
            return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], pa.array(rows, pa.list_(pa.struct([("score", pa.float64()), ("class_id", pa.int32())])))], names=[*_KEY, "slots"])

        for batch in batches:
            for *key, c, k in zip(*(batch.column(n).to_pylist() for n in (*_KEY, "class_id", "confidence")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, slots))
                    now, slots = key, {}
                if c in slots:
                    slots[c] += k
                elif len(slots) < max_classes:
                    slots[c] = k
                elif k > (weakest := min((s, x) for x, s in slots.items()))[0]:
                    del slots[weakest[1]]
                    slots[c] = k
            if out:
                yield made()
                out = []
        if now is not None:
            out.append((now, slots))
            yield made()

    return alone.unionByName(dealt.mapInArrow(folded, f"ix long, iy long, iz long, slots {_SLOTS}"))
