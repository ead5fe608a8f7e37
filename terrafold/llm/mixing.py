"""Sources mixed to target weights by Pfair scheduling.

A source's documents are dealt into blocks. With a part w of all weights, its
block j (from 1) is released at slot (j - 1) / w, rounded down, and due at j / w,
rounded up: whole numbers, reckoned exactly from the weights as given. In each slot the released block
with the earliest deadline goes. All blocks then lie between release and
deadline, so after any number of slots each source is less than one block from its share.
One task walks all blocks of all sources in order, with a few numbers a source in memory;
what it writes is a table that the rows, by source and block, are joined with.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.hot_keys import join_split
from terrafold.session import cut, ship_package

#: Documents of a block.
BLOCK_DOCS = 64
#: Sources, and blocks, up to which their tables are broadcast; beyond, they are shuffled.
SOURCES_TOLD, BLOCKS_TOLD = 4096, 200_000
#: Documents, about, that one task ranks at once.
RANK_ROWS = 4_000
#: Times of RANK_ROWS rows that tell a run of equal rows.
FULL_RUN = 4
#: Blocks in a batch of the timetable.
TIMES = 20_000


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    parts = [float(w).as_integer_ratio() for w in weights]
    scale = max((q for _, q in parts), default=1)  # all are powers of two
    return [p * (scale // q) for p, q in parts]


def walk(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Source, block (both from 0), slot, release and deadline, slot after slot, until all ``blocks`` of each source have gone.

    Slots in which no block is released, since sources have ended, are left out.
    """
    total = sum(weights)
    ready = [(-(-total // w), i, 0, 0) for i, (w, n) in enumerate(zip(weights, blocks, strict=True)) if n]
    heapq.heapify(ready)
    waiting: list[tuple] = []
    t = 0
    while ready or waiting:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, due, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, j, release))
        due, i, j, release = heapq.heappop(ready)
        if due <= t:
            raise AssertionError(f"block {j} of source {i} is late")
        yield i, j, t, release, due
        t += 1
        j += 1
        if j < blocks[i]:
            heapq.heappush(waiting, (j * total // weights[i], -(-(j + 1) * total // weights[i]), i, j))


def weighed(sizes: list[int], given: list[float | None] | None) -> list[float]:
    """The weight of each source: the square roots of the sizes, or what is ``given``, as ``mix`` says."""
    roots = [math.sqrt(n) for n in sizes]
    if given is None:
        return roots
    own = [w for w in given if w]
    mean = math.fsum(own) / len(own) if own else 1.0
    rest = math.fsum(r for r, w in zip(roots, given, strict=True) if w is None)
    return [mean * r / rest if w is None else w for r, w in zip(roots, given, strict=True)]


def walk_all(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """``walk`` of the sources with a weight; those without one, whose share is nothing, go after all others, by turns, each block at its own slot."""
    live = [i for i, w in enumerate(weights) if w]
    t = 0
    for i, j, slot, release, due in walk([weights[i] for i in live], [blocks[i] for i in live]):
        yield live[i], j, slot, release, due
        t = slot + 1
    waiting = [i for i, w in enumerate(weights) if not w and blocks[i]]
    j = 0
    while waiting:
        for i in waiting:
            yield i, j, t, t, t + 1
            t += 1
        j += 1
        waiting = [i for i in waiting if j < blocks[i]]


def timetable(sizes: DataFrame, weights: dict | None, block_docs: int) -> DataFrame:
    """key, block (from 0), slot, release, due of all blocks of a table (key, n) of sources and their rows."""
    spark = sizes.sparkSession
    ship_package(spark)
    sources = sizes.withColumn("own", F.lit(None).cast("double"))
    if weights:
        given = [(None if s is None else str(s), float(w)) for s, w in weights.items() if w is not None]
        if bad := [s for s, w in given if not 0 <= w < math.inf]:
            raise ValueError(f"weights must be finite and not negative: {bad}")
        named = spark.createDataFrame(given, "source string, own double")
        sources = sizes.join(named.select(key_of(F.col("source")).alias("key"), "own"), "key", "left")
    schema = "key string, block long, slot long, release long, due long"

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not sum(b.num_rows for b in read):
            return
        table = pa.Table.from_batches(read)
        keys = table["key"].combine_chunks()
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            i, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(i, pa.int64())), *[pa.array(c, pa.int64()) for c in rest]], names=["key", "block", "slot", "release", "due"])

        sizes_ = table["n"].to_pylist()
        exact = whole(weighed(sizes_, table["own"].to_pylist() if weights else None))
        for step in walk_all(exact, [-(-n // block_docs) for n in sizes_]):
            out.append(step)
            if len(out) == TIMES:
                yield made()
                out = []
        if out:
            yield made()

    return sources.select("key", "n", "own").repartition(1).sortWithinPartitions("key").mapInArrow(walked, schema)


def key_of(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(df: DataFrame, weights: dict | None = None, source: str = "source", seed: int = 5, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All columns of ``df`` with ``mix_slot``, ``mix_place`` (in the block), ``mix_block`` (of the source, from 1), ``mix_release`` and ``mix_due``.

    Rows ordered by slot and place are mixed to ``weights`` (by source; if not
    given, the square roots of the sources' sizes) for as long as every source
    lasts; slots of a source that has ended are left out. No row is dropped or
    repeated. Null is a source. Every source has a weight, release times and deadlines of its
    own; those that ``weights`` leaves out have the mean weight together, in
    proportion to the square roots of their sizes. A weight of 0 means no share: such sources come after all others. Negative weights and such
    that are not finite raise ValueError. Within a source the order is by a hash of
    all columns, so it is the same in every run and rows without an id spread like others; rows alike in all columns are told apart by number. An empty table gives an
    empty result; columns with the new names are replaced.
    """
    new = ["mix_slot", "mix_place", "mix_block", "mix_release", "mix_due"]
    rows = df.drop(*new)
    key = key_of(rows[source])
    sizes = cut(rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")))
    times = cut(timetable(sizes, weights, block_docs))
    all_ = sizes.agg(F.count("*").alias("sources"), F.sum(F.ceil(F.col("n") / block_docs)).alias("blocks")).first()
    told = lambda table, few: F.broadcast(table) if few else table
    counts = told(sizes.select(F.col("key").alias("__s"), F.col("n").alias("__n")), all_["sources"] <= SOURCES_TOLD)
    times = told(times.select(F.col("key").alias("__s"), F.col("block").alias("__block"), *[F.col(c).alias(f"__{c}") for c in ("slot", "release", "due")]), (all_["blocks"] or 0) <= BLOCKS_TOLD)

    # A source is cut by hash into runs of about RANK_ROWS rows: ranks within runs, then the runs before, give ranks.
    lanes = rows.withColumn("__s", key).withColumn("__h", F.xxhash64(*[rows[c] for c in rows.columns], F.lit(seed)))
    if all_["sources"] <= SOURCES_TOLD:
        lanes = lanes.join(counts, "__s")
    else:
        lanes = join_split(lanes, counts, "__s", counts.select("__s", F.col("__n").alias("n")), sizes.agg(F.sum("n")).first()[0] or 0)
    in_runs = lambda r: r.withColumn("__run", F.floor(F.shiftrightunsigned("__h", 33) * F.ceil(F.col("__n") / RANK_ROWS) / F.lit(1 << 31)).cast("long"))
    lanes = in_runs(lanes)
    counted = cut(lanes.groupBy("__s", "__run").agg(F.count("*").alias("n")))
    full = counted.filter(F.col("n") > FULL_RUN * RANK_ROWS).select("__s", "__run")
    if not full.isEmpty():
        # A run is so full only of rows alike in all columns. These are counted, which Spark does where they lie, and made anew from their number, each with a hash of its own.
        alike = lanes.join(full, ["__s", "__run"]).groupBy("__s", "__run", "__h").agg(F.count("*").alias("__c")).filter(F.col("__c") > RANK_ROWS)
        alike = cut(alike.select("__s", "__h"))
        again = lanes.join(alike, ["__s", "__h"], "left_semi").groupBy(*rows.columns, "__s", "__h", "__n").agg(F.count("*").alias("__c"))
        again = again.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__c")))).withColumn("__h", F.xxhash64("__h", "__copy"))
        rest = lanes.join(alike, ["__s", "__h"], "left_anti")
        lanes = in_runs(rest.drop("__run").unionByName(again.drop("__c", "__copy")))
        counted = cut(lanes.groupBy("__s", "__run").agg(F.count("*").alias("n")))
    before = counted.select("__s", "__run", (F.sum("n").over(Window.partitionBy("__s").orderBy("__run")) - F.col("n")).alias("__before"))
    order = Window.partitionBy("__s", "__run").orderBy("__h")
    ranked = lanes.withColumn("__rn", F.row_number().over(order)).join(before, ["__s", "__run"])
    rank = F.col("__before") + F.col("__rn") - 1
    placed = ranked.withColumn("__block", F.floor(rank / block_docs).cast("long")).withColumn("__place", rank % block_docs)
    at = placed.join(times, ["__s", "__block"])
    return at.select(
        *rows.columns, F.col("__slot").alias("mix_slot"), F.col("__place").cast("long").alias("mix_place"), (F.col("__block") + 1).alias("mix_block"),
        F.col("__release").alias("mix_release"), F.col("__due").alias("mix_due"),
    )
