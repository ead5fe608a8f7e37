"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them.

Trees are grown on a bounded sample of rows; every row is then put into a leaf of
each tree. A query takes leaves from one queue, ordered by how far it lies beyond
the splits on the way, whichever tree they belong to, until these hold as many rows as it may read. Neighbouring leaves
lie together in blocks of bounded size, so a leaf that holds a third of all rows is many blocks. Queries pass by
the blocks that they read from and are held against the rows of their leaves there, and no others; each block
returns its best candidates, scored on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from terrafold.session import ship_package

#: Rows, about, that the trees are grown on.
SAMPLE_ROWS = 20_000
TREES = 8
#: Rows, about, in a leaf; a tree has LEAVES_MOST leaves at most, so that the sample can place its splits.
LEAF_ROWS, LEAVES_MOST = 100, 1024
#: Of n rows a query reads READS * n ** READS_POWER, counted in each tree anew.
READS, READS_POWER = 9.0, 0.75
#: Rows that lie together, about: neighbouring leaves of a tree, or a part of one leaf.
BLOCK_ROWS = 20_000
#: Queries that are held against a block at once.
QUERIES_AT_ONCE = 256


def usable(vec: Column) -> Column:
    """Whether a vector can take part: not null, not zero, every component finite."""
    x = vec.cast("array<double>")
    return vec.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays: normals, thresholds, children (a leaf is -1 - its number, from left to right)."""
    normals, cuts, kids = [], [], []
    count = 0

    def split(rows: np.ndarray, share: int) -> int:
        nonlocal count
        if share <= 1:
            count += 1
            return -count
        v = rng.standard_normal(sample.shape[1])
        v /= np.linalg.norm(v)
        at = sample[rows] @ v
        cut = float(np.median(at)) if len(at) else 0.0
        me = len(normals)
        normals.append(v)
        cuts.append(cut)
        kids.append((0, 0))
        kids[me] = split(rows[at <= cut], share // 2), split(rows[at > cut], share - share // 2)
        return me

    split(np.arange(len(sample)), leaves)
    return np.array(normals).reshape(-1, sample.shape[1]), np.array(cuts), np.array(kids, dtype=np.int64).reshape(-1, 2)


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """One more component, so that of rows of any length the nearest direction has the largest inner product."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm * norm - (x * x).sum(1)))
    return np.column_stack([x, rest])


def leaf_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row, from 0."""
    normals, cuts, kids = tree
    at = np.zeros(len(x), np.int64) if len(cuts) else np.full(len(x), -1)
    while (open_ := np.flatnonzero(at >= 0)).size:
        node = at[open_]
        right = np.einsum("ij,ij->i", x[open_], normals[node]) > cuts[node]
        at[open_] = kids[node, right.astype(int)]
    return -1 - at


def search(forest: list[tuple], margins: list[np.ndarray], counts: list[np.ndarray], most: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that one query reads, from a queue shared by all trees, until they hold ``most`` rows. margins: its distance to each split, by tree; counts: rows a leaf."""
    queue = [(0.0, t, 0 if len(tree[1]) else -1) for t, tree in enumerate(forest)]
    found, held = [], 0
    while queue and held < most:
        gap, t, node = heapq.heappop(queue)
        kids, at = forest[t][2], margins[t]
        while node >= 0:
            z = at[node]
            heapq.heappush(queue, (gap + z * z, t, int(kids[node, 0 if z > 0 else 1])))
            node = int(kids[node, 1 if z > 0 else 0])
        if counts[t][-1 - node]:
            found.append((t, -1 - node))
            held += counts[t][-1 - node]
    return found


def best_of_leaves(queries: np.ndarray, own: np.ndarray, reads: np.ndarray, rows: np.ndarray, ids: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best rows of the leaves that it reads: (query, ids, scores).

    own: the queries' ids; reads: bool (query, leaf); leaf i has the rows ends[i] to ends[i + 1]. Only these are
    multiplied. The fast product picks candidates, with room for its rounding; scores are then
    summed alike for every pair, so equal vectors tie exactly.
    """
    rough = np.full((len(queries), len(rows)), -np.inf)
    for leaf in np.flatnonzero(reads.any(0)):
        who, at = np.flatnonzero(reads[:, leaf]), slice(ends[leaf], ends[leaf + 1])
        rough[who, at] = queries[who] @ rows[at].T
    for i, line in enumerate(rough):
        open_ = np.flatnonzero((line > -np.inf) & (ids != own[i]))
        need = k
        while open_.size:
            pick = open_
            if open_.size > need:
                edge = np.partition(line[open_], open_.size - need)[open_.size - need]
                pick = open_[line[open_] >= edge - 1e-9 * (1 + abs(edge))]
            if pick.size == open_.size or np.unique(ids[pick]).size >= k:
                score = np.einsum("j,ij->i", queries[i], rows[pick])
                order = np.lexsort((ids[pick], -score))
                chosen = ids[pick][order]
                first = np.sort(np.unique(chosen, return_index=True)[1])[:k]
                yield i, chosen[first], score[order][first]
                break
            need *= 4  # an id that repeats fills several of the k places


def nearest(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` marks, the ``k`` nearest found among all other rows.

    Nearness is the largest inner product, in double precision; ties go to the
    smaller id. Null ids, and vectors that are null, zero, hold null or
    non-finite components or have another length than most, take no part. An id
    that repeats is one candidate and one query: the score of a pair is the
    largest over their vectors. Fewer than ``k`` candidates: all found are
    returned. An empty table gives an empty result. Other columns take no part.
    """
    spark = df.sparkSession
    ship_package(spark)
    element = df.schema[vector].dataType.elementType
    kind, number = (ArrayType(FloatType()), np.float32) if isinstance(element, FloatType) else (ArrayType(DoubleType()), np.float64)
    given = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = given.filter(F.col("id").isNotNull() & usable(F.col("vec")))
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    sizes = given.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("s")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, norm = sizes["dim"], sizes["n"], float(sizes["s"]) ** 0.5
    given = given.filter(F.size("vec") == dim)

    share = min(1.0, SAMPLE_ROWS / n)
    sample = given.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").limit(2 * SAMPLE_ROWS).toArrow()["vec"].combine_chunks()
    x = lifted(np.asarray(sample.flatten(), np.float64).reshape(-1, dim), norm, False)
    rng = np.random.default_rng(seed)
    leaves = max(1, min(LEAVES_MOST, n // LEAF_ROWS))
    forest = [grow(x, leaves, rng) for _ in range(TREES)]

    def matrix(col: pa.Array) -> np.ndarray:
        return np.asarray(col.flatten(), np.float64).reshape(-1, dim)

    def leaf_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TREES, leaves), np.int64)
        for b in batches:
            x = lifted(matrix(b["vec"]), norm, False)
            for t, tree in enumerate(forest):
                total[t] += np.bincount(leaf_of(tree, x), minlength=leaves)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int32()), "n": pa.array(total.ravel(), pa.int64())})

    # As many numbers as the forest has leaves: TREES * LEAVES_MOST at most.
    counts = np.zeros(TREES * leaves, np.int64)
    for r in given.select("vec").mapInArrow(leaf_sizes, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    counts = counts.reshape(TREES, leaves)
    # Neighbouring leaves make a group of about BLOCK_ROWS rows; what is larger is a leaf by itself, dealt into blocks.
    group_of = (np.cumsum(counts, 1) - counts) // BLOCK_ROWS + (np.arange(TREES) * (n // BLOCK_ROWS + 1))[:, None]
    held = np.bincount(group_of.ravel(), counts.ravel(), minlength=TREES * (n // BLOCK_ROWS + 1)).astype(np.int64)
    blocks = np.maximum(1, -(-held // (2 * BLOCK_ROWS)))
    most = READS * n**READS_POWER

    def mixed(ids: np.ndarray, many: np.ndarray | int) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many

    block = StructType([
        StructField("group", IntegerType()), StructField("block", IntegerType()), StructField("asks", BooleanType()), StructField("id", LongType()),
        StructField("vec", kind), StructField("leaves", ArrayType(IntegerType())),
    ])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group, rows_block, asks, at, leaf_lists, b):
            cols = [pa.array(np.asarray(group), pa.int32()), pa.array(np.asarray(rows_block), pa.int32()), pa.array(np.full(len(at), asks))]
            return pa.RecordBatch.from_arrays([*cols, b["id"].take(pa.array(at)), b["vec"].take(pa.array(at)), leaf_lists], names=block.names)

        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                x, ids = matrix(b["vec"]), np.asarray(b["id"])
                up = lifted(x, norm, False)
                for t, tree in enumerate(forest):
                    leaf = leaf_of(tree, up)
                    group = group_of[t, leaf]
                    yield made(group, mixed(ids, blocks[group]), False, np.arange(len(ids)), pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1), pa.int32()), pa.array(leaf, pa.int32())), b)
                if not (asks := np.flatnonzero(np.asarray(b["asks"]))).size:
                    continue
                up = lifted(x[asks], norm, True)
                margins = [up @ tree[0].T - tree[1] for tree in forest]
                rows: list[tuple] = []
                for j, at in enumerate(asks):
                    by_group: dict[int, list[int]] = {}
                    for t, leaf in search(forest, [m[j] for m in margins], counts, most):
                        by_group.setdefault(int(group_of[t, leaf]), []).append(leaf)
                    rows += [(g, rb, at, ls) for g, ls in by_group.items() for rb in range(blocks[g])]
                    if len(rows) > 20_000 or j + 1 == len(asks):
                        if rows:
                            g, rb, at_, ls = zip(*rows, strict=True)
                            yield made(g, rb, True, np.array(at_), pa.array(ls, pa.list_(pa.int32())), b)
                        rows = []

    out = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group and block by block, those of the block before the queries: a block is kept, queries pass."""
        key, parts, ready = None, [], None

        def found(q: pa.RecordBatch) -> pa.RecordBatch:
            rows, ids, base, ends = ready
            lists = q["leaves"]
            reads = np.zeros((q.num_rows, len(ends) - 1), bool)
            who, leaf = np.repeat(np.arange(q.num_rows), np.asarray(lists.value_lengths())), np.asarray(lists.flatten()) - base
            inside = (leaf >= 0) & (leaf < reads.shape[1])
            reads[who[inside], leaf[inside]] = True
            own = np.asarray(q["id"])
            got = list(best_of_leaves(matrix(q["vec"]), own, reads, rows, ids, ends, k))
            cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
            return pa.RecordBatch.from_arrays([cat([np.full(len(i), own[j]) for j, i, _ in got], pa.int64()), cat([i for _, i, _ in got], pa.int64()), cat([s for _, _, s in got], pa.float64())], names=out.names)

        for batch in batches:
            keys = np.column_stack([np.asarray(batch["group"]), np.asarray(batch["block"]), np.asarray(batch["asks"].cast(pa.int8()))])
            for a, z in zip(cuts := [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()], [*cuts[1:], len(keys)], strict=True):
                part, now, asks = batch.slice(a, z - a), tuple(keys[a, :2]), keys[a, 2]
                if now != key:
                    key, parts, ready = now, [], None
                if not asks:
                    parts.append(part)
                elif parts or ready is not None:
                    if ready is None:
                        table = pa.Table.from_batches(parts).combine_chunks()
                        leaf, ids = np.asarray(table["leaves"].combine_chunks().flatten()), np.asarray(table["id"])
                        order = np.lexsort((ids, leaf))
                        base = int(leaf.min())
                        ready = matrix(table["vec"].combine_chunks())[order], ids[order], base, np.concatenate([[0], np.cumsum(np.bincount(leaf - base))])
                        parts = []
                    for i in range(0, part.num_rows, QUERIES_AT_ONCE):
                        yield found(part.slice(i, QUERIES_AT_ONCE))

    placed = given.mapInArrow(dealt, block).repartition("group", "block").sortWithinPartitions("group", "block", "asks")
    once = placed.mapInArrow(compared, out).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
