"""Connected components of an edge table, by contraction and alternating large-star and small-star rounds.

First each task replaces the edges that it holds by those of a forest, so what is left grows with the nodes, not with the edges, and what lies within
one task is one step deep. A few edges are then solved in one task; else rounds follow, each of two grouped joins on the node. Nothing is gathered on the driver
but the count of changed edges. Lineage is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import cut, ship_package

#: Edges that a task contracts together, and edges that one task can solve.
LOT, ALONE = 1_000_000, 200_000


def least_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes is connected with by edges (u, v): roots hook to lesser roots and paths are halved, all at once."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            return top
        u, v, low, high = u[apart], v[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(top, high, low)
        while (top != (up := top[top])).any():
            top = up


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from each node to the least one that the edges of a lot connect it with."""
    held, rows = [], 0

    def contracted() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        both = pa.chunked_array([*table["u"].chunks, *table["v"].chunks]).combine_chunks().dictionary_encode()
        order = np.asarray(pc.sort_indices(both.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[np.asarray(both.indices)]
        low = least_of(at[: table.num_rows], at[table.num_rows :], len(order))
        node = np.flatnonzero(low != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order[node])), both.dictionary.take(pa.array(order[low[node]]))], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LOT:
            yield contracted()
            held, rows = [], 0
    if rows:
        yield contracted()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (u, v): neighbours of u are linked to the least of them and u.

    The least neighbour is an aggregate joined back, so a node with very many
    neighbours never meets in one task as a list.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    linked = both.join(low, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    else:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) of every node that an edge names; component is the least node reachable.

    Edges may repeat, point either way or be loops; null ends are ignored. An
    empty table gives an empty result. Nodes can be any ordered type. Rounds end when the edges no longer change: each
    moves nodes to lesser ones only, so they do; paths shorten by a constant factor a round.
    """
    raw = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL"))
    ship_package(edges.sparkSession)
    nodes = raw.select(F.col("u").alias("node")).unionByName(raw.select(F.col("v").alias("node"))).distinct()
    kind = raw.schema["u"].dataType.simpleString()
    contract = lambda df: df.mapInArrow(forests, f"u {kind}, v {kind}")
    now = cut(contract(raw.filter("u <> v")).distinct())
    if now.count() <= ALONE:
        low = contract(now.repartition(1)).select("u", F.col("v").alias("component"))  # at most ALONE edges
        return nodes.join(low, nodes["node"] == low["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
    seen = None
    while True:
        now = cut(_star(_star(now, small=False), small=True))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    low = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(low, nodes["node"] == low["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
