"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

The index cuts 64 bits into one block more than the bits that may differ. Of two
linked fingerprints one turn of the blocks exists in which, block after block from its first, the
differences never run ahead of their even share: none in the first block, one at most in the first two,
and so on. So each fingerprint is stored once for every turn, in Gray order, ranges of which are the
partitions; equal first blocks lie in one range. In a range runs of codes are leaves, runs of leaves upper nodes,
each with the bits that all below it share. Two nodes whose shared bits run ahead of that share are left at once, with
all below; two whose bits can differ too little are linked at once. A range gives the edges of a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terrafold.llm.arrow_map import map_texts
from terrafold.llm.hot_keys import join_split
from terrafold.operators.components import connected_components
from terrafold.session import cut, ship_package

#: Words of a shingle, the hash seed, and the bits in which linked fingerprints may differ.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Codes in a leaf, and nodes below an upper node.
FANOUT = 8
#: Node pairs that are looked at together.
PAIRS_AT_ONCE = 4096
#: Rows of a range, about, that one task call indexes, and of a first block that is dealt by its second one.
RANGE_ROWS, BLOCK_ROWS = 8192, 50_000
#: Bytes of a long text that are hashed together.
TEXT_BYTES = 4 << 20


def fingerprint(text: str) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    total, ones, at = len(words) - k + 1, np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    while at < total:
        # A long text is hashed in runs of shingles, so that little more than the text is held.
        some = words[at : at + TEXT_BYTES // 8 + k - 1]
        joined = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = np.concatenate([[0], ends[: len(some) - k]])
        codes = np.array([digest(joined[a:z], SEED) for a, z in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
        for a in range(0, len(codes), 65_536):
            ones += np.unpackbits(codes[a : a + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        at += len(codes)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long. A null text has none of the words, like an empty one."""
    return map_texts(df, text, list(keep), StructType([StructField("fp", LongType())]), lambda: lambda texts: [[fingerprint(t or "") for t in texts]])


def block_edges(distance: int) -> list[int]:
    """Where the blocks begin and end, in bits from the top: one block more than bits that may differ."""
    return [round(i * 64 / (distance + 1)) for i in range(distance + 2)]


def shares(turn: int, distance: int) -> list[tuple[np.uint64, int]]:
    """Of codes turned so that block ``turn`` comes first: the mask of the first 1, 2, ... blocks, and the differences that linked codes have there at most."""
    edges, b = block_edges(distance), distance + 1
    widths = [edges[(turn + j) % b + 1] - edges[(turn + j) % b] for j in range(b)]
    ends = np.cumsum(widths).tolist()
    return [(np.uint64(((1 << e) - 1) << (64 - e)), j * distance // b) for j, e in enumerate(ends, 1)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class _Forest:
    """Spanning edges among the rows of one call, each a pair that was linked itself."""

    def __init__(self, n: int):
        self.top = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        top = self.top
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while (self.top != (up := self.top[self.top])).any():
            self.top = up
        x, y = self.top[a], self.top[b]
        _, first = np.unique(np.minimum(x, y) * len(self.top) + np.maximum(x, y), return_index=True)
        for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
            if (x := self.root(i)) != (y := self.root(j)):
                self.top[max(x, y)] = min(x, y)
                self.edges.append((i, j))


def build(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level, from single codes in Gray order to the few nodes on top: the bits set in every code below a node, and in any."""
    levels = [(codes, codes)]
    while len(levels) == 1 or len(levels[-1][0]) > FANOUT:
        step = np.arange(0, len(levels[-1][0]), FANOUT)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], step), np.bitwise_or.reduceat(levels[-1][1], step)))
    return levels


def link_codes(codes: np.ndarray, limits: list[tuple[np.uint64, int]], distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Pairs (i, j) of places that span all links among ``codes``, distinct and in Gray order, which keep within ``limits``: see ``shares``."""
    n = len(codes)
    forest, levels = _Forest(n), build(codes) if n else []
    a, b = np.triu_indices(len(levels[-1][0])) if n else (np.zeros(0, int),) * 2
    todo = [(len(levels) - 1, a, b)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS_AT_ONCE:
            todo += [(level, a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]) for i in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        every, some = levels[level]
        for mask, most in limits:
            apart = (every[a] & ~some[b]) | (every[b] & ~some[a])  # bits shared on either side, and different
            near = np.bitwise_count(apart & mask) <= most
            a, b = a[near], b[near]
        if not level:
            forest.link(a, b)
            continue
        loose = (some[a] | some[b]) & ~(every[a] & every[b])  # bits in which any two below can differ
        sure = np.bitwise_count(loose) <= distance
        width = FANOUT**level
        for i, j in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
            rows = np.concatenate([np.arange(x * width, min(n, (x + 1) * width)) for x in {i, j}])
            forest.link(rows[1:], np.full(len(rows) - 1, rows[0]))
        a, b = a[~sure], b[~sure]
        size = len(levels[level - 1][0])
        x = (a[:, None] * FANOUT + np.arange(FANOUT))[:, :, None].repeat(FANOUT, 2)
        y = (b[:, None] * FANOUT + np.arange(FANOUT))[:, None, :].repeat(FANOUT, 1)
        good = (x < size) & (y < size) & (x <= y if level > 1 else x < y)
        todo.append((level - 1, x[good], y[good]))
    return forest.edges


def pairs_across(codes: np.ndarray, of: np.ndarray, limits: list[tuple[np.uint64, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of ``codes``, in Gray order, that keep within ``limits`` and are of different groups ``of``: nodes that hold rows of one and the same group only are left whole."""
    n, levels = len(codes), build(codes) if len(codes) else []
    ends = [(of, of)]
    for every, _ in levels[1:]:
        step = np.arange(0, len(ends[-1][0]), FANOUT)
        ends.append((np.minimum.reduceat(ends[-1][0], step), np.maximum.reduceat(ends[-1][1], step)))
    a, b = np.triu_indices(len(levels[-1][0])) if n else (np.zeros(0, int),) * 2
    todo = [(len(levels) - 1, a, b)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS_AT_ONCE:
            todo += [(level, a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]) for i in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        least, most = ends[level]
        apart = np.minimum(least[a], least[b]) != np.maximum(most[a], most[b])
        a, b = a[apart], b[apart]
        every, some = levels[level]
        for mask, allowed in limits:
            near = np.bitwise_count(((every[a] & ~some[b]) | (every[b] & ~some[a])) & mask) <= allowed
            a, b = a[near], b[near]
        if not level:
            if len(a):
                yield a, b
            continue
        size = len(levels[level - 1][0])
        x = (a[:, None] * FANOUT + np.arange(FANOUT))[:, :, None].repeat(FANOUT, 2)
        y = (b[:, None] * FANOUT + np.arange(FANOUT))[:, None, :].repeat(FANOUT, 1)
        good = (x < size) & (y < size) & (x <= y if level > 1 else x < y)
        todo.append((level - 1, x[good], y[good]))


def _turned(fp: Column, by: int) -> Column:
    """The bits of a long moved up by so many places, those that leave coming in below."""
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def links(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (src, dst) between the ``node`` values of a table (lane, fp, node): pairs of fingerprints of one lane within the distance, enough to connect all that are. The fingerprints of a lane are distinct."""

    def linked(table: pa.Table) -> pa.Table:
        codes, nodes = np.asarray(table["code"]).view(np.uint64), np.asarray(table["node"])
        order = np.argsort(gray_rank(codes), kind="stable")
        found = np.array(link_codes(codes[order], shares(table["turn"][0].as_py(), distance), distance), np.int64).reshape(-1, 2)
        nodes = nodes[order]
        return pa.table({"src": pa.array(nodes[found[:, 0]], pa.int64()), "dst": pa.array(nodes[found[:, 1]], pa.int64())})

    return ranges_of(points, distance).groupBy("lane", "turn", "range").applyInArrow(linked, "src long, dst long")


def ranges_of(points: DataFrame, distance: int) -> DataFrame:
    """lane, turn, range, code, node of a table (lane, fp, node): its fingerprints turned so that each block comes first, in ranges of about RANGE_ROWS in which linked ones meet.

    A first block with more than BLOCK_ROWS codes is dealt by its second one: a code then goes to its own
    second block and to those that lack one of its bits, so that two which differ in one bit there meet once.
    """
    ship_package(points.sparkSession)
    edges, b = block_edges(distance), distance + 1
    width = [edges[t + 1] - edges[t] for t in range(b)]
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), _turned(F.col("fp"), edges[t]).alias("code")) for t in range(b)])).alias("t")
    rows = points.select("lane", "node", turns).select("lane", "node", "t.turn", "t.code")
    of_turn = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("turn") + 1)
    rows = rows.withColumn("first", F.expr(f"shiftrightunsigned(code, 64 - element_at(array({', '.join(map(str, width))}), turn + 1))"))
    # Ranges of first blocks in Gray order: as many rows as blocks, turns and lanes have values, at any size of the table.
    sizes = cut(rows.groupBy("lane", "turn", "first").agg(F.count("*").alias("n")))
    gray = F.col("first")
    for s in (1, 2, 4, 8):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
    before = F.sum(F.when(F.col("n") <= BLOCK_ROWS, F.col("n")).otherwise(0)).over(Window.partitionBy("lane", "turn").orderBy("gray"))
    ranges = sizes.withColumn("gray", gray).select("lane", "turn", "first", F.floor(before / RANGE_ROWS).cast("long").alias("range"), F.when(F.col("n") > BLOCK_ROWS, F.ceil(F.col("n") * 8 / BLOCK_ROWS)).alias("parts"))
    placed = rows.join(F.broadcast(ranges), ["lane", "turn", "first"])
    if sizes.filter(F.col("n") > BLOCK_ROWS).isEmpty():
        dealt = placed.select("lane", "turn", "range", "code", "node")
    else:
        second = F.expr(f"shiftrightunsigned(code, 64 - element_at(array({', '.join(str(width[t] + width[(t + 1) % b]) for t in range(b))}), turn + 1))")
        w2 = of_turn([width[(t + 1) % b] for t in range(b)])
        bit = lambda i: F.lit(1).cast("long") * F.pow(F.lit(2.0), i).cast("long")
        lacking = F.filter(F.sequence(F.lit(0), w2 - 1), lambda i: F.col("second").bitwiseAND(bit(i)) != 0)
        meets = F.concat(F.array("second"), F.transform(lacking, lambda i: F.col("second") - bit(i)))
        many = placed.filter("parts IS NOT NULL").withColumn("second", second).withColumn("target", F.explode(meets))
        many = many.select("lane", "turn", (-1 - F.pmod(F.xxhash64("target"), F.col("parts"))).cast("long").alias("range"), "code", "node").distinct()
        dealt = placed.filter("parts IS NULL").select("lane", "turn", "range", "code", "node").unionByName(many)
    return dealt


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id reachable by links, itself included.

    Documents without words, null texts too, have fingerprint 0 and are linked
    like any other. Rows that repeat are linked to each other; an id that stands
    for several texts joins their groups. A row without id is linked and links like others; a component has the least
    of the ids that it has, null if it has none. An empty table
    gives an empty result; other columns take no part.
    """
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = cut(fingerprints(given))
    points = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    # An id that has several texts ties their fingerprints together.
    held = marked.filter("doc_id IS NOT NULL").select("doc_id", "fp").distinct()
    several = held.groupBy("doc_id").agg(F.min("fp").alias("dst"), F.max("fp").alias("most")).filter("dst <> most").select("doc_id", "dst")
    ties = held.join(several, "doc_id").filter("fp <> dst").select(F.col("fp").alias("src"), "dst")
    found = connected_components(links(points.select(F.lit(0).alias("lane"), "fp", F.col("fp").alias("node"))).unionByName(ties))
    placed = points.join(found, points["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    out = join_split(marked, groups, "fp", points.select("fp", "n"), points.agg(F.sum("n")).first()[0] or 0)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
