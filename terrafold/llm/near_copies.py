"""Near copies by the similarity of word shingles, through the SimHash index.

Two texts are near copies if their sets of five-word shingles have at least
SIMILARITY of their union in common. Candidates are pairs that the Gray-order index links
within DISTANCE bits in one of LANES independently seeded fingerprints. At a similarity of 0.8 two fingerprints
differ in 9.7 of 64 bits in the mean, so one lane finds a pair with probability 0.36 and all together with 0.97; at 0.85
with 0.998. Every candidate is held against the exact sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from terrafold.llm.arrow_map import map_texts
from terrafold.llm.simhash_index import links
from terrafold.operators.components import connected_components
from terrafold.session import cut, ship_package

#: Words of a shingle, the least similarity, fingerprints of a text, and the bits in which candidates may differ.
SHINGLE, SIMILARITY, LANES, DISTANCE = 5, 0.8, 8, 8
#: Bits in which all fingerprints of a pair differ at most, of 512. At a similarity of 0.8 they differ in 77.6 in the mean, with a deviation of 8.1, so one pair in 30,000 has more.
APART = 110
#: Pairs that are held against their sets together, about.
PAIRS = 4096
#: Texts, and shingles of all of them, of a tile, about: those of two tiles are held against each other in one task.
TILE_TEXTS, TILE_SHINGLES = 2048, 1_000_000
#: Shingles that are counted together.
CODES = 16_384

_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, LANES).astype(np.uint64)
_MIX, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: The bits of each byte value, from the highest.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: str | None) -> set:
    """The runs of SHINGLE words of a text, letters A to Z in lower case; all words if fewer."""
    words = (text or "").encode().lower().split()
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def prints(found: set) -> list[int]:
    """One SimHash for each lane of a set of shingles, as signed longs: a shingle's hash is mixed anew with each lane's seed."""
    codes = np.array([xxhash.xxh64_intdigest(b" ".join(s)) for s in found], np.uint64)
    ones = np.zeros((LANES, 64), np.int64)
    for i in range(0, len(codes), CODES):
        part = codes[i : i + CODES]
        for lane, seed in enumerate(_SEEDS):
            x = part ^ seed
            for _ in range(2):
                x = (x ^ (x >> _ODD)) * _MIX
            x = (x ^ (x >> _ODD)).astype(">u8").view(np.uint8).reshape(-1, 8)
            if len(x) < 256:
                ones[lane] += np.unpackbits(x, axis=1).sum(0, dtype=np.int64)
            else:  # how often each byte value stands in each place tells how often each bit is set
                at = np.bincount((x + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
                ones[lane] += (at @ _BITS).ravel()
    return np.packbits(2 * ones > len(codes), axis=1).view(">i8").ravel().tolist()


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, key, n (distinct shingles), prints of a table (doc_id, key, text), and what other columns it has."""

    def make():
        def run(texts: list) -> list:
            out: list = [[], []]
            for t in texts:
                found = shingles(t)
                out[0].append(len(found))
                out[1].append(prints(found))
            return out

        return run

    return map_texts(df, "text", [c for c in df.columns if c != "text"], StructType([StructField("n", LongType()), StructField("prints", ArrayType(LongType()))]), make)


def codes_of(texts: DataFrame) -> DataFrame:
    return texts.select("key", F.posexplode("prints").alias("lane", "fp"))


def met(texts: DataFrame) -> DataFrame:
    """a, b, met: pairs of keys of a table (key, prints), by how many fingerprints they meet: enough to connect all that the index links.

    Texts that share a fingerprint of a lane meet as a star around one of them, another in each lane.
    """
    codes = codes_of(texts)
    turn = F.element_at(F.array(*[F.lit(int(x) >> 1) for x in _SEEDS]), F.col("lane") + 1)
    points = codes.groupBy("lane", "fp").agg(F.min(F.col("key").bitwiseXOR(turn)).alias("__m"), F.count("*").alias("size")).withColumn("node", F.col("__m").bitwiseXOR(turn))
    same = codes.join(points.filter("size > 1"), ["lane", "fp"]).filter("key <> node").select(F.col("key").alias("src"), F.col("node").alias("dst"))
    edges = links(points.select("lane", "fp", "node"), DISTANCE).unionByName(same)
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("met"))


def of_like_size(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys of a table (key, n, prints) whose sizes allow the similarity, and whose fingerprints taken together leave it likely."""
    side = lambda x: texts.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("prints").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9)
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.filter(apart <= APART).drop("na", "nb", "pa", "pb")


def texts_of(keys: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """key, text of each of ``keys``, once. A text that many rows hold is read from one of them, by its id and key: ``rows`` (doc_id, key), ``docs`` (doc_id, key, text)."""
    one = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("one"))
    found = docs.join(one.withColumnRenamed("key", "of"), (docs["key"] == F.col("of")) & docs["doc_id"].eqNullSafe(F.col("one"))).select("key", "text")
    return found.dropDuplicates(["key"])


def hashed(text: str) -> np.ndarray:
    """The shingles of a text as 64-bit hashes, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in shingles(text)], np.uint64))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), written, of keys of a table (key, text) whose shingles have the similarity.

    Both ends are dealt to as many blocks as give each pair of blocks about PAIRS pairs; a text goes once to each pair of blocks that needs it, not once for each of its
    pairs, so families in which very many pairs are candidates shuffle little. A text with very many pairs is dealt by the blocks of their other ends.
    """
    ship_package(texts.sparkSession)
    n = max(1, math.ceil(math.sqrt(pairs.count() / PAIRS)))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(n)).cast("int")
    dealt = pairs.select(block("a").alias("ga"), block("b").alias("gb"), "a", "b")
    needed = dealt.select(F.col("ga").alias("ka"), F.col("gb").alias("kb"), F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "text"), "key")

    def held(some: pa.Table, given: pa.Table) -> pa.Table:
        sets = {k: hashed(t) for k, t in zip(given["key"].to_pylist(), given["text"].to_pylist(), strict=True)}
        good = []
        for a, b in zip(some["a"].to_pylist(), some["b"].to_pylist(), strict=True):
            x, y = sets.get(a), sets.get(b)
            good.append(x is not None and y is not None and alike(x, y))
        return some.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return dealt.groupBy("ga", "gb").cogroup(needed.groupBy("ka", "kb")).applyInArrow(held, "a long, b long")


def groups(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component: the keys that near copies link, and the least key of each group; ``rows`` has doc_id, key, n and prints, ``docs`` doc_id, key and text.

    First each text is held against the candidate that it meets most often, either way, then all pairs of ``met`` that this has neither linked nor
    refused. These connect what the index links, but where one is refused others can be left out that hold: where
    texts that the index connects are still in several groups, all candidate pairs between these groups are held against the sets: see ``joining``.
    """
    texts = cut(rows.groupBy("key").agg(F.first("n").alias("n"), F.first("prints").alias("prints")))
    meets = cut(met(texts))
    pairs = cut(of_like_size(meets, texts))
    best = [pairs.groupBy(x).agg(F.max(F.struct("met", y)).alias("p")).select(x, f"p.{y}").select("a", "b") for x, y in (("a", "b"), ("b", "a"))]
    tried = cut(best[0].unionByName(best[1]).distinct())
    held = cut(texts_of(meets.select(F.explode(F.array("a", "b")).alias("key")).distinct(), rows, docs))
    edges = cut(verified(tried, held))
    found = cut(connected_components(edges, "a", "b"))
    rest = cut(_between(pairs, found).join(tried, ["a", "b"], "left_anti"))
    more = cut(verified(rest, held))
    if not more.isEmpty():
        edges = edges.unionByName(more)
        found = cut(connected_components(edges, "a", "b"))
    connected = connected_components(meets, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("whole"))
    placed = cut(connected.join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "whole", F.coalesce("component", "key").alias("of")))
    several = placed.groupBy("whole").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count("*").alias("n")).filter("x <> y AND n > 2").select("whole")
    again = cut(texts.join(placed.join(several, "whole", "left_semi"), "key"))
    if again.isEmpty():
        return found
    last = cut(joining(again, held))
    return found if last.isEmpty() else connected_components(edges.unionByName(last), "a", "b")


def likely(prints: np.ndarray, n: np.ndarray, of: np.ndarray, other: slice, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the candidates between texts in ``rows`` and those in ``other``, the most alike first: of different groups, linked in one lane, and no further apart than ``of_like_size`` allows."""
    apart, least = np.zeros((rows.stop - rows.start, other.stop - other.start), np.uint16), np.uint8(255)
    for lane in range(LANES):
        bits = np.bitwise_count(prints[rows, lane][:, None] ^ prints[other, lane])
        apart += bits
        least = np.minimum(least, bits)
    x, y = n[rows][:, None], n[other]
    good = (least <= DISTANCE) & (apart <= APART) & (of[rows][:, None] != of[other]) & (np.minimum(x, y) >= SIMILARITY * np.maximum(x, y) - 1e-9)
    a, b = np.nonzero(good)
    order = np.argsort(apart[a, b], kind="stable")
    return a[order] + rows.start, b[order] + other.start


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9


def joining(again: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that have the similarity and join all groups that any candidate pair joins: ``again`` (key, n, prints, whole, of), ``held`` (key, text).

    Candidates are tested where they meet, and only those that join two groups not yet joined there become rows. Texts that the index connects (``whole``) are one tile, or, if they are many,
    several, each pair of which meets in a task, so a task holds a bounded number of texts and no family meets in one. Few go many to a task.
    """
    ship_package(again.sparkSession)
    tiles = F.ceil(F.greatest(F.count("*") / TILE_TEXTS, F.sum("n") / TILE_SHINGLES)).cast("int")
    # At most one row for each tile's worth of texts.
    large = F.broadcast(cut(again.groupBy("whole").agg(tiles.alias("tiles")).filter("tiles > 1")))
    lots = max(1, math.ceil(again.agg(F.greatest(F.count("*") / TILE_TEXTS, F.sum("n") / TILE_SHINGLES)).first()[0]))
    t = F.pmod(F.xxhash64("key", F.lit(1)), F.col("tiles")).cast("int")
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least(i, "tile").alias("i"), F.greatest(i, "tile").alias("j")))
    placed = again.join(large, "whole", "left").withColumn("tile", F.coalesce(t, F.lit(0)))
    placed = placed.withColumn("lot", F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("whole"), F.lit(lots))).otherwise(F.col("whole")))
    placed = placed.join(held, "key").withColumn("p", F.explode(F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(pairs_of)))

    def met(table: pa.Table) -> pa.Table:
        table = table.sort_by([("whole", "ascending"), ("tile", "ascending"), ("key", "ascending")]).combine_chunks()
        keys, whole, tile, of, n = (np.asarray(table[c]) for c in ("key", "whole", "tile", "of", "n"))
        prints = np.asarray(table["prints"].combine_chunks().flatten()).view(np.uint64).reshape(-1, LANES)
        texts, sets = table["text"].combine_chunks(), {}
        names, groups_ = np.unique(of, return_inverse=True)
        top = list(range(len(names)))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        def codes(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = hashed(texts[i].as_py())
            return sets[i]

        out: list[tuple[int, int]] = []
        crossed = table["i"][0] != table["j"][0]
        begin = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(whole)], strict=True):
            middle = int(np.searchsorted(tile[lo:hi], tile[lo], "right")) + lo if crossed else hi
            if crossed and middle == hi:  # one of the two tiles is empty
                continue
            for at in range(lo, middle, 256):
                rows = slice(at, min(at + 256, middle))
                a, b = likely(prints, n, of, slice(middle, hi) if crossed else slice(at, hi), rows)
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if i < j and (x := root(groups_[i])) != (y := root(groups_[j])) and alike(codes(i), codes(j)):
                        top[max(x, y)] = min(x, y)
                        out.append((i, j))
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(keys[found[:, 0]], pa.int64()), "b": pa.array(keys[found[:, 1]], pa.int64())})

    rows = placed.select("lot", "p.i", "p.j", "whole", "tile", "key", "of", "n", "prints", "text")
    return rows.groupBy("lot", "i", "j").applyInArrow(met, "a long, b long")


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of different groups."""
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def without_near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each group that near copies link, one row of ``df``: the one with the least id, rows without id last; of several with that id, one.

    Texts are told apart by themselves, not by their ids: an id that stands for
    several texts keeps each that is no near copy. A null text is an empty one; texts
    without words are copies of each other.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = df.withColumns({"__key": F.xxhash64(own), "__check": F.xxhash64(F.lit("another seed"), own, F.length(own))})
    given = keyed.select(F.col(doc_id).alias("doc_id"), F.col("__key").alias("key"), F.col("__check").alias("check"), own.alias("text"))
    rows = cut(sketches(given))
    found = groups(rows, given)
    placed = rows.groupBy("doc_id", "key", "check").agg(F.count("*").alias("n")).join(found, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    # Different texts with one key, which a table of some billions can have, are groups of their own, so none is dropped for another.
    clash = rows.groupBy("key").agg(F.min("check").alias("__x"), F.max("check").alias("__y")).filter("__x <> __y").select("key", F.lit(True).alias("clash"))
    placed = placed.join(clash, "key", "left").withColumn("odd", F.when(F.col("clash"), F.struct("key", "check")))
    stays = placed.groupBy("component", "odd").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "check", "n")).alias("s"))
    stays = cut(stays.select(F.col("s.doc_id").alias("__id"), F.col("s.key").alias("__k"), F.col("s.check").alias("__c"), F.col("s.n").alias("__n")))
    one = lambda repeated: keyed.join(stays.filter((F.col("__n") > 1) == F.lit(repeated)), keyed[doc_id].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")) & (F.col("__check") == F.col("__c")))
    # Only a text that stands under its id more than once has to be thinned to one row.
    single = one(True).groupBy("__key", "__check", doc_id).agg(F.min(F.struct(*[F.col(c) for c in df.columns])).alias("d")).select("d.*")
    return one(False).select(*df.columns).unionByName(single)
