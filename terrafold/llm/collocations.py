"""Collocations from a weighted de Bruijn graph of four-word edges.

The edges are the four-word runs inside pieces, weighted by how often each occurs; the nodes are the three-word runs that
they join. Only edges are counted in the texts. The count of a node is the weight of the edges that leave it plus the pieces that end in it,
and so on down to single words. Chains of nodes with one edge in and one out are compacted to paths.

No phrase occurs more often than any run of words in it. Two sketches of a fixed size hold for each hash value how often runs
with it occur, first of one and two words, then of three and four, so a run below the least count is known to be rare: a place counts for the longest run from it that is not. A
sketch that overflows tells less; the counts of what can be a candidate are exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm.arrow_map import slices
from terrafold.operators.components import connected_components
from terrafold.session import cut, ship_package

#: Least count of a candidate; share of its count, in percent, at which a longer candidate replaces it; phrases of a language.
LEAST, REPLACED, TOP = 30, 80, 2000
#: Words of the longest phrase, the weight of an edge.
LONGEST = 4
SCALE = 2_000_000
#: Counters of the sketch as a power of two, those of one row in the shuffle, and what a counter holds at most.
SKETCH_BITS, CHUNK, FULL = 25, 1 << 17, 255
#: Bytes of text that are counted together, unless a single piece is longer.
SLICE_BYTES = 2 << 20
#: Parts of a language that are ranked on their own first.
PARTS = 64
UNKNOWN = "und"

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _BREAKS.copy()
_GAPS[list(b" \t")] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Words:
    """The words of some texts: ``ids`` into ``words`` (distinct, an Arrow array), ``langs`` into ``names``, and ``joined``: whether the next word stands in the same piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = _SMALL[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        gap = _GAPS[data]
        before = np.concatenate([[True], gap[:-1]])
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~gap])])
        coded = flat.dictionary_encode()
        self.words, self.ids = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        pieces = np.cumsum(_BREAKS[data])[starts]
        self.joined = np.concatenate([pieces[1:] == pieces[:-1], [False]])[: len(starts)]
        of, self.names = np.unique(np.array(langs, object), return_inverse=True)[::-1]
        lengths = np.array([len(t) + 1 for t in texts])
        self.langs = of[np.searchsorted(np.cumsum(lengths), starts, "right")]

    def cells(self, bits: int) -> list[np.ndarray]:
        """Where the runs of 1, 2, 3 and 4 words that begin at each word are counted in a sketch. Runs that leave their piece have no meaning."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words.cast(pa.large_binary()).to_pylist()], np.uint64)[self.ids]
        now = own ^ np.array([xxhash.xxh64_intdigest(n, 1) for n in self.names], np.uint64)[self.langs]
        out = [now * _A]
        for k in range(1, LONGEST):
            now = (now ^ (now >> np.uint64(31))) * _B + np.roll(own, -k)
            out.append((now ^ (now >> np.uint64(29))) * _C)
        return [x >> np.uint64(64 - bits) for x in out]

    def common(self, cells: list[np.ndarray], known: list[np.ndarray]) -> list[np.ndarray]:
        """Whether the run of 1, 2, 3 and 4 words from each word stays in its piece and is not known to be rare, nor any run in it. Sketches: of one and two words, then of three and four."""
        out: list[np.ndarray] = []
        for k, at in enumerate(cells):
            here = out[-1] & np.append(out[-1][1:], False) & self.joined if k else np.ones(len(at), bool)
            if k // 2 < len(known):
                some = np.flatnonzero(here)
                here[some] = known[k // 2][at[some] >> np.uint64(3)] >> (7 - (at[some] & np.uint64(7)).astype(np.uint8)) & 1
            out.append(here)
        return out


def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Bounded lots of (lang, text) rows. A long text is parted between two pieces, which have nothing in common; only one piece is never parted."""
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            langs, texts = [], []
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                while len(text) > SLICE_BYTES:
                    at = SLICE_BYTES
                    while at < len(text) and not _BREAKS[text[at]]:
                        at += 1
                    yield Words([lang], [text[:at]])
                    text = text[at:]
                langs.append(lang)
                texts.append(text)
            yield Words(langs, texts)


def sketch(rows: DataFrame, least: int, bits: int, below: tuple = ()) -> bytes:
    """A bit for each counter: whether runs of words counted there come to ``least``. ``rows``: lang, text. The first sketch counts runs of one and two words; the second, given the first as ``below``,
    those of three and four that the first does not tell to be rare. What reaches the driver has 2 ** bits bits at any size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros(1 << bits, np.uint8), opened(below)
        for w in read_texts(batches):
            cells = w.cells(bits)
            kept = w.common(cells, known)
            at, n = np.unique(np.concatenate([cells[k][kept[k]] for k in ((2, 3) if below else (0, 1))]), return_counts=True)
            held[at] = np.minimum(held[at] + n, FULL)
        for i in range(0, len(held), CHUNK):
            if (part := held[i : i + CHUNK]).any():
                yield pa.RecordBatch.from_pydict({"chunk": [i // CHUNK], "counts": [pa.compress(part.tobytes(), "zstd", asbytes=True)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(pa.decompress(packed, min(CHUNK, 1 << bits), "zstd"), np.uint8)
                total[i] = np.minimum(total.get(i, 0) + part.astype(np.uint16), FULL).astype(np.uint8)
        for i, counts in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": [i], "bits": [np.packbits(counts >= least).tobytes()]})

    size = min(CHUNK, 1 << bits) // 8
    out = bytearray((1 << bits) // 8)
    for i, part in rows.mapInArrow(count, "chunk long, counts binary").repartition("chunk").mapInArrow(add, "chunk long, bits binary").collect():
        out[i * size : (i + 1) * size] = part
    return bytes(out)


def opened(sent: tuple) -> list[np.ndarray]:
    """The bytes of broadcast sketches."""
    return [np.frombuffer(x.value, np.uint8) for x in sent]


def runs(rows: DataFrame, sent: tuple, bits: int) -> DataFrame:
    """lang, k, gram, n from each lot of texts: of each place the longest run that is not known to be rare. Those of four words are the edges; shorter ones (k 3, 2, 1) are
    where pieces end, or are cut since what follows is rare. All words of a language are k 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(sent)
        for w in read_texts(batches):
            if len(w.ids):
                yield from counted(w, np.sum(w.common(w.cells(bits), known), 0))

    return rows.mapInArrow(count, "lang string, k int, gram string, n long")


def counted(w: Words, longest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``runs`` for one lot; ``longest``: words of the run that counts from each word, 0 for none."""
    n, size = len(w.ids), len(w.words)
    per = np.bincount(w.langs, minlength=len(w.names))
    yield made(pa.array([str(x) for x in w.names]), 0, [""] * len(per), per)
    _, pair = np.unique(w.langs * size * size + w.ids * size + np.roll(w.ids, -1), return_inverse=True)
    for k in range(LONGEST, 0, -1):
        at = np.flatnonzero(longest == k)
        key = w.langs[at] * size + w.ids[at] if k == 1 else pair[at] if k == 2 else pair[at] * n + pair[at + k - 2]
        _, first, many = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        if len(at):
            parts = [w.words.take(pa.array(w.ids[at + i])) for i in range(k)]
            gram = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
            yield made(pa.array([str(x) for x in w.names]).take(pa.array(w.langs[at])), k, gram.cast(pa.string()), many)


def made(lang: pa.Array, k: int, gram: pa.Array | list, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": lang, "k": pa.array(np.full(len(n), k, np.int32)), "gram": gram, "n": pa.array(np.asarray(n, np.int64))})


def first_words(gram: Column, k: int | Column) -> Column:
    return F.substring_index(gram, " ", k) if isinstance(k, int) else F.call_function("substring_index", gram, F.lit(" "), k)


def flows(counts: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) of all runs of 4, 3, 2 and 1 words that may be common: what leaves a node, and the pieces that end in it or are cut behind it."""
    now = counts.filter(F.col("k") == LONGEST).select("lang", "gram", "n")
    out = [now]
    for k in range(LONGEST - 1, 0, -1):
        leaving = now.select("lang", first_words(F.col("gram"), k).alias("gram"), "n")
        now = leaving.unionByName(counts.filter(F.col("k") == k).select("lang", "gram", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        out.append(now)
    return out


def paths(edges: DataFrame) -> DataFrame:
    """(lang, gram, path_words): each edge (lang, gram) and the words of the compacted path that it lies in.

    Two edges are of one path if the node between them has no other edge, in or out. Paths and rings are the components of these links.
    """
    named = cut(edges.select("lang", "gram", F.monotonically_increasing_id().alias("id")))
    ahead = named.groupBy("lang", F.substring_index("gram", " ", -3).alias("node")).agg(F.max("id").alias("a"), F.count("*").alias("into"))
    behind = named.groupBy("lang", F.substring_index("gram", " ", 3).alias("node")).agg(F.max("id").alias("b"), F.count("*").alias("out"))
    links = cut(ahead.join(behind, ["lang", "node"]).filter("into = 1 AND out = 1 AND a <> b").select("a", "b"))
    found = cut(connected_components(links, "a", "b"))
    sizes = found.groupBy("component").agg((F.count("*") + LONGEST - 1).alias("path_words"))
    of = found.join(sizes, "component").select(F.col("node").alias("id"), "path_words")
    return named.join(of, "id", "left").select("lang", "gram", F.coalesce("path_words", F.lit(LONGEST)).alias("path_words"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, replaced: int = REPLACED, top: int = TOP, bits: int = SKETCH_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words: the best ``top`` phrases of each language, by score, count and phrase.

    A phrase has 2 to 4 words of one piece and occurs ``a`` >= ``least`` times; ``n`` are all words of the language; ``l`` and ``r`` are the counts of its first and
    last part at the cut that gives the lowest score, of several the first; phrases of which a longer candidate holds ``replaced`` percent are left out.
    ``path_words`` tells how long a fixed passage the phrase belongs to, by the compacted paths.

    A null text is an empty one, a null language ``und``; repeated rows count each. Texts of any length are read in parts that end with a piece.
    Languages without candidates, and an empty table, give no rows. Other columns take no part.
    """
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sent: tuple = ()
    for _ in range(2):
        sent += (spark.sparkContext.broadcast(sketch(rows, least, bits, sent)),)  # 2 ** bits bits each
    counts = cut(runs(rows, sent, bits).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))
    totals = counts.filter("k = 0").select("lang", F.col("n").alias("n"))  # one row a language
    of = [f.filter(F.col("n") >= least).withColumn("k", F.lit(LONGEST - i)) for i, f in enumerate(flows(counts))]
    all_ = cut(of[0].unionByName(of[1]).unionByName(of[2]).unionByName(of[3]))
    passages = paths(all_.filter(F.col("k") == LONGEST))
    found = all_.filter("k > 1").withColumnRenamed("n", "a").join(passages, ["lang", "gram"], "left")
    # A longer candidate holds a shorter one only if one of a single word more does, and as often at least.
    longer = found
    for k in (LONGEST, LONGEST - 1):
        inner = longer.filter(F.col("k") == k).select("lang", F.explode(F.array(F.substring_index("gram", " ", k - 1), F.substring_index("gram", " ", 1 - k))).alias("gram"), F.col("a").alias("over"), F.col("path_words").alias("way"))
        inner = inner.groupBy("lang", "gram").agg(F.max("over").alias(f"over{k}"), F.max("way").alias("way"))
        longer = longer.join(inner, ["lang", "gram"], "left").withColumn("path_words", F.coalesce("path_words", "way")).drop("way")
    over = F.coalesce(F.greatest(*[F.col(f"over{k}") for k in (LONGEST, LONGEST - 1)]), F.lit(0))
    stays = cut(longer.filter(100 * over < replaced * F.col("a")).select("lang", "gram", "k", "a", F.coalesce("path_words", "k").cast("long").alias("path_words")))
    part = lambda at: first_words(F.col("gram"), at)
    cuts = stays.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    sides = cuts.select("lang", F.col("gram").alias("phrase"), "a", "path_words", "at", F.posexplode(F.array(part(F.col("at")), part(F.col("at") - F.col("k")))).alias("side", "gram"))
    sides = sides.join(all_.select("lang", "gram", "n"), ["lang", "gram"])
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("n")))
    both = sides.groupBy("lang", "phrase", "a", "path_words", "at").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr(f"CAST(a AS decimal(20,0)) * CAST({SCALE} AS decimal(8,0)) DIV CAST(l + r AS decimal(20,0))")
    worst = both.groupBy("lang", "phrase", "a", "path_words").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("c")).select("lang", "phrase", "a", "path_words", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    near = worst.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", number("lang", "part")).filter(F.col("rank") <= top)
    best = near.withColumn("rank", number("lang")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"), "path_words")


#: DuckDB's SQL: every run is counted where it occurs, and each edge walks ahead through nodes with one edge in and one out.
SQL = f"""
WITH RECURSIVE p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) t(k))),
f AS (SELECT lang, k, gram, count(*) AS n FROM g GROUP BY ALL),
n AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, n AS a, string_split(gram, ' ') AS ws FROM f WHERE k > 1 AND n >= {LEAST}),
e AS (SELECT lang, gram, array_to_string(ws[1:3], ' ') AS h, array_to_string(ws[2:4], ' ') AS t FROM c WHERE k = 4),
q AS (SELECT lang, node FROM (SELECT lang, h AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT lang, t, 0, 1 FROM e) GROUP BY ALL HAVING sum(o) = 1 AND sum(i) = 1),
b AS (SELECT x.lang, x.gram AS a, y.gram AS b FROM e x JOIN q ON q.lang = x.lang AND q.node = x.t JOIN e y ON y.lang = q.lang AND y.h = q.node),
d AS (SELECT lang, gram AS a, gram AS b FROM e UNION SELECT d.lang, d.a, b.b FROM d JOIN b ON b.lang = d.lang AND b.a = d.b),
m AS (SELECT d.lang, d.b AS gram, max(s.n) + 3 AS words FROM d JOIN (SELECT lang, a, count(*) AS n FROM d GROUP BY ALL) s ON s.lang = d.lang AND s.a = d.a GROUP BY ALL),
h AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS gram, max(words) AS words
      FROM (SELECT lang, string_split(gram, ' ') AS ws, words, k, unnest(range(1, 6 - k)) AS i FROM m, range(2, 5) t(k)) GROUP BY ALL),
o AS (SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS gram, a AS big FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE m < k)),
s AS (SELECT lang, k, gram, a, ws FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = c.lang AND o.gram = c.gram AND 100 * o.big >= {REPLACED} * c.a)),
u AS (SELECT s.lang, s.k, s.gram, s.a, j, x.n AS l, y.n AS r, CAST(CAST({SCALE} AS HUGEINT) * s.a // (x.n + y.n) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM s) s
      JOIN f x ON x.lang = s.lang AND x.gram = array_to_string(s.ws[1:j], ' ') JOIN f y ON y.lang = s.lang AND y.gram = array_to_string(s.ws[j + 1:], ' ')),
v AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) AS first FROM u),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM v WHERE first = 1)
SELECT z.lang, rank, z.gram AS phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score, CAST(coalesce(h.words, z.k) AS BIGINT) AS path_words
FROM z JOIN n USING (lang) LEFT JOIN h ON h.lang = z.lang AND h.gram = z.gram WHERE rank <= {TOP}"""
