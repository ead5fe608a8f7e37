"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A chain is a sentence, its tokens are the words; each is toxic or not. A word's features are itself and its first 4 to 8
bytes, hashed to one weight each, so that inflected and joined forms share what is known of their stem. Tokens are labelled from the
labels of documents: in a toxic document those with a mark, a feature that tells toxic documents from others beyond doubt; in others none. Shards of a
bounded sample train a field each, and the weights are averaged. Forward-backward marginals give the offending
offsets; a logistic function of their largest value and their sum, fitted on labelled rows that the field has not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from terrafold.llm.arrow_map import map_texts, slices
from terrafold.session import cut, ship_package

#: Labelled rows, about, of each label that the model is learned from, chosen by a hash of the id, and the part of them, in percent, that only the score is fitted on.
SAMPLE_ROWS, FITTING = 4000, 25
#: Orders in which copies in the sample are told by their least run of words.
FAMILIES = 4
#: Shards of the sample, and tokens of a row that the field is trained on, about: sentences with a mark and others spread over the whole text.
SHARDS, TOKENS = 4, 1500
#: A mark's least rows, share of toxic ones among all with it, and test value (twice the log-likelihood ratio); marks at most, the surest first.
MARK_ROWS, MARK_SHARE, MARK_SURE, MARKS = 4, 0.8, 25.0, 20_000
#: Weights as a power of two, steps of training, penalty.
BITS, STEPS, PENALTY = 18, 60, 1e-3
#: Bytes of text that are read together, and tokens of a sentence up to which sentences go side by side.
BYTES, LANES_UP_TO = 1 << 20, 256
PREFIXES = range(4, 9)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n\r")] = True
_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BYTES + (BYTES >> 1))
        for name, base in (("up", _P), ("down", np.uint64(pow(int(_P), -1, 1 << 64)))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def small(text: str) -> str:
    """``text`` in small letters, as many characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Tokens:
    """Words of some texts: ``keys`` (a row of hashes for each feature, 0 where a word is too short), ``doc``, ``first`` (whether a sentence begins), ``start`` and ``end`` in characters of the joined text."""

    def __init__(self, texts: list[str]):
        data = np.frombuffer("\n".join(map(small, texts)).encode("utf-8", "replace") + b"\n", np.uint8)
        letter = _LETTER[data]
        before = np.concatenate([[False], letter[:-1]])
        begin, end = np.flatnonzero(letter & ~before), np.flatnonzero(before & ~letter)
        up, down = powers(len(data) + 1)
        rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        base, size = rolled[begin], end - begin
        self.keys = np.zeros((1 + len(PREFIXES), len(begin)), np.uint64)
        self.keys[0] = ((rolled[end] - base) * down[begin] + np.uint64(1)) * _MIX
        for i, k in enumerate(PREFIXES):
            at = size >= k
            self.keys[i + 1, at] = ((rolled[begin[at] + k] - base[at]) * down[begin[at]] + np.uint64(1 + k)) * _MIX
        sentences = np.cumsum(_END[data])[begin]
        self.first = np.concatenate([[True], sentences[1:] != sentences[:-1]])[: len(begin)]
        lengths = np.array([len(t) + 1 for t in texts])
        places = np.cumsum((data & 0xC0) != 0x80)
        self.start, self.end = places[begin] - 1, places[end] - 1
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def cells(self, bits: int = BITS) -> np.ndarray:
        """The weight of each feature; where there is none, the one behind the last."""
        return np.where(self.keys == 0, 1 << bits, (self.keys >> np.uint64(64 - bits)).astype(np.int64))


@dataclass
class Field:
    """Weights of the features (a last one is 0), the bias, and the gains of staying out, entering, leaving and staying in."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def emissions(self, cells: np.ndarray) -> np.ndarray:
        return np.clip(self.bias + self.weights[cells].sum(0), -30, 30)


def sentences_by_length(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each sentence, the longest first."""
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(first)))
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order]


def messages(field: Field, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward ratios r (toxic to not, with the token's own gain) and backward ratios q of all tokens. Short sentences go side by side, a long one token by token."""
    stay, enter, leave, keep = np.exp(np.clip(field.moves, -15, 15))
    gain = np.exp(e)
    r, q = gain * (enter / stay), np.ones(len(e))
    begin, size = sentences_by_length(first)
    short = int(np.searchsorted(-size, -LANES_UP_TO))
    for b, n in zip(begin[:short].tolist(), size[:short].tolist(), strict=True):
        g = gain[b : b + n].tolist()
        ahead, back = [g[0] * enter / stay], [1.0]
        for x in g[1:]:
            ahead.append(x * (enter + ahead[-1] * keep) / (stay + ahead[-1] * leave))
        for x in g[:0:-1]:
            x *= back[-1]
            back.append((leave + keep * x) / (stay + enter * x))
        r[b : b + n], q[b : b + n] = ahead, back[::-1]
    begin, size = begin[short:], size[short:]
    for k in range(1, int(size[0]) if len(size) else 0):
        at = begin[: np.searchsorted(-size, -k)] + k
        r[at] = gain[at] * (enter + r[at - 1] * keep) / (stay + r[at - 1] * leave)
    for k in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        at = begin[: np.searchsorted(-size, -k)] + k
        x = gain[at] * q[at]
        q[at - 1] = (leave + keep * x) / (stay + enter * x)
    return r, q


def marginals(field: Field, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probability of each token to be toxic, its sentence given."""
    r, q = messages(field, e, first)
    return r * q / (1 + r * q)


def train(cells: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS, bits: int = BITS) -> Field:
    """A field of greatest likelihood for labelled tokens: expected against observed features, steps scaled to each weight."""
    field = Field(np.zeros((1 << bits) + 1), -4.0, np.zeros(4))
    y = labels.astype(float)
    inner = ~first
    n = max(1.0, y.sum())
    seen = [np.zeros_like(field.weights), 1e-8, np.full(4, 1e-8)]
    both = np.flatnonzero(inner)
    told = np.array([((1 - y[both - 1]) * (1 - y[both])).sum(), ((1 - y[both - 1]) * y[both]).sum() + y[first].sum(), (y[both - 1] * (1 - y[both])).sum(), (y[both - 1] * y[both]).sum()])
    told[0] += (1 - y[first]).sum()
    for _ in range(steps):
        e = field.emissions(cells)
        r, q = messages(field, e, first)
        p = r * q / (1 + r * q)
        stay, enter, leave, keep = np.exp(np.clip(field.moves, -15, 15))
        x = np.exp(e[both]) * q[both]
        joint = np.stack([np.full(len(both), stay), enter * x, leave * r[both - 1], keep * r[both - 1] * x])
        counts = (joint / joint.sum(0)).sum(1)
        counts[0] += (1 - p[first]).sum()
        counts[1] += p[first].sum()
        d = (p - y) / n
        grads = [np.bincount(cells.ravel(), np.tile(d, len(cells)), (1 << bits) + 1) + PENALTY / n * field.weights, d.sum(), (counts - told) / n + PENALTY * field.moves]
        grads[0][-1] = 0
        seen = [s + g * g for s, g in zip(seen, grads, strict=True)]
        field.weights -= 0.5 * grads[0] / np.sqrt(seen[0] + 1e-12)
        field.bias -= 0.5 * grads[1] / np.sqrt(seen[1])
        field.moves = field.moves - 0.5 * grads[2] / np.sqrt(seen[2])
    return field


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: 5 divides crc32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic, weight, fitting, shard of about ``rows`` labelled rows of each label, not held out; weight: how many rows one stands for.

    Ids are chosen first, so no text is shuffled but those of the sample; of an id with several rows about one is taken. An id that is labelled
    more than once is toxic if half of its labels say so.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    part = {k: min(1.0, rows / n) for k, n in sizes.items()}
    rate = F.when(F.col("toxic") == 1, part.get(1, 1.0)).otherwise(part.get(0, 1.0))
    roll = lambda *c, salt: F.pmod(F.xxhash64(*c, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    ids = cut(known.filter(roll("id", salt=1) < rate).select("id", "toxic", (1 / rate).alias("weight")))
    ids = F.broadcast(ids)  # about 2 x rows
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    times = F.broadcast(own.select("id").join(ids, "id").groupBy("id").agg(F.count("*").alias("times")))
    found = own.join(ids, "id").join(times, "id").filter((F.col("times") == 1) | (roll("id", "text", salt=2) < 1 / F.col("times")))
    return without_copies(cut(found.select("text", "toxic", "weight", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) < FITTING).alias("fitting"), F.pmod(F.xxhash64("id", F.lit(4)), F.lit(SHARDS)).alias("shard"))))


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of each group of near copies in a sample, as a rule: the words of a copied text tell nothing about others.

    A row goes if in one of FAMILIES orders of three-word runs its least run is that of an earlier row with the same label.
    """

    def make():
        def run(texts: list) -> list:
            out = []
            for text in texts:
                keys = Tokens([text]).keys[0]
                three = keys[:-2] + np.uint64(3) * keys[1:-1] + np.uint64(7) * keys[2:] if len(keys) > 2 else keys
                out.append([int(((three ^ (three >> np.uint64(32))) * np.uint64((2 * i + 1) * int(_MIX) % (1 << 64))).min().view(np.int64)) for i in range(FAMILIES)] if len(three) else [])
            return [out]

        return run

    told = cut(map_texts(sample.withColumn("row", F.monotonically_increasing_id()), "text", ["row", "toxic"], StructType([StructField("families", ArrayType(LongType()))]), make, BYTES))
    each = told.select("row", "toxic", F.posexplode("families").alias("order", "family"))
    firsts = each.groupBy("toxic", "order", "family").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    later = each.join(firsts.filter("n > 1"), ["toxic", "order", "family"]).filter("row <> first").select("row").distinct()
    return cut(sample.withColumn("row", F.monotonically_increasing_id()).join(later, "row", "left_anti").drop("row"))


def marks(sample: DataFrame) -> np.ndarray:
    """Hashes of the features that tell toxic rows of the sample from others, sorted."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, BYTES):
                toxic = part.column(1).to_pylist()
                t = Tokens(part.column(0).to_pylist())
                for k in (0, 1):
                    mine = [np.unique(t.keys[:, t.doc == i]) for i, x in enumerate(toxic) if x == k]
                    if mine:
                        keys, n = np.unique(np.concatenate(mine), return_counts=True)
                        n = n[keys != 0]
                        yield pa.RecordBatch.from_pydict({"key": keys[keys != 0].view(np.int64), "bad": n * k, "good": n * (1 - k)})

    rows = sample.filter(~F.col("fitting"))
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return np.zeros(0, np.uint64)
    counts = rows.select("text", "toxic").mapInArrow(features, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("a"), F.sum("good").alias("b"))
    # In shares of either label, so that the sizes of the sample play no part.
    share = (F.col("a") / bad) / (F.col("a") / bad + F.col("b") / good)
    n, k = F.col("a") + F.col("b"), F.lit(bad / (bad + good))
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    sure = 2 * (part(F.col("a"), k) + part(F.col("b"), 1 - k))
    best = counts.filter((F.col("a") >= MARK_ROWS) & (share >= MARK_SHARE)).select("key", sure.alias("sure"), "b", share.alias("share")).filter(F.col("sure") >= MARK_SURE)
    return np.sort(np.array([r.key for r in best.orderBy(F.desc("sure"), "key").limit(MARKS).collect()], np.int64).view(np.uint64))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Field, np.ndarray] | None:
    """A field and the logistic function of its marginals, from documents (doc_id, text) and ``labels`` (doc_id, toxic); None without rows of both labels or marks."""
    ship_package(docs.sparkSession)
    sample = sampled(docs, labels, rows)
    known = marks(sample)
    if not len(known):
        return None

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: list[tuple] = []
        for batch in batches:
            for part in slices(batch, 0, BYTES):
                t = Tokens(part.column(0).to_pylist())
                bad = np.array(part.column(1).to_pylist(), bool)
                label = np.isin(t.keys, known).any(0) & bad[t.doc]
                chain = np.cumsum(t.first) - 1
                marked = np.bincount(chain, label, chain[-1] + 1 if len(chain) else 0) > 0
                many = np.bincount(t.doc, minlength=len(bad))
                every = np.maximum(1, many // TOKENS)[t.doc]  # of the sentences of a long text every so many-th
                keep = (marked[chain] | (chain % 7919 % every == 0)) if len(chain) else np.zeros(0, bool)
                lots.append((t.cells()[:, keep], t.first[keep], label[keep]))
        if lots:
            cells, first, label = (np.concatenate(x, -1) for x in zip(*lots, strict=True))
            if len(first):
                f = train(cells, first, label)
                yield pa.RecordBatch.from_pydict({"weights": [f.weights.astype(np.float32).tobytes()], "rest": [[f.bias, *f.moves.tolist()]]})

    # A shard in each task, SHARDS rows of a fixed size to the driver.
    found = sample.filter(~F.col("fitting")).repartition(SHARDS, "shard").select("text", "toxic").mapInArrow(shard, "weights binary, rest array<double>").collect()
    if not found:
        return None
    rest = np.mean([r.rest for r in found], 0)
    field = Field(np.mean([np.frombuffer(r.weights, np.float32).astype(float) for r in found], 0), float(rest[0]), rest[1:])
    seen = sample.filter("fitting").select("text", "toxic", "weight")
    got = map_texts(seen, "text", ["toxic", "weight"], StructType([StructField(c, DoubleType()) for c in ("most", "total")]), lambda: lambda texts: list(zip(*[s[:2] for s in score_texts(field, texts)], strict=True)))
    rows_ = got.collect()  # FITTING percent of the sample, four numbers each
    x = evidence(np.array([r.most for r in rows_]), np.array([r.total for r in rows_]))
    return field, logistic(x, np.array([r.toxic for r in rows_], float), np.array([r.weight for r in rows_], float))


def evidence(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a score is made of: the log odds of the largest marginal, the log of their sum, and 1."""
    p = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.log(p / (1 - p)), np.log(1e-3 + total), np.ones(len(p))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's steps, halved until the loss falls, with a penalty that keeps them finite where labels are told apart without error."""
    start = np.array([1.0, 0.0, 0.0])
    weight = weight / max(1e-12, weight.mean()) if len(weight) else weight

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * ((w - start) ** 2).sum())

    w = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + 0.1 * (w - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    for i in (0, 1):  # more evidence never lowers a score
        if w[i] < 0 and x[:, i].any():
            return logistic(np.where(np.arange(3) == i, 0.0, x), y, weight) * (np.arange(3) != i)
    return w


def parts_of(texts: list) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(rows, first characters, texts) in lots of about BYTES; a longer text is parted behind the end of a sentence."""
    at, from_, lot, held = [], [], [], 0
    for i, text in enumerate(texts):
        begin, text = 0, text or ""
        while True:
            end = len(text)
            if end - begin > BYTES:
                end = next((j + 1 for j in range(begin + BYTES, end) if text[j] in ".!?\n\r"), end)
            at.append(i)
            from_.append(begin)
            lot.append(text[begin:end])
            held += end - begin
            if held >= BYTES:
                yield at, from_, lot
                at, from_, lot, held = [], [], [], 0
            if end >= len(text):
                break
            begin = end
    if lot:
        yield at, from_, lot


def score_texts(field: Field, texts: list) -> list[tuple[float, float, str]]:
    """For each text the largest marginal, their sum, and the offending spans: ``start:end`` in characters, joined by commas."""
    most, total, spans = np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
    for at, from_, lot in parts_of(texts):
        t = Tokens(lot)
        if not len(t.first):
            continue
        p = marginals(field, field.emissions(t.cells()), t.first)
        row = np.array(at)[t.doc]
        np.maximum.at(most, row, p)
        total += np.bincount(row, p, len(texts))
        hot = p >= 0.5
        if hot.any():
            joined = np.concatenate([[False], hot[:-1] & hot[1:] & ~t.first[1:]])
            heads, tails = np.flatnonzero(hot & ~joined), np.flatnonzero(hot & ~np.append(joined[1:], False))
            for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
                shift = from_[t.doc[a]] - t.offsets[t.doc[a]]
                spans[at[t.doc[a]]].append(f"{t.start[a] + shift}:{t.end[b] + shift}")
    return list(zip(most.tolist(), total.tolist(), map(",".join, spans), strict=True))


def score_documents(df: DataFrame, model: tuple[Field, np.ndarray] | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1, higher: toxic likelier), ``predicted`` (1 from 0.5 on) and ``spans`` (offending ``start:end`` in characters of the text, comma-joined).

    Only the whole text is read; a null one is empty, and an empty text has the score of one without any toxic word. Without a model all scores are 0. A text of any
    length is read in parts that end with a sentence. An empty table gives no rows; other columns take no part.
    """
    fields = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("spans", StringType())])

    def make():
        def run(texts: list) -> list:
            if model is None:
                return [[0.0] * len(texts), [0] * len(texts), [""] * len(texts)]
            most, total, spans = zip(*score_texts(model[0], texts), strict=True)
            scores = 1 / (1 + np.exp(-np.clip(evidence(np.array(most), np.array(total)) @ model[1], -40, 40)))
            return [scores.tolist(), (scores >= 0.5).astype(int).tolist(), list(spans)]

        return run

    return map_texts(df, text, list(keep), fields, make, BYTES)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
