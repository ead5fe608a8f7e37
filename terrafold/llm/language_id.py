"""Language identification with hyperdimensional profiles.

Every letter of every script has a random vector of ones and minus ones of its own. Three letters in a row are
bound into one vector, each letter's vector rotated by its place, and the
vectors of all such runs of a text, or of all texts of a language, are bundled by
adding. A text gets the language whose bundle lies at the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terrafold.llm.arrow_map import map_texts, slices
from terrafold.session import ship_package

#: Components of a vector.
WIDTH = 512
#: Labelled rows, about, that each language is learned from, chosen by a hash of the id: of a rare language all.
TRAIN_ROWS = 5_000
#: Run vectors that a task keeps, and runs of texts that are bundled together.
RUNS_KEPT, RUNS_AT_ONCE = 20_000, 30_000
#: Characters of a long text that are read at once.
CHARS = 1 << 20
UNKNOWN = "und"


def letters_of(text: str) -> np.ndarray:
    """The letters of a text as code points in lower case, 0 for each run of other characters, one at either end; empty if there is no letter."""
    small = text.lower()
    if len(small) != len(text) or "\u03a3" in text:  # letters whose small form is two, or depends on what follows
        small = "".join(c.lower()[0] for c in text)
    points = np.frombuffer(small.encode("utf-32-le"), np.uint32).astype(np.int64)
    low = points < 128
    letter = (points >= 97) & (points <= 122)
    if not low.all():
        some = np.unique(points[~low])
        letter |= np.isin(points, some[[chr(x).isalpha() for x in some.tolist()]])
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], np.where(letter, points, 0), [0]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


class Profiles:
    """Run vectors, made as they are met; a run is three code points of 21 bits each."""

    def __init__(self, seed: int = 11):
        self.seed, self.letters = seed, {}
        self.clear()

    def clear(self) -> None:
        self.known, self.vectors = np.zeros(0, np.int64), np.zeros((0, WIDTH), np.float32)

    def letter(self, point: int) -> np.ndarray:
        """The vector of a letter, from the seed and its code point: the same in every task."""
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).choice(np.array([-1, 1], np.int8), WIDTH)
        return self.letters[point]

    def runs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three in a text, other characters squeezed to one break, and their counts. A long text is read piece by piece, each with what of the one before its first runs need."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        last = np.zeros(0, np.int64)
        for a in range(0, len(text), CHARS):
            c = letters_of(text[a : a + CHARS])
            if len(c):
                if a and text[a - 1].isalpha() and text[a].isalpha():  # one word goes on: no end before it, none behind the piece before
                    c = np.concatenate([last[-3:-1], c[1:]])
                elif len(last):
                    c = np.concatenate([last[-2:-1], c])
                last = c
            cut_here = a + CHARS < len(text) and len(c) and text[a + CHARS - 1].isalpha() and text[a + CHARS].isalpha()
            c = c[:-1] if cut_here else c
            found.append(np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True))
        if len(found) < 2:
            return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        runs, at = np.unique(np.concatenate([r for r, _ in found]), return_inverse=True)
        return runs, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The bundle of each text, given as runs and counts: one product of all counts and run vectors."""
        if len(self.known) > RUNS_KEPT:
            self.clear()
        new = np.setdiff1d(np.concatenate([r for r, _ in texts]), self.known)
        if new.size:
            parts = [np.stack([np.roll(self.letter(x), turn) for x in ((new >> shift) & 0x1FFFFF).tolist()]) for shift, turn in ((42, 2), (21, 1), (0, 0))]
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.known, self.vectors = known[order], np.concatenate([self.vectors, (parts[0] * parts[1] * parts[2]).astype(np.float32)])[order]
        counts = np.zeros((len(texts), len(self.known)), np.float32)
        for row, (runs, n) in zip(counts, texts, strict=True):
            row[np.searchsorted(self.known, runs)] = n
        return counts @ self.vectors

    def of(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Place and bundle of each text with a letter, in lots of about RUNS_AT_ONCE runs."""
        lot, places, held = [], [], 0
        for i, t in enumerate(texts):
            if len((found := self.runs(t or ""))[0]):
                lot.append(found)
                places.append(i)
                held += len(found[0])
            if lot and (held >= RUNS_AT_ONCE or i + 1 == len(texts)):
                yield from zip(places, self.bundles(lot), strict=True)
                lot, places, held = [], [], 0


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit bundles, from about ``rows`` labelled rows of each that are not held out: a sample of bounded size a language, all rows of one that has no more."""
    ship_package(df.sparkSession)
    known = df.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    known = known.filter(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row a language.
    rates = known.groupBy("lang").agg((F.lit(float(rows)) / F.count("*") * (1 << 30)).alias("most"))
    known = known.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("most"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(), {}
        for batch in batches:
            for part in slices(batch, 1):
                langs = part["lang"].to_pylist()
                for i, v in profiles.of(part["text"].to_pylist()):
                    total[langs[i]] = total.get(langs[i], 0) + v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "bundle": [v.tolist() for v in total.values()]})

    def summed(table: pa.Table) -> pa.Table:
        rows_ = np.asarray(table["bundle"].combine_chunks().flatten()).reshape(-1, WIDTH)
        return pa.table({"lang": table["lang"][:1], "bundle": [rows_.sum(0).tolist()]})

    schema = "lang string, bundle array<double>"
    found = sorted(known.select("lang", "text").mapInArrow(partial, schema).groupBy("lang").applyInArrow(summed, schema).collect())
    bundles = np.array([r["bundle"] for r in found]).reshape(-1, WIDTH)
    length = np.linalg.norm(bundles, axis=1, keepdims=True)
    return [r["lang"] for r in found], bundles / np.where(length > 0, length, 1)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``, the cosine with that language (0 if negative).

    Only the whole text is read. Texts that are null or have no letter, and all
    texts where no language was learned, are ``und`` with score 0; of languages as near, the
    first by name is taken. An empty table gives an empty result.
    """
    names, bundles = model

    def make():
        profiles = Profiles()

        def run(texts: list) -> list:
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, v in profiles.of(texts) if names else ():
                v = v.astype(np.float64)
                cosine = bundles @ v / max(1e-12, np.linalg.norm(v))
                best = int(np.argmax(cosine))
                pred[i], score[i] = names[best], float(min(1.0, max(0.0, cosine[best])))
            return [pred, score]

        return run

    return map_texts(df, text, list(keep), StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]), make)


def language_report(df: DataFrame) -> DataFrame:
    return identify(df, learn(df)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
