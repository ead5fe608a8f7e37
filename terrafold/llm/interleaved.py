"""Documents as ordered sequences of text and media, and the media they refer to.

A page is parsed to an ordered list of items, texts and media references with
their captions. Media lie in a store of their own, by the digest of the stored form;
a reference says that digest and a join on it puts what the store knows beside
each reference, at its position and with its caption.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from terrafold.llm.arrow_map import map_texts, slices
from terrafold.llm.hot_keys import join_split
from terrafold.session import cut, ship_package

#: Samples of an image: rows of WIDTH, a multiple of UNIT in all, padded with PAD.
WIDTH, UNIT, PAD = 24, 576, b"\xff"
SCHEME = "sha256:"

ITEMS = StructType([StructField("items", ArrayType(StructType([
    StructField("position", IntegerType()), StructField("kind", StringType()), StructField("text", StringType()),
    StructField("ref", StringType()), StructField("caption", StringType()),
])))])
_TEXT_ENDS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "tr", "section", "article", "blockquote", "ul", "ol", "table", "nav", "title"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SKIPPED = {"script", "style"}


def references(tag: str, given: dict) -> list[str]:
    """What a media element refers to: its source, where that is put off or chosen by size the later or first one; and the still of a video."""
    source = given.get("src")
    if not source or (source.startswith("data:") and given.get("data-src")):
        source = given.get("data-src") or source
    if not source and given.get("srcset", given.get("data-srcset")):
        source = (given.get("srcset") or given["data-srcset"]).split(",")[0].split()[0:1]
        source = source[0] if source else None
    return [x for x in (source, given.get("poster") if tag == "video" else None) if x]


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skipping = 0
        self.templates: list[int] = []
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join(" ".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        """The caption goes to the media of its figure; if there is none it is text like other."""
        if self.caption is None:
            return
        words, self.caption = self.caption, None
        text = " ".join(" ".join(words).split())
        media = [i for i in self.items[self.figure if self.figure is not None else len(self.items) :] if i["kind"] == "media"]
        for item in media:
            item["caption"] = text or item["caption"]
        if not media:
            self.words += words
            self.flush()

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        self.figure = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skipping += 1
        elif tag == "template":
            self.flush()
            self.templates.append(len(self.items))
        elif tag in _MEDIA:
            given = dict(attrs)
            for ref in references(tag, given):
                self.flush()
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": given.get("alt") or None})
        elif tag == "figure":
            self.end_figure()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _TEXT_ENDS and self.caption is None:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag == "template" and self.templates:
            self.flush()
            del self.items[self.templates.pop() :]
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in _TEXT_ENDS and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            (self.words if self.caption is None else self.caption).append(data)

    def end(self) -> None:
        """What is still open at the end of a page is closed there; a template that never ends is no template."""
        self.end_figure()


def sequence(html: str | None) -> list[dict]:
    """The items of a page in order; of a figure its caption goes to the media in it, else a media's own alternative text does.

    Elements that never end lose no text: a caption ends with its figure or with the page, and a
    template without end is read as if it were not there. Only what scripts and styles hold is left out."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end()
    return [item | {"position": i} for i, item in enumerate(parser.items)]


def interleave(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns and ``items``: (position, kind, text, ref, caption) in the page's order. Null html has no items; other columns take no part."""
    return map_texts(df, html, list(keep), ITEMS, lambda: lambda texts: [[sequence(t) for t in texts]])


# Media: texts as images of 8-bit samples.


def image_of(text: Column) -> Column:
    """The stored form of a text: a binary PGM image whose samples are its UTF-8 bytes, padded to a multiple of UNIT."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = (F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / UNIT)) * UNIT).cast("int")
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (size / WIDTH).cast("int").cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(head, F.rpad(raw, size, F.lit(PAD)))


def samples_of(image: bytes) -> bytes:
    """The samples of a stored image."""
    magic, sizes, top, samples = image.split(b"\n", 3)
    width, height = map(int, sizes.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an image of 8-bit samples")
    return samples


def feature_of(samples: bytes) -> str:
    """64 bits, as hexadecimal: whether the mean of each of 64 equal runs of the samples is above the mean of all; then mean and spread."""
    x = np.frombuffer(samples, np.uint8)
    edges = np.arange(64) * len(x) // 64
    sums, sizes = np.add.reduceat(x, edges, dtype=np.int64), np.diff(np.append(edges, len(x)))
    total, squares = int(sums.sum()), int(np.bincount(x, minlength=256) @ (np.arange(256) ** 2))
    bits = np.packbits(sums * len(x) > total * sizes).tobytes().hex()
    mean = total / len(x)
    return f"{bits}:{mean:.3f}:{max(0.0, squares / len(x) - mean * mean) ** 0.5:.3f}"


_STORED = StructType([
    StructField("media_sha256", StringType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()),
    StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("feature", StringType()),
])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What the store at ``path`` (column ``media``) holds, one row for each digest: sizes, digests and feature, all from the stored bytes."""
    ship_package(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                rows = []
                for image in part.column(0).to_pylist():
                    samples = samples_of(image)
                    rows.append({
                        "media_sha256": hashlib.sha256(image).hexdigest(), "n_bytes": len(samples.rstrip(PAD)), "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(),
                        "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(image), "feature": feature_of(samples),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, pa.int64() if f.dataType == LongType() else pa.string()) for f in _STORED]))

    return spark.read.parquet(path).select("media").mapInArrow(measure, _STORED).dropDuplicates(["media_sha256"])


def resolve(sequences: DataFrame, store: DataFrame, keep: tuple[str, ...] = ("page_id",), media_only: bool = False) -> DataFrame:
    """One row for each item, in place: what a reference by digest names in ``store``, joined on the digest; null where it has no such media. A digest that very many items name is dealt into parts."""
    items = sequences.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    items = items.filter("kind = 'media'") if media_only else items
    named = F.when(F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64))
    items = cut(items.withColumn("__digest", F.coalesce(named, F.lit(""))))
    sizes = cut(items.groupBy("__digest").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return join_split(items, store.withColumn("__digest", F.col("media_sha256")), "__digest", sizes, total).drop("__digest")


def page_of(doc_id: Column, digest: Column) -> Column:
    """A document as a page: what it is, and a figure that refers to its media."""
    name = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("without id")))
    return F.concat(F.lit("<article><h1>"), name, F.lit(f'</h1><figure><img src="{SCHEME}'), digest, F.lit('" alt="text"><figcaption>text of '), name, F.lit("</figcaption></figure></article>"))


def media_documents(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, of each document's media.

    Texts are written as images to a store at ``path`` and read back; documents
    are pages that refer to them by digest. Null texts are empty ones, of which
    the payload is all padding. Rows that repeat stay; equal texts have one
    digest and so equal values; an empty table gives an empty result; other columns take no part.
    """
    given = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    given.select(image_of(F.col("text")).alias("media")).write.option("compression", "zstd").parquet(path)
    pages = given.select("doc_id", page_of(F.col("doc_id"), F.sha2(image_of(F.col("text")), 256)).alias("html"))
    shown = resolve(interleave(pages, "html", ("doc_id",)), read_store(df.sparkSession, path), ("doc_id",), media_only=True)
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
