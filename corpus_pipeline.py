"""A corpus made ready for training: STAGES, each a function of (session, documents, folder of the tables).

Every stage works on all that the one before kept. All but the last return the
columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm.language_id import UNKNOWN, identify, learn
from terrafold.llm.mixing import BLOCK_DOCS, mix
from terrafold.llm.near_copies import without_near_copies
from terrafold.llm.pii_surrogates import replace_pii
from terrafold.llm.sentencepiece_codec import encode_decode
from terrafold.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language found in the text; documents in which none is found (no text, no letter) go."""
    found = identify(docs, learn(docs), keep=("doc_id", "text", "source", "n_chars"))
    return found.filter(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles in common, or more) the document with the least id stays, those without an id last."""
    return without_near_copies(docs.select(COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; ``n_chars`` follows the text."""
    return replace_pii(docs.select(COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which the sources have their target weights: row after row, file after file."""
    mixed = mix(docs.select(COLUMNS))
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(COLUMNS)


def positioned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, a number that grows in the order in which the mixing stage wrote them.

    Of a table read from Parquet files it counts the rows from 0, file after file
    by name; the reader itself keeps no order. Of a table that was never written it is made of slot and place.
    """
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        mixed = mix(docs.select(COLUMNS))
        return mixed.select(*COLUMNS, (F.col("mix_slot") * BLOCK_DOCS + F.col("mix_place")).alias("position"))
    # One row a file: the rows of the files before it.
    files = rows.groupBy("__file").agg(F.count("*").alias("n"))
    files = files.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n")).alias("__before"))
    return rows.join(F.broadcast(files), "__file").select(*COLUMNS, (F.col("__before") + F.col("__row")).alias("position"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its place in the mixed order, its language and source, and the digests of ids and decoded text."""
    return encode_decode(positioned(docs), keep=("doc_id", "position", "lang", "source"), ids=True)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("pii", pii), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Language profiles, fingerprint groups and subword merges are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another from ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
