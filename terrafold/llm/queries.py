"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.ann_forest import nearest
from terrafold.llm import collocations, license_join, merkle_manifest
from terrafold.llm.interleaved import media_documents
from terrafold.llm.language_id import language_report
from terrafold.llm.mixing import mix
from terrafold.llm.pii_surrogates import replace_pii
from terrafold.llm.secret_scan import secret_report
from terrafold.llm.sentencepiece_codec import encode_decode
from terrafold.llm.simhash_index import near_duplicates
from terrafold.llm.toxic_spans import toxicity_report
from terrafold.llm.warc_convert import archive_round_trip
from terrafold.session import scratch_path


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS origin, count(*) AS n FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN strlen(p.html) >= 1000 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.html) >= 1000 AND page_id <> origin THEN origin END AS refers_to
FROM p JOIN m USING (html)"""


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op9_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(_table(spark, sf_dir, "documents"), scratch_path(spark, "media"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_mentions"), F.array_join("pii_kinds", ",").alias("kinds"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan, op2_sentencepiece, op3_ann_forest, op4_language_id, op5_license_scan, op6_pfair_mix,
        op7_simhash, op8_warc, op9_interleaved_media, op10_pii_surrogates, op11_merkle_manifest, op12_toxicity, op13_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": license_join.oracle(), "op8_warc": OP8_SQL, "op11_merkle_manifest": merkle_manifest.oracle(), "op13_collocations": collocations.SQL}
