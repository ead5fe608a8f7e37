"""The pipeline against the same stages done plainly on the driver."""

import hashlib
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_matches_plain_stages(spark):
    import sentencepiece

    from tests.llm.test_near_copies import plain_shingles, similarity
    from terrafold.llm import language_id, mixing, pii_surrogates, sentencepiece_codec

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}

    kept = {i: r.text for i, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    sets, least = {i: plain_shingles(t) for i, t in kept.items()}, {i: i for i in kept}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sorted(sets):
        for j in sets:
            if j > i and similarity(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    kept = {i: t for i, t in kept.items() if least[i] == i}
    assert set(got) == set(kept)
    assert Counter(r.source for r in got.values()) == Counter(docs[i].source for i in kept)
    learned = language_id.learn(spark.read.parquet(f"{folder}/documents.parquet"))
    assert {r.lang for r in got.values()} <= set(learned[0])
    assert sum(got[i].lang == docs[i].lang for i in got) > 0.97 * len(got)

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    for i, t in kept.items():
        for a, z, kind, entity in reversed(pii_surrogates.mentions(t)):
            t = t[:a] + pii_surrogates.shaped(t[a:z], kind, pii_surrogates.surrogate(kind, entity)) + t[z:]
        ids = library.encode(t)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert mixing.BLOCK_DOCS > 1


def test_stages_keep_odd_rows(spark):
    rows = [(1, "some words of text", "en", "a", 18), (1, "some words of text", "en", "a", 18), (None, "words without id", "en", None, 1), (2, None, "en", "a", 0), (3, "", None, "a", 0), (4, "12 34", "en", "a", 5), (5, "w " * 60_000, "en", "hot", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS lang_pred", "1 AS component_id")
    for _, stage in pipeline.STAGES:
        df = stage(spark, df, "")
    assert sorted(map(str, (r.doc_id for r in df.collect()))) == ["1", "5", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
