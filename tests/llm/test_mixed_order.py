"""The order of the mixing stage in the result of the pipeline's last stage."""

from collections import Counter

import pytest

from terrafold.llm import mixing
from terrafold.session import scratch_path

pipeline = pytest.importorskip("corpus_pipeline")


def test_prefixes_by_position_hold_the_targets(spark):
    sizes = {"a": 6400, "b": 1600, "c": 900, "d": 401}
    rows = [(i, f"text {i} " + "x" * (i * 37 % 900), "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    path = scratch_path(spark, "mixed")
    mixed = pipeline.mixing(spark, df, "")
    mixed.write.option("maxRecordsPerFile", 700).parquet(path)
    got = sorted((r.position, r.source) for r in pipeline.sentencepiece(spark, spark.read.parquet(path), "").select("position", "source").collect())
    assert [p for p, _ in got] == list(range(len(rows))) and Counter(s for _, s in got) == sizes
    total = sum(n**0.5 for n in sizes.values())
    target = {s: n**0.5 / total for s, n in sizes.items()}
    lasts = min(sizes[s] / target[s] for s in sizes)  # rows until the first source ends
    seen: Counter = Counter()
    for k, (_, s) in enumerate(got, 1):
        seen[s] += 1
        if k <= lasts - len(sizes) * mixing.BLOCK_DOCS and k % mixing.BLOCK_DOCS == 0:
            assert all(abs(seen[x] - k * target[x]) <= mixing.BLOCK_DOCS * 1.01 for x in sizes)
