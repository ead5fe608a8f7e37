"""Mixing against the weights as they are given, with many sources and over long runs."""

from collections import Counter
from fractions import Fraction

import pytest

from terrafold.llm import mixing


def held(got, target):
    """Whether after each slot every source is less than one block from its target, while all last."""
    blocks = Counter(s for _, s in got)
    lasts = min(blocks[s] / target[s] for s in target)
    seen: Counter = Counter()
    for t, (slot, s) in enumerate(sorted(got), 1):
        if t > lasts:
            return True
        seen[s] += 1
        if slot != t - 1 or any(abs(seen[x] - t * target[x]) >= 1 for x in target):
            return False
    return True


def parts(weights):
    total = sum(map(Fraction, weights.values()))
    return {s: Fraction(w) / total for s, w in weights.items()}


@pytest.mark.parametrize("weights", [{"a": 0.6123, "b": 0.2877, "c": 0.0999, "d": 0.0001}, {"a": 0.3337, "b": 0.3331, "c": 0.3332}])
def test_blocks_keep_to_exact_weights_over_many_periods(spark, weights):
    n = 24_000  # blocks: many times 1000 slots
    target = parts(weights)
    sizes = {s: int(n * p) + 2 for s, p in target.items()}
    rows = spark.range(sum(sizes.values())).withColumnRenamed("id", "doc_id")
    ends, case = 0, "CASE"
    for s, k in sizes.items():
        ends += k
        case += f" WHEN doc_id < {ends} THEN '{s}'"
    df = rows.selectExpr("doc_id", f"{case} END AS source")
    got = mixing.mix(df, weights, block_docs=1).collect()
    assert held([(r.mix_slot, r.source) for r in got], target)
    for r in got:
        assert r.mix_release == (r.mix_block - 1) / target[r.source] // 1 and r.mix_due == -(-r.mix_block / target[r.source] // 1)
        assert r.mix_release <= r.mix_slot < r.mix_due


@pytest.mark.parametrize("told", [True, False])
def test_each_of_many_sources_has_its_own_weight(spark, monkeypatch, told):
    if not told:
        monkeypatch.setattr(mixing, "SOURCES_TOLD", 0)
        monkeypatch.setattr(mixing, "BLOCKS_TOLD", 0)
    # 5,000 sources, more than the 4,096 that once had weights; the last and smallest is given half of all.
    df = spark.sql("SELECT id AS doc_id, CASE WHEN id < 20000 THEN concat('s', id % 4999) ELSE 'rare' END AS source FROM range(20003)")
    weights = {f"s{i}": 1.0 for i in range(4999)} | {"rare": 4999.0}
    got = mixing.mix(df, weights, block_docs=1).collect()
    assert sorted(r.mix_slot for r in got if r.source == "rare") == [0, 2, 4]
    by = Counter(r.source for r in got if r.mix_slot < 9998)
    assert len(by) == 5000 and all(by[f"s{i}"] == 1 for i in range(4999))
    # No weights: each by its own size.
    free = mixing.mix(df, block_docs=1).collect()
    last = {}
    for r in free:
        last[r.source] = max(last.get(r.source, 0), r.mix_due - 1)
        assert r.mix_release <= r.mix_slot < r.mix_due
    assert len(last) == 5000 and len(free) == 20_003
