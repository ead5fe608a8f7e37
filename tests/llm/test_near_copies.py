"""The pipeline's near-dedup stage against all pairs of five-word shingles."""

import random

import pytest

from terrafold.llm import near_copies

pipeline = pytest.importorskip("corpus_pipeline")


def plain_shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_prints_count_bits_alike_for_few_and_many():
    some = {(f"w{i}".encode(),) for i in range(700)}
    whole = near_copies.prints(some)
    near_copies_codes, near_copies.CODES = near_copies.CODES, 100
    try:
        assert near_copies.prints(some) == whole and len(set(whole)) == near_copies.LANES and near_copies.prints(set()) == [0] * near_copies.LANES
    finally:
        near_copies.CODES = near_copies_codes


def test_stage_leaves_no_pair_of_eight_tenths(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(80):
        words = [f"w{rnd.randrange(2000)}" for _ in range(rnd.randint(30, 300))]
        texts.append(" ".join(words))
        for _ in range(rnd.choice([0, 1, 3, 20])):
            w = list(words)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [plain_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in near:
        i, j = root(i), root(j)
        top[max(i, j)] = min(i, j)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.simhash_dedup(spark, df.repartition(5), "").collect()}
    first = {root(i) for i in range(len(texts))}
    assert len(near) > 500 and first <= kept
    assert sum(i in kept and j in kept for i, j in near) <= 0.01 * len(near)
    assert len(kept) <= 1.02 * len(first)


def test_stage_goes_by_text_not_id(spark):
    text, other = "one two three four five six seven", "a text of quite another kind than that"
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (7, text, "en", "a", 1), (7, other, "en", "a", 1), (7, other, "en", "b", 1), (None, "alone in all the world", None, None, None), (None, "alone in all the world", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in pipeline.simhash_dedup(spark, df, "").collect())
    assert got == sorted([("7", text), ("7", other), ("None", "alone in all the world")])


def test_pairs_in_a_family_of_like_texts_are_found(spark):
    """400 pairs of about 0.82 among 800 texts alike to about 0.73: what lies between must not hide them."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(400)]

    def changed(words, n):
        w = list(words)
        for i in rnd.sample(range(len(w) - 6), n):
            w[i] = f"z{rnd.randrange(10**7)}"
        return w

    texts, pairs = [], []
    for _ in range(250):
        one = changed(base, 7)
        texts += [one, changed(one, 8)]
        pairs.append((len(texts) - 2, len(texts) - 1))
    texts += [changed(base, 7) for _ in range(250)]
    sets = [plain_shingles(" ".join(t)) for t in texts]
    good = [(i, j) for i, j in pairs if similarity(sets[i], sets[j]) >= 0.8]
    df = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in near_copies.without_near_copies(df.repartition(4)).collect()}
    assert len(good) > 200 and sum(not (i in kept and j in kept) for i, j in good) >= 0.97 * len(good)


def test_texts_with_one_key_are_not_taken_for_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(near_copies.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else real(*c))
    rows = [(1, "one text of its own that is here"), (2, "quite another one with other words"), (3, "one text of its own that is here")]
    got = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_all_pairs_across_groups_are_found():
    import numpy as np

    from terrafold.llm import simhash_index as ix

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    codes = np.concatenate([base, *[b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (6, 60)).astype(np.uint64)) for b in base]])
    codes = np.concatenate([codes, codes[:30]])
    of = rng.integers(0, 5, len(codes))
    order = np.argsort(ix.gray_rank(codes), kind="stable")
    codes, of = codes[order], of[order]
    limits = ix.shares(0, 8)
    got = {(min(i, j), max(i, j)) for a, b in ix.pairs_across(codes, of, limits) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if of[i] != of[j] and all(bin(int((codes[i] ^ codes[j]) & m)).count("1") <= most for m, most in limits)}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("most", [2048, 60])
def test_groups_are_joined_without_a_row_for_each_pair(spark, monkeypatch, most):
    """Two families, each text a group of its own: rows are fewer than texts in each task, and join what all candidate pairs join."""
    from terrafold.operators.components import connected_components

    monkeypatch.setattr(near_copies, "TILE_TEXTS", most)
    rnd = random.Random(5)
    texts, whole = [], []
    for f, (size, changes) in enumerate([(200, 5), (40, 8)]):
        base = [f"b{f}x{i}" for i in range(300)]
        for _ in range(size):
            w = list(base)
            for i in rnd.sample(range(300), rnd.randint(1, changes)):
                w[i] = f"z{rnd.randrange(10**7)}"
            texts.append(" ".join(w))
            whole.append(f)
    sets = [near_copies.shingles(t) for t in texts]
    prints = [near_copies.prints(s) for s in sets]
    again = spark.createDataFrame([(i, len(s), p, w, i) for i, (s, p, w) in enumerate(zip(sets, prints, whole, strict=True))], "key long, n long, prints array<long>, whole long, of long")
    got = near_copies.joining(again, spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()
    bits = lambda i, j: [bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(prints[i], prints[j], strict=True)]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if whole[i] == whole[j] and min(b := bits(i, j)) <= near_copies.DISTANCE and sum(b) <= near_copies.APART and similarity(sets[i], sets[j]) >= 0.8]
    parts = lambda pairs: {(r.node, r.component) for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert len(want) > 10_000 and parts([(r.a, r.b) for r in got]) == parts(want)
    assert all(similarity(sets[r.a], sets[r.b]) >= 0.8 for r in got)
    assert len(got) < len(texts) * (1 if most > 200 else 4)
