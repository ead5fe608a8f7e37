"""The toxicity field: marginals against all labellings, tokens against a plain reader, held-out labels, odd rows."""

import itertools
import math
import random
import re
import zlib

import numpy as np

from terrafold.llm import toxic_spans as m

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_all_labellings(field, e):
    """Marginals of one sentence by the sum over every labelling."""
    stay, enter, leave, keep = field.moves
    total, on = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        s = (enter if y[0] else stay) + e[0] * y[0]
        s += sum(((stay, enter), (leave, keep))[a][b] + b * x for a, b, x in zip(y, y[1:], e[1:], strict=False))
        total += math.exp(s)
        on += np.array(y) * math.exp(s)
    return on / total


def test_marginals():
    rng = np.random.default_rng(1)
    field = m.Field(np.zeros(3), 0.0, np.array([0.5, -0.6, 0.2, 1.1]))
    sizes = [1, 7, 2, 10, 5]
    first = np.concatenate([np.arange(n) == 0 for n in sizes])
    e = rng.normal(0, 2, len(first))
    want = np.concatenate([by_all_labellings(field, x) for x in np.split(e, np.cumsum(sizes)[:-1])])
    assert np.allclose(m.marginals(field, e, first), want)
    # A long sentence goes token by token, short ones side by side.
    e, first = rng.normal(0, 2, 700), np.arange(700) == 0
    some = m.marginals(field, e, first)
    m.LANES_UP_TO, old = 10_000, m.LANES_UP_TO
    try:
        assert np.allclose(m.marginals(field, e, first), some)
    finally:
        m.LANES_UP_TO = old


def test_training_follows_the_slope_of_the_likelihood():
    rng = random.Random(2)
    words = [rng.randrange(40) for _ in range(3000)]
    cells = np.array([words])
    labels = np.array([w < 3 for w in words])
    first = np.arange(3000) % 10 == 0
    f = m.train(cells, first, labels, steps=80, bits=10)
    p = m.marginals(f, f.emissions(cells), first)
    assert (p[labels] > 0.8).all() and (p[~labels] < 0.2).all()


def test_tokens():
    texts = ["An Idiot's é! Été—x\nñ", "", "1 2, 3", "Z" * 30 + ". End"]
    t, joined = m.Tokens(texts), "\n".join(texts)
    words = [(x.start(), x.end()) for x in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+", joined)]
    assert list(zip(t.start.tolist(), t.end.tolist(), strict=True)) == words
    assert t.doc.tolist() == [joined[: a].count("\n", 0, a) - (1 if a > joined.index("ñ") - 1 else 0) if a <= joined.index("ñ") else 3 for a, _ in words]
    again = m.Tokens(["x idiotic IDIOT"])
    one = m.Tokens(["idiot"])
    assert (again.keys[0, 2] == one.keys[0, 0]) and again.keys[1, 1] == one.keys[1, 0] and again.keys[0, 1] != one.keys[0, 0]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    good = ["".join(rng.choice("abdeghiklmnoprstuv") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(good) for _ in range(rng.randrange(20, 80))]
        if bad:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["wretch", "Fiend", "zorkling", "zorklers", "zorkle" + rng.choice("abcdefgh")]))
        docs.append((i, " ".join(w + ("." if rng.random() < 0.1 else "") for w in words), "en", "s", 1))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents_and_offsets(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in m.toxicity_report(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = dict(labels)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    assert sum(got[i].predicted == truth[i] for i in out) >= 0.95 * len(out)
    text = {d[0]: d[1] for d in docs}
    found = {text[i][int(a) : int(b)].lower() for i, r in got.items() for a, b in (s.split(":") for s in r.spans.split(",") if s)}
    assert {"wretch", "fiend", "zorkling"} <= {w for f in found for w in f.split()}
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs, labels = corpus(400)
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    other = [(i, t, "xx", f"s{i % 3}", None) for i, t, *_ in docs]
    kind = "doc_id long, toxic int"
    a = m.toxicity_report(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(labels, kind)).collect()
    b = m.toxicity_report(spark.createDataFrame(other, DOCS).coalesce(1), spark.createDataFrame(flip, kind)).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in a) == sorted((r.doc_id, round(r.score, 6)) for r in b)


def test_odd_rows(spark):
    docs, labels = corpus(300)
    long = "plain words here. " * 90_000 + "You fiend wretch. " + "no end " * 60_000
    odd = [(None, None, None, None, None), (None, "fiend wretch zorklers", None, None, None), (7000, "", "en", "s", 0), (7001, None, "en", "s", 0), (7002, long, "en", "s", 1), (0, docs[0][1], "en", "s", 1), (0, "other text of it", "en", "s", 1)]
    labelled = labels + [(None, 1), (5, None), (1, labels[1][1]), (99_999, 1), (99_999, 0)]
    df = spark.createDataFrame(docs + odd, DOCS).selectExpr("*", "1 AS score", "'x' AS spans", "2 AS predicted", "3 AS shard", "4 AS toxic")
    got = m.toxicity_report(df, spark.createDataFrame(labelled, "doc_id long, toxic int").selectExpr("*", "'q' AS text", "1 AS quality")).collect()
    assert len(got) == len(docs) + len(odd)
    by = {(r.doc_id, r.spans) for r in got}
    at = len("plain words here. " * 90_000)
    spans = next(r.spans for r in got if r.doc_id == 7002)
    assert all(at <= int(x) <= at + 17 for s in spans.split(",") for x in s.split(":")) and spans
    assert (7000, "") in by and (7001, "") in by
    kinds = "doc_id long, toxic int"
    assert {(r.score, r.predicted) for r in m.toxicity_report(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([], kinds)).collect()} == {(0.0, 0)}
    assert m.toxicity_report(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, kinds)).count() == 0
