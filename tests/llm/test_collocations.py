"""Collocations against plain counting of every run."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from terrafold.llm import collocations as m

DOCS = "doc_id long, text string, lang string"


def plain(rows, least, replaced=80, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        small = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", small):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cands = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, g), a in cands.items():
        longer = (b for (of, x), b in cands.items() if of == lang and len(x) > len(g) and any(x[i : i + len(g)] == g for i in range(len(x))))
        if any(100 * b >= replaced * a for b in longer):
            continue
        score, at = min((2_000_000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), counts[lang, g[:at]], counts[lang, g[at:]]))
    found = []
    for lang, some in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(found)


def texts(seed=0, docs=120):
    rng = random.Random(seed)
    passage = [" ".join(f"p{i}q{j}" for j in range(9)) for i in range(6)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(40, 120)):
            words.append(rng.choice(["Ash", "birch", "CEDAR", "Élan", "oak", "é", "nbsp word"]) + rng.choice([" ", " ", "\t ", "  ", ". ", ", ", "\n", ";", "\x0b", ":"]))
            if rng.random() < 0.05:
                words.append(rng.choice(passage) + rng.choice([" ", "! "]))
            if rng.random() < 0.1:
                words.append("ha " * rng.randrange(1, 12))
            if rng.random() < 0.2:
                words.append(f"rare{rng.randrange(10**6)} ")
        rows.append((i, "".join(words), rng.choice(["en", "en", "de", "", None, "und"])))
    return rows


@pytest.mark.parametrize("bits", [22, 3])  # a sketch that overflows cuts nothing
def test_same_as_counting_all(spark, bits):
    rows = texts() + [(1000, None, "en"), (1001, "", None), (1002, " .,; ", "xx"), (None, "lonely words", "yy"), (0, "ash birch " * 30, "zz"), (0, "ash birch " * 30, "zz")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS rank", "'x' AS phrase", "2 AS n", "3 AS k").repartition(6)
    got = m.collocations(df, least=8, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words"]
    assert sorted(tuple(r)[:8] for r in got.collect()) == plain(rows, 8)


def test_top_and_share(spark):
    rows = texts(3)
    got = m.collocations(spark.createDataFrame(rows, DOCS), least=5, replaced=50, top=7, bits=20)
    assert sorted(tuple(r)[:8] for r in got.collect()) == plain(rows, 5, 50, 7)


def test_paths(spark):
    rows = [(i, f"x{i} the fixed passage of eight words stands here. ring one two ring one two ring one two", "en") for i in range(10)]
    got = {r.phrase: r.path_words for r in m.collocations(spark.createDataFrame(rows, DOCS), least=10, bits=20).collect()}
    assert got["the fixed passage of"] == 8
    assert got["ring one two ring"] == 6  # three edges that form a ring


def test_very_long_texts_and_no_table(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE_BYTES", 1000)
    lots = list(m.read_texts(iter([pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": ["one two, " * 1000, "x " * 3000]})])))
    assert sum(len(w.ids) for w in lots) == 5000 and len(lots) > 5
    rows = [(1, "one two three, " * 400_000 + "no break " * 300_000, "en")]
    got = m.collocations(spark.createDataFrame(rows, DOCS), bits=20)
    assert sorted(tuple(r)[:8] for r in got.collect()) == plain(rows, 30)
    assert m.collocations(spark.createDataFrame([], DOCS), bits=20).count() == 0
