"""The Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from terrafold.llm import merkle_manifest as m

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def levels(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    """(before, behind) for each level."""
    out = []
    for nodes in tree[:-1]:
        run = at // 16 * 16
        out.append((nodes[run:at], nodes[at + 1 : run + 16]))
        at //= 16
    return out


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, (_, _, digest, r) in enumerate(by[s]):
            path = siblings(trees[s], at) + siblings(top, place)
            value = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                value = leaf(r[0], "".join(c.lower() if c.isascii() else c for c in r[1]), *r[2:])
            for before, behind in path:
                value = h(*before, value, *behind)
            root = top[-1][0]
            out.append((r[0], digest, trees[s][-1][0], root, h(*[x for p in path for part in p for x in part]), value, value == root))
    return out


def same(spark, rows):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS leaf", "1 AS pos", "2 AS tree", "3 AS block").repartition(5)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = m.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_trees_of_every_shape(spark):
    rows = [(i, f"Text {i}", "en", "hot", 6) for i in range(4096 + 273)]  # more than one block, the last of an odd size
    rows += [(10_000 + i, f"T {i}", None, "full", None) for i in range(4096)]  # exactly one block
    rows += [(20_000 + i, "Same", "de", f"s{n}", 4) for n in (1, 2, 15, 16, 17, 256, 257) for i in range(n)]
    rows += [(30_000 + i, None, None, f"one{i}", None) for i in range(40)]  # sources of one row, and a top tree of two levels
    same(spark, rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0), (5, "A", "en", None, 1)]
    rows += [(6, "É ß ZÜ\n" * 200_000, "de", "", 7), (7, "a:1-", "en", "-", 4), (-8, "Ab", "en", "ä", 2), (8, "Ab", "en", "z", 2)]
    rows += [(i, "NUR GROSS", "de", "ä", 9) for i in range(60)]
    same(spark, rows)


def test_one_row_none_and_no_table(spark):
    same(spark, [(1, "Only", "en", "s", 4)])
    assert m.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_only_changed_texts_fail(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", f"s{i % 3}", 5) for i in range(300)]
    got = m.manifest(spark.createDataFrame(rows, DOCS)).filter(~F.col("verified")).select("doc_id").collect()
    assert {r.doc_id for r in got} == {i for i in range(1, 300, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
