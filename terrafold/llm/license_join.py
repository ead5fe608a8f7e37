"""License texts by an exact set-similarity join, with Spark's own functions only.

Text blocks are runs of words that overlap by half, whatever the line breaks, so a notice lies whole in
one; a template is the word set of a notice. A block meets a template if it holds at least THRESHOLD of the template's words. Words are
ordered by how many documents of the whole table hold them, rarest first; a
block that meets a template must hold one of the template's first words (prefix
filter), have words enough (length filter), and have words enough left behind
the first one in common (positional filter). What passes is counted out. Notices
of one family differ in a word or two: a block gets a template's label if it also holds the phrases that tell it
from the others, and of all templates it meets only the best one's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: A notice of so many words, at most, is looked for in blocks of twice as many.
LENGTHS = (16, 64)
# The phrases that the base scan names, with their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_GNU = "you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation either {1} of the license or at your option any later version"
# Licenses by the public wording of their notices, with the phrases that tell them apart.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
# Families whose members differ in a name and a version: label, name and version.
GNU = (
    ("gpl-2.0", "program", "gnu general public license", "version 2"), ("gpl-3.0", "program", "gnu general public license", "version 3"),
    ("lgpl-2.1", "library", "gnu lesser general public license", "version 2 1"), ("lgpl-3.0", "library", "gnu lesser general public license", "version 3"),
    ("agpl-3.0", "program", "gnu affero general public license", "version 3"),
)
CREATIVE_COMMONS = (
    ("cc-by", "attribution", "cc by"), ("cc-by-sa", "attribution sharealike", "cc by sa"), ("cc-by-nd", "attribution noderivatives", "cc by nd"), ("cc-by-nc", "attribution noncommercial", "cc by nc"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", "cc by nc sa"), ("cc-by-nc-nd", "attribution noncommercial noderivatives", "cc by nc nd"),
)


def notices() -> list[tuple[str, str, tuple[str, ...]]]:
    """Label, notice and the phrases that tell it apart, of each template."""
    out = list(NOTICES)
    for label, what, name, version in GNU:
        out.append((label, f"this {what} is free software " + _GNU.format(name, version), (name, f"either {version} of")))
        out.append((label, f"licensed under the {name} {version}", (f"{name} {version}",)))
    for label, name, short in CREATIVE_COMMONS:
        out.append((f"{label}-4.0", f"licensed under a creative commons {name} 4 0 international license", (f"creative commons {name} 4 0",)))
        out.append((f"{label}-4.0", f"licensed under {short} 4 0", (f"{short} 4 0",)))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order, A to Z in lower case; none of an empty one."""
    line = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BETWEEN, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def template_sets() -> list[tuple[int, str, list[str], int, int, list[str]]]:
    """Number, label, distinct words, the least number in common, the length class, and the telling phrases, of each template."""
    out = []
    for i, (label, notice, keys) in enumerate(notices()):
        words = list(dict.fromkeys(notice.split()))
        length = next(x for x in LENGTHS if x >= len(notice.split()))
        out.append((i, label, words, math.ceil(THRESHOLD * len(words) - 1e-9), length, [f" {k} " for k in keys]))
    return out


def phrase_places(words: Column) -> Column:
    """All places, from 0, where a base phrase stands, once for each phrase."""

    def at(phrase: str) -> Column:
        first, *rest = phrase.split()

        def here(w: Column, i: Column) -> Column:
            hit = w == first
            for k, x in enumerate(rest, 1):
                hit = hit & F.coalesce(F.get(words, i + k) == x, F.lit(False))
            return F.when(hit, i)

        return F.filter(F.transform(words, here), lambda i: i.isNotNull())

    return F.concat(*[at(p) for p in BASE_PHRASES])


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of documents of ``docs`` (with ``words``) that hold them, rarest first, ties by word."""
    held = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), F.col("words"))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in held.collect()}  # as many rows as the vocabulary has words, at most
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matching_blocks(docs: DataFrame, order: list[str]) -> DataFrame:
    """id, text_hash, label, contained: for each text block that meets templates, the best one: most of its words in common, then the longest, then by label."""
    spark = docs.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    rows, prefixes = [], set()
    for number, label, words, need, length, keys in template_sets():
        ordered = sorted(words, key=rank.__getitem__)
        for place, word in enumerate(ordered[: len(words) - need + 1]):
            rows.append((word, length, number, label, place, need, ordered, keys))
            prefixes.add(word)
    index = spark.createDataFrame(rows, "word string, length int, template int, label string, place int, need int, template_words array<string>, keys array<string>")
    first_words = [w for w in order if w in prefixes]
    near = docs.filter(F.arrays_overlap(F.col("words"), F.lit(first_words)))
    runs = F.concat(*[_starts(n) for n in LENGTHS])
    blocks = near.select("id", "text_hash", "words", F.explode(runs).alias("run")).select("id", "text_hash", "run.length", "run.start", F.expr("slice(words, run.start + 1, 2 * run.length)").alias("held"))
    # Of a block's words only those of the templates can be in common: they stand in global order.
    blocks = blocks.withColumn("firsts", F.array_intersect(F.lit(first_words), F.col("held"))).filter(F.size("firsts") > 0)
    blocks = blocks.withColumns({"shared": F.array_intersect(F.lit(order), F.col("held")), "n": F.size(F.array_distinct("held")), "spaced": F.concat(F.lit(" "), F.array_join("held", " "), F.lit(" "))})
    tokens = blocks.select("id", "text_hash", "length", "start", "n", "shared", "spaced", F.explode("firsts").alias("word"))
    pairs = tokens.join(F.broadcast(index), ["word", "length"]).filter(F.col("n") >= F.col("need"))
    common = F.array_intersect("template_words", "shared")
    # The first word in common: what stands before it, on either side, is not in common.
    left = F.least(F.size("shared") - F.array_position("shared", F.col("word")) + 1, F.size("template_words") - F.col("place"))
    met = pairs.filter(left >= F.col("need")).withColumn("common", common).filter((F.col("common")[0] == F.col("word")) & (F.size("common") >= F.col("need")))
    met = met.filter(F.forall("keys", lambda k: F.contains(F.col("spaced"), k)))
    found = F.struct((F.size("common") / F.size("template_words")).alias("contained"), F.size("template_words").alias("size"), (-F.col("template")).alias("first"), "label")
    best = met.groupBy("id", "text_hash", "length", "start").agg(F.max(found).alias("b"))
    return best.select("id", "text_hash", "b.label", "b.contained")


def _starts(n: int) -> Column:
    """Where the blocks of a length class begin: every n words."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(n)), lambda i: F.struct(F.lit(n).alias("length"), i.alias("start")))


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    A null text is read as empty: no words, empty labels, score 0, null places. Score is 1
    where a base phrase stands, else the largest share of a template that a
    block holds, 0 if none meets the threshold. Rows that repeat have equal
    results; a null id is an id; an empty table gives an empty result; other columns take no part.
    """
    given = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = given.select("id", "text", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    order = global_order(docs, sorted({w for _, _, words, *_ in template_sets() for w in words}))
    found = matching_blocks(docs, order).groupBy("id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))

    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    named = F.rlike(spaced, F.lit(" (" + "|".join(BASE_PHRASES) + ") "))
    base = docs.withColumn("places", F.when(named, phrase_places(F.col("words"))).otherwise(F.array().cast("array<int>")))
    labels = [F.when(F.contains(spaced, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE_PHRASES.items()]
    base = base.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), "places", F.when(named, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")).alias("own"))
    both = base.alias("b").join(found.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.text_hash") == F.col("f.text_hash")), "left")
    all_labels = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select(
        F.col("b.id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("own"), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB, every block held against every template of its length."""
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '{_BETWEEN}', ' ', 'g'))"
    words = lambda s: f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END"
    at = lambda p: "list_filter(range(len(ws)), lambda i: " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split(), 1)) + ")"
    places = "list_concat(" + ", list_concat(".join(at(p) for p in BASE_PHRASES) + ", []" + ")" * len(BASE_PHRASES)
    own = "list_filter([" + ", ".join(f"CASE WHEN contains(' ' || s || ' ', ' {p} ') THEN '{x}' END" for p, x in BASE_PHRASES.items()) + "], lambda x: x IS NOT NULL)"
    values = ", ".join(f"({i}, '{label}', {ws!r}, {need}, {length}, {keys!r})" for i, label, ws, need, length, keys in template_sets())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT r, doc_id, {norm("t")} AS s FROM d),
w AS (SELECT r, doc_id, s, {words("s")} AS ws FROM n),
b AS (SELECT r, doc_id, len(ws) AS n_words, {places} AS places, {own} AS own FROM w),
t(i, label, ws, need, length, keys) AS (VALUES {values}),
runs AS (SELECT r, length, unnest(range(0, greatest(len(ws), 1), length)) AS start, ws FROM w, (SELECT DISTINCT length FROM t)),
held AS (SELECT r, length, start, list_distinct(ws[start + 1 : start + 2 * length]) AS ws, ' ' || array_to_string(ws[start + 1 : start + 2 * length], ' ') || ' ' AS s FROM runs),
m AS (SELECT r, label, len(list_intersect(t.ws, held.ws)) / len(t.ws) AS contained, row_number() OVER (PARTITION BY r, length, start ORDER BY len(list_intersect(t.ws, held.ws)) / len(t.ws) DESC, len(t.ws) DESC, i) AS best
      FROM held JOIN t USING (length) WHERE contains(held.s, keys[1]) AND contains(held.s, keys[-1]) AND len(list_intersect(t.ws, held.ws)) >= need),
g AS (SELECT r, list(DISTINCT label) AS more, max(contained) AS contained FROM m WHERE best = 1 GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(own), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN g USING (r)"""
