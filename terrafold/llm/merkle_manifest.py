"""Merkle manifest of a table of documents: a tree for each source, one tree above their roots, and a proof for every row.

The trees are worked through in time-forward order. A node's label is the last leaf below it, then its level, so
children come before their parent. A priority queue ordered by label hands digests from children to parents;
a reversed sweep hands each node's proof suffix to its children. Trees are cut into blocks of aligned runs of
leaves: the shuffle, sorted by tree, block and place, is the external queue between blocks, and the queue of a task holds a run for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.session import scratch_path, ship_package

#: Children of a node, levels of a block, leaves of a block.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Rows of one batch of results.
ROWS_OUT = 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of a row: its fields in order, each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    texts = [fields[c].cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row is one that the audit tampers with: 5 divides crc32 of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def forward(leaves: list[str], height: int) -> dict[tuple[int, int], list[str]]:
    """(level, index) of each node above ``leaves`` and its children's digests, in time-forward order. The root has level ``height``."""
    kids, queue, last = {}, [], len(leaves) - 1

    def send(level: int, child: int, value: str) -> None:
        node = child // FAN
        heappush(queue, (min((node + 1) * FAN**level - 1, last), level, node, child, value))

    for now, value in enumerate(leaves):
        if height:
            send(1, now, value)
        while queue and queue[0][0] <= now:
            _, level, node = label = queue[0][:3]
            got = kids[level, node] = []
            while queue and queue[0][:3] == label:
                got.append(heappop(queue)[4])
            if level < height:
                send(level + 1, node, digest(got))
    return kids


def backward(count: int, height: int, kids: dict[tuple[int, int], list[str]], suffix: str) -> Iterator[tuple[int, str]]:
    """(leaf, proof) in reversed order of labels. A proof has a part for each level, from the leaf's up: the siblings before, ``.``, those behind, ``/``."""
    last = count - 1
    queue = [(-last, -height, 0, suffix)]
    while queue:
        _, level, node, proof = heappop(queue)
        if not level:
            yield -node, proof
            continue
        got = kids[-level, -node]
        for c, below in enumerate(got):
            child = -node * FAN + c
            end = min((child + 1) * FAN ** (-level - 1) - 1, last)
            heappush(queue, (-end, level + 1, -child, "".join(got[:c]) + "." + "".join(got[c + 1 :]) + "/" + proof))


def fold(value: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for part in proof.split("/")[:-1]:
        before, _, behind = part.partition(".")
        value = digest([before, value, behind])
    return value


def height_of(count: int, alone: bool) -> int:
    """Levels of a block: all, or as many as its leaves need if the tree has no other block."""
    if not alone:
        return LEVELS
    height = 0
    while count > 1:
        count, height = -(-count // FAN), height + 1
    return height


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows``, written, with ``pos``: the place of each in its ``tree`` by ``order`` (nulls first), from 0.

    Rows are dealt by ranges of tree and order, so a large tree lies in many tasks. Each task numbers its own; only the first tree
    of a task can have begun before, and what it had by then is one row a task.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    sorted_ = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, run, at = TaskContext.get().partitionId(), (), -1, 0
        for batch in batches:
            names, run_of, at_of = batch.column(tree).to_pylist(), [], []
            for name in names:
                if (name,) != before:
                    before, run, at = (name,), run + 1, 0
                run_of.append(run)
                at_of.append(at)
                at += 1
            more = [pa.array(np.full(len(names), part, np.int32)), pa.array(run_of, pa.int64()), pa.array(at_of, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__part", "__run", "__at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __part int, __run long, __at long"
    path = scratch_path(spark, "merkle-placed")
    sorted_.mapInArrow(number, schema).write.parquet(path)
    numbered = spark.read.parquet(path)
    # One row a task and tree; of a tree no more rows than there are tasks.
    counts = numbered.groupBy(tree, "__part", "__run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).filter("__run = 0").select("__part", "__run", "__before")
    found = numbered.join(F.broadcast(starts), ["__part", "__run"], "left")  # one row a task
    return found.withColumn("pos", F.col("__at") + F.coalesce("__before", F.lit(0))).drop("__part", "__run", "__at", "__before")


def in_blocks(nodes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``nodes`` (tree, pos, digest, ...) dealt by block and sorted by tree, block and place, with what is sent to a block ahead of its nodes:
    kind 0 that the tree has more blocks, kind 1 the rows of ``extra`` (tree, block, ...), kind 2 the nodes."""
    own = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("kind", F.lit(2))
    more = nodes.filter(F.col("pos") == BLOCK).select("tree", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"))
    rows = own.unionByName(more, allowMissingColumns=True)
    if extra is not None:
        rows = rows.unionByName(extra.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, dict | None, list[dict]]]:
    """((tree, block), whether the tree has no other, the row sent to it, its nodes) of sorted rows."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        alone, sent, nodes = key[1] == 0, None, []
        for r in group:
            if r["kind"] == 0:
                alone = False
            elif r["kind"] == 1:
                sent = r
            else:
                nodes.append(r)
        yield key, alone, sent, nodes


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and (tree, digest) of the roots. ``nodes``: tree, pos, digest of the leaves. A round takes blocks to their roots; a tree of one node stays as it is."""
    spark = nodes.sparkSession

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (tree, block), alone, _, leaves in blocks_of(batches):
                values = [r["digest"] for r in leaves]
                height = height_of(len(values), alone)
                kids = forward(values, height)
                yield tree, block, digest(kids[height, 0]) if height else values[0], alone

        yield from batched(rows(), UP)

    rounds = [nodes]
    while True:
        path = scratch_path(spark, "merkle-round")
        in_blocks(rounds[-1].select("tree", "pos", "digest")).mapInArrow(up, "tree string, pos long, digest string, alone boolean").write.parquet(path)
        made = spark.read.parquet(path)
        if made.filter(~F.col("alone")).isEmpty():
            return rounds, made.select("tree", "digest")
        rounds.append(made.select("tree", "pos", "digest"))


UP = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("alone", pa.bool_())])
DOWN = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("name", pa.string()), ("digest", pa.string()), ("proof", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
DONE = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, str]]:
    """(node, row sent to its block, proof) of each node of sorted rows, in each block from the last to the first."""
    for _, alone, sent, leaves in blocks_of(batches):
        height = height_of(len(leaves), alone)
        for at, proof in backward(len(leaves), height, forward([r["digest"] for r in leaves], height), sent["proof"]):
            yield leaves[at], sent, proof


def descend(rounds: list[DataFrame], sent: DataFrame) -> DataFrame:
    """Rows that hand each first-round block its proof, from ``sent`` for the roots: the reversed sweep of all rounds but the first."""
    spark = sent.sparkSession

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((r["tree"], r["pos"], s["name"], r["digest"], proof, s["subroot"], s["root"]) for r, s, proof in proofs(batches)), DOWN)

    for nodes in reversed(rounds[1:]):
        path = scratch_path(spark, "merkle-sweep")
        in_blocks(nodes, sent.drop("digest")).mapInArrow(down, ddl(DOWN)).write.parquet(path)
        sent = spark.read.parquet(path)
    return sent


def manifest(df: DataFrame) -> DataFrame:
    """One row for each of ``df`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of a row. Leaves of a source ascend by doc_id, null first, rows with
    one id by their digest; runs of 16 become a node until one is left, the subroot.
    Subroots, by source, null first, give the root in the same way. ``folded_root`` is recomputed from the
    leaf, or where ``tampered`` from that of the text in small letters, and the proof; ``verified`` tells whether it is the root.

    Nulls are values of their own, an empty text is not a null one; repeated rows are leaves of their own. A text of any length is one
    digest. An empty table gives no row. Other columns take no part.
    """
    spark = df.sparkSession
    ship_package(spark)
    of = {c: F.col(c) for c in FIELDS}
    changed = tampered(F.col("doc_id")) & F.col("text").rlike("[A-Z]")
    other = F.when(changed, leaf_of(of | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}))
    path = scratch_path(spark, "merkle-leaves")
    df.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(of).alias("digest"), other.alias("other")).write.parquet(path)
    leaves = placed(spark.read.parquet(path), "tree", ["doc_id", "digest"])
    rounds, subroots = climb(leaves)
    # The tree above: its leaves are the subroots by source.
    top = placed(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("digest")), "all", ["name"]).withColumnRenamed("all", "tree")
    top_rounds, roots = climb(top)
    whole = lambda name, digest_, root: [F.lit(0).cast("long").alias("block"), name.alias("name"), digest_.alias("digest"), F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot"), root.alias("root")]
    sent = descend(top_rounds, roots.select("tree", *whole(F.lit(None).cast("string"), F.col("digest"), F.col("digest"))))

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((r["name"], 0, None, r["digest"], proof, r["digest"], s["root"]) for r, s, proof in proofs(batches)), DOWN)

    path = scratch_path(spark, "merkle-sweep")
    in_blocks(top.select("tree", "pos", "name", "digest"), sent.drop("digest", "name")).mapInArrow(handed, ddl(DOWN)).write.parquet(path)
    sent = descend(rounds, spark.read.parquet(path))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for r, s, proof in proofs(batches):
                folded = fold(r["other"] or r["digest"], proof)
                yield r["doc_id"], r["digest"], s["subroot"], s["root"], digest([proof.replace("/", "").replace(".", "")]), folded, folded == s["root"]

        yield from batched(rows(), DONE)

    return in_blocks(leaves, sent.drop("digest", "name")).mapInArrow(checked, ddl(DONE))


def oracle() -> str:
    """The same in DuckDB's SQL, for sources of at most 16^6 rows and as many sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {step})"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {byte}), CAST(4294967295 AS BIGINT))"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"k AS (SELECT row_number() OVER () AS id, source, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS h FROM documents)",
        "s0 AS (SELECT id, doc_id, leaf, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d, h AS folded, '' AS proof FROM k)",
    ]
    # A level: each node's run, its hash, and what a leaf's proof and folded digest become.
    def level(now: str, key: str) -> list[str]:
        return [
            f"{now}n AS (SELECT DISTINCT {key} AS t, pos, d FROM {now})",
            f"{now}r AS (SELECT t, pos // 16 AS run, list(d ORDER BY pos) AS ds, count(*) OVER (PARTITION BY t) AS runs FROM {now}n GROUP BY t, pos // 16)",
        ]

    out, now = [], "s0"
    for i in range(12):
        key, nxt = ("source" if i < 6 else "0"), f"s{i + 1}"
        if i == 6:
            out.append(f"u AS (SELECT *, d AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM {now})")
            out.append("v AS (SELECT id, doc_id, leaf, source, place AS pos, d, folded, proof, subroot FROM u)")
            now = "v"
        sub = ", subroot" if i >= 6 else ""
        out += level(now, key)
        many = "(r.runs > 1 OR len(r.ds) > 1)"
        j = "CAST(a.pos % 16 AS BIGINT)"
        before, behind = f"array_to_string(r.ds[1:{j}], '')", f"array_to_string(r.ds[{j} + 2:], '')"
        out.append(
            f"{nxt} AS (SELECT id, doc_id, leaf, source, a.pos // 16 AS pos, CASE WHEN {many} THEN sha256(array_to_string(r.ds, '')) ELSE a.d END AS d, "
            f"CASE WHEN {many} THEN sha256(concat({before}, folded, {behind})) ELSE folded END AS folded, CASE WHEN {many} THEN concat(proof, {before}, {behind}) ELSE proof END AS proof{sub} "
            f"FROM {now} a JOIN {now}r r ON r.t IS NOT DISTINCT FROM {'a.' + key if i < 6 else key} AND r.run = a.pos // 16)"
        )
        now = nxt
    return "WITH " + ",\n".join(parts + out) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM {now}"
