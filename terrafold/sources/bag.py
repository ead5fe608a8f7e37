"""Recorded message bags (SQLite files of topics and messages) as data sources: batch and streaming readers, writers that show their files only once all are whole, and the catalogue of topics.

Paths may be of any file system that pyarrow opens by URI. A bag on the machine's own or a mounted one is read in place, in ranges of ids; others are read into memory, a file at once.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "file string, id long, topic string, type string, timestamp long, data binary"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def find_bags(path: str) -> list[str]:
    """The file itself, or the .db3 files of a folder by name; none is an error."""
    files, place = _fs(path)
    info = files.get_file_info(place)
    if info.type == pafs.FileType.File:
        found = [path]
    else:
        inside = files.get_file_info(pafs.FileSelector(place, allow_not_found=True))
        found = sorted(f"{path.rstrip('/')}/{x.base_name}" for x in inside if x.type == pafs.FileType.File and x.base_name.endswith(".db3"))
    if not found:
        raise FileNotFoundError(f"no bag at {path}")
    return found


#: Messages that one partition reads.
MESSAGES = 100_000
TOPICS = "file string, topic string, type string, n long"


@dataclass
class _Part(InputPartition):
    path: str
    low: int = 0
    high: int = 0


def _open(path: str) -> sqlite3.Connection:
    files, place = _fs(path)
    if isinstance(files, pafs.LocalFileSystem):
        return sqlite3.connect(f"file:{place}?mode=ro", uri=True)
    db = sqlite3.connect(":memory:")
    with files.open_input_file(place) as f:
        db.deserialize(f.read())
    return db


def _ranges(path: str, above: int | None, upto: int | None, most: int) -> list[_Part]:
    """Ranges of ids behind ``above`` and up to ``upto`` with ``most`` messages each, wherever the ids lie."""
    db, out = _open(path), []
    try:
        if upto is None:
            upto = db.execute("SELECT max(id) FROM messages").fetchone()[0]
        low = db.execute("SELECT min(id) FROM messages WHERE ? IS NULL OR id > ?", (above, above)).fetchone()[0]
        while low is not None and upto is not None and low <= upto:
            after = db.execute("SELECT id FROM messages WHERE id >= ? AND id <= ? ORDER BY id LIMIT 1 OFFSET ?", (low, upto, most)).fetchone()
            out.append(_Part(path, low, after[0] - 1 if after else upto))
            low = after[0] if after else None
    finally:
        db.close()
    return out


def _messages(part: _Part, topics: set | None = None) -> Iterator[tuple]:
    db = _open(part.path)
    try:
        sql, args = "SELECT m.id, t.name, t.type, m.timestamp, m.data FROM messages m JOIN topics t ON m.topic_id = t.id WHERE m.id BETWEEN ? AND ?", [part.low, part.high]
        if topics is not None:
            args += sorted(topics)
            sql += f" AND t.name IN ({', '.join('?' * len(topics))})"
        for row in db.execute(sql + " ORDER BY m.id", args):
            yield (part.path, *row)
    finally:
        db.close()


class BagReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.topics = path, most, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",):
                self.topics = {f.value} & (self.topics if self.topics is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("topic",):
                self.topics = set(f.value) & (self.topics if self.topics is not None else set(f.value))
            else:
                yield f

    def partitions(self):
        return [part for p in find_bags(self.path) for part in _ranges(p, None, None, self.most)]

    def read(self, partition):
        return _messages(partition, self.topics)


class BagStreamReader(DataSourceStreamReader):
    """What is added to a folder of bags, to files that grow and as new files. An offset is the last id of each file."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self):
        return {}

    def latestOffset(self):
        ends = {}
        try:
            found = find_bags(self.path)
        except FileNotFoundError:
            found = []
        for p in found:
            db = _open(p)
            try:
                ends[p] = db.execute("SELECT max(id) FROM messages").fetchone()[0]
            finally:
                db.close()
        return {p: n for p, n in sorted(ends.items()) if n is not None}

    def partitions(self, start, end):
        return [part for p, n in sorted(end.items()) if n != start.get(p) for part in _ranges(p, start.get(p), n, self.most)]

    def read(self, partition):
        return _messages(partition)

    def commit(self, end):
        pass


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    name: str | None


class _Writer:
    """Each task makes a bag in a folder of its own job below the target, out of readers' sight; the driver moves all of them into place once every task is done, or removes them."""

    def __init__(self, path: str, topics: list[list[str]]):
        self.path, self.topics, self.job = path.rstrip("/"), topics, uuid.uuid4().hex

    def make(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        own = tempfile.mkdtemp(prefix="bag-")
        local, n = os.path.join(own, "bag.db3"), 0
        try:
            db = sqlite3.connect(local)
            db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
            db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
            db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(i, t, k) for i, (t, k) in enumerate(self.topics, 1)])
            at = {t: i for i, (t, _) in enumerate(self.topics, 1)}
            for batch in batches:
                ids, names, stamps, data = (batch.column(c).to_pylist() for c in ("id", "topic", "timestamp", "data"))
                db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", zip(ids, [at[t] for t in names], stamps, data, strict=True))
                n += len(ids)
            db.commit()
            db.close()
            if not n:
                return _Written(None, None)
            context = TaskContext.get()
            name = f"{context.partitionId():06d}.db3"
            target = f"{self.path}/_{self.job}/{context.taskAttemptId()}-{name}"
            files, place = _fs(target)
            files.create_dir(os.path.dirname(place), recursive=True)
            with open(local, "rb") as f, files.open_output_stream(place) as out:
                shutil.copyfileobj(f, out, 1 << 20)
            return _Written(target, name)
        finally:
            shutil.rmtree(own, ignore_errors=True)

    def show(self, made: list[_Written | None], prefix: str) -> None:
        files, _ = _fs(self.path)
        for m in made:
            if m and m.file:
                files.move(_fs(m.file)[1], _fs(f"{self.path}/{prefix}{m.name}")[1])
        self.drop(made)

    def drop(self, made: list[_Written | None]) -> None:
        """Removes the folders of the job; Spark may have made the writer anew since its tasks ran."""
        files, _ = _fs(self.path)
        for folder in {f"{self.path}/_{self.job}", *(os.path.dirname(m.file) for m in made if m and m.file)}:
            if files.get_file_info(_fs(folder)[1]).type == pafs.FileType.Directory:
                files.delete_dir(_fs(folder)[1])


class BagWriter(_Writer, DataSourceArrowWriter):
    def write(self, iterator):
        return self.make(iterator)

    def commit(self, messages):
        self.show(messages, f"part_{self.job[:8]}_")

    def abort(self, messages):
        self.drop(messages)


class BagStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A batch's files have its number in their names, so a batch that is written again replaces itself."""

    def write(self, iterator):
        return self.make(iterator)

    def commit(self, messages, batchId):
        self.show(messages, f"batch_{batchId:08d}_")

    def abort(self, messages, batchId):
        self.drop(messages)


class TopicReader(DataSourceReader):
    """Counts of a file's topics, those without messages too."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(p) for p in find_bags(self.path)]

    def read(self, partition):
        db = _open(partition.path)
        try:
            for row in db.execute("SELECT t.name, t.type, count(m.id) FROM topics t LEFT JOIN messages m ON m.topic_id = t.id GROUP BY t.id ORDER BY t.id"):
                yield (partition.path, *row)
        finally:
            db.close()


class BagSource(DataSource):
    """Messages of a bag, after ``register(spark)``: ``spark.read``, ``readStream``, ``write`` and ``writeStream`` with format ``bag``.

    A partition holds ``messages`` (an option) messages of a file in the order of their ids. Writers take id, topic, timestamp and
    data, and the option ``topics``, JSON of [name, type] pairs that every file lists.
    """

    @classmethod
    def name(cls):
        return "bag"

    def schema(self):
        return SCHEMA

    def _most(self) -> int:
        return int(self.options.get("messages", MESSAGES))

    def reader(self, schema):
        return BagReader(self.options["path"], self._most())

    def streamReader(self, schema):
        return BagStreamReader(self.options["path"], self._most())

    def writer(self, schema, overwrite):
        return BagWriter(self.options["path"], json.loads(self.options["topics"]))

    def streamWriter(self, schema, overwrite):
        return BagStreamWriter(self.options["path"], json.loads(self.options["topics"]))


class TopicSource(DataSource):
    """``spark.read.format("bag_topics").load(path)``: file, topic, type, n."""

    @classmethod
    def name(cls):
        return "bag_topics"

    def schema(self):
        return TOPICS

    def reader(self, schema):
        return TopicReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)
    spark.dataSource.register(TopicSource)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """topic, type, n over all files of a bag; topics without messages have 0."""
    return spark.read.format("bag_topics").load(path).groupBy("topic", "type").agg(F.sum("n").alias("n"))


def listed(topics: DataFrame) -> str:
    """The option ``topics`` of a writer, from a catalogue (topic, type), one row each."""
    return json.dumps(sorted([r["topic"], r["type"]] for r in topics.select("topic", "type").collect()))


def write_bags(messages: DataFrame, topics: DataFrame, path: str, files: int = 1) -> None:
    """Adds bag files to a folder, from messages (id, topic, timestamp, data), dealt by id to ``files`` files in order of ids, and a catalogue of topics (topic, type)."""
    dealt = messages.select("id", "topic", "timestamp", "data").repartition(files, F.pmod("id", F.lit(files))).sortWithinPartitions("id")
    dealt.write.format("bag").option("topics", listed(topics)).mode("append").save(path)
