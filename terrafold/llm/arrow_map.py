"""Whole texts through a function in bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from terrafold.session import ship_package

#: Bytes of text that one call gets, unless a single text is longer.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose values of ``column`` come to about ``limit`` bytes."""
    at, total = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        total += n or 0
        if total >= limit:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def map_texts(df: DataFrame, column: str, keep: list[str], fields: StructType, make: Callable[[], Callable[[list], list]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``keep`` columns and the columns ``fields`` that a function gives for the texts of ``column``.

    ``make()`` runs once a task and returns that function: a list of texts
    (None where null) to one list or Arrow array for each field. Other columns of
    ``df``, also such that are named as a field, take no part.
    """
    ship_package(df.sparkSession)
    given = df.select(*[F.col(c) for c in keep], F.col(column).alias("__text"))
    out = StructType([*given.select(*keep).schema.fields, *fields.fields])
    kinds = [to_arrow_type(f.dataType) for f in fields.fields]
    names = [f.name for f in out.fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, n, slice_bytes):
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(part.column(n).to_pylist()), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)

    return given.mapInArrow(run, out)
