"""Point clouds as byte buffers with a layout of their own, to rows and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from terrafold.session import ship_package

# The numbers of the field types, with NumPy's and Spark's types; unsigned ones are widened.
FIELD_TYPES = {1: ("i1", ByteType()), 2: ("u1", ShortType()), 3: ("i2", ShortType()), 4: ("u2", IntegerType()), 5: ("i4", IntegerType()), 6: ("u4", LongType()), 7: ("f4", FloatType()), 8: ("f8", DoubleType())}


def layout_dtype(fields: list[dict], point_step: int, big_endian: bool = False) -> np.dtype:
    """The NumPy type of a point; fields without a name are padding. A layout that cannot be is an error."""
    if point_step <= 0:
        raise ValueError("a point takes some bytes")
    named = [f for f in fields if f["name"]]
    if len({f["name"] for f in named}) < len(named):
        raise ValueError("two fields have one name")
    formats = []
    for f in named:
        if f["datatype"] not in FIELD_TYPES:
            raise ValueError(f"no field type {f['datatype']}")
        one = np.dtype((">" if big_endian else "<") + FIELD_TYPES[f["datatype"]][0])
        count = max(1, f.get("count", 1))
        if f["offset"] < 0 or f["offset"] + one.itemsize * count > point_step:
            raise ValueError(f"field {f['name']} lies outside a point")
        formats.append((one, (count,)) if count > 1 else one)
    return np.dtype({"names": [f["name"] for f in named], "formats": formats, "offsets": [f["offset"] for f in named], "itemsize": point_step})


def layout_schema(fields: list[dict]) -> StructType:
    out = []
    for f in fields:
        if f["name"]:
            t = FIELD_TYPES[f["datatype"]][1]
            out.append(StructField(f["name"], ArrayType(t) if f.get("count", 1) > 1 else t))
    return StructType(out)


def scalar_fields(schema: StructType) -> list[str]:
    return [f.name for f in schema if not isinstance(f.dataType, ArrayType)]


def decode_buffer(data: bytes, dtype: np.dtype, height: int, width: int, row_step: int) -> np.ndarray:
    """Points of a buffer whose rows can end in padding; too short a buffer is an error."""
    if not height * width:
        return np.zeros(0, dtype)
    line = width * dtype.itemsize
    row_step = row_step or line
    if row_step < line or len(data) < row_step * (height - 1) + line:
        raise ValueError("the buffer is shorter than its layout says")
    if row_step == line:
        return np.frombuffer(data, dtype, height * width)
    return np.concatenate([np.frombuffer(data, dtype, width, r * row_step) for r in range(height)])


def decode_clouds(clouds: DataFrame, fields: list[dict], point_step: int, big_endian: bool = False, key: str = "frame") -> DataFrame:
    """(key, point_idx, fields...) of a table (key, height, width, row_step, data) whose clouds have one layout."""
    ship_package(clouds.sparkSession)
    dtype, schema = layout_dtype(fields, point_step, big_endian), layout_schema(fields)
    given = clouds.select(key, "height", "width", "row_step", "data")
    out = StructType([given.schema[key], StructField("point_idx", LongType()), *schema.fields])
    arrow = {f.name: to_arrow_type(f.dataType) if isinstance(f.dataType, ArrayType) else None for f in schema}
    wide = {np.dtype("u1"): "i2", np.dtype("u2"): "i4", np.dtype("u4"): "i8"}

    def native(x: np.ndarray) -> np.ndarray:
        base = x.dtype.newbyteorder("=")
        return x.astype(wide.get(base, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                k, h, w, step, data = (b.column(i)[r].as_py() for i in range(5))
                p = decode_buffer(data or b"", dtype, h, w, step)
                cols = [native(p[f.name]) for f in schema]
                cols = [pa.array(c.tolist(), arrow[f.name]) if arrow[f.name] is not None else pa.array(c) for c, f in zip(cols, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(p), b.schema.types[0]), pa.array(np.arange(len(p))), *cols], names=out.names)

    return given.mapInArrow(run, out)


def encode_clouds(points: DataFrame, fields: list[dict], point_step: int, key: str = "frame", order: str = "pid") -> DataFrame:
    """(key, height, width, row_step, is_dense, data) of each frame's points in ``order``; dense if all coordinates are finite. A frame is one scan."""
    ship_package(points.sparkSession)
    dtype = layout_dtype(fields, point_step)
    names = list(dtype.names)
    given = points.select(key, F.col(order).alias("__o"), *names)
    schema = f"{key} {given.schema[key].dataType.simpleString()}, height int, width int, row_step int, is_dense boolean, data binary"

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by("__o")
        out = np.zeros(t.num_rows, dtype)
        for n in names:
            out[n] = np.asarray(t[n])
        dense = all(np.isfinite(out[c].astype(float)).all() for c in ("x", "y", "z"))
        return pa.table({key: t[key][:1], "height": pa.array([1], pa.int32()), "width": pa.array([len(out)], pa.int32()), "row_step": pa.array([len(out) * point_step], pa.int32()), "is_dense": [bool(dense)], "data": pa.array([out.tobytes()], pa.binary())})

    return given.groupBy(key).applyInArrow(one, schema)


def header_stamp(raw: bytes) -> tuple[int, int]:
    """Seconds and nanoseconds at the head of a serialized message; its second byte says the byte order."""
    return struct.unpack_from("<iI" if raw[1] == 1 else ">iI", raw, 4)


def header_stamp_ns(column: str = "data"):
    """The same as a column, nanoseconds: the rest of the message is not touched."""
    word = lambda at: F.conv(F.hex(F.substring(column, at, 4)), 16, 10).cast("long")
    swapped = lambda at: F.conv(F.concat(*[F.hex(F.substring(column, at + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    little = F.hex(F.substring(column, 2, 1)) == "01"
    sec, nano = F.when(little, swapped(5)).otherwise(word(5)), F.when(little, swapped(9)).otherwise(word(9))
    signed = F.when(sec >= 1 << 31, sec - (1 << 32)).otherwise(sec)
    return signed * 1_000_000_000 + nano


def header_bytes(stamp_us: Column) -> Column:
    """The head of a little-endian serialized message with a stamp in microseconds."""
    word = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    flip = lambda b: F.concat(*[F.substring(b, i, 1) for i in (4, 3, 2, 1)])
    return F.concat(F.unhex(F.lit("00010000")), flip(word(F.floor(stamp_us / 1_000_000))), flip(word(stamp_us % 1_000_000 * 1000)))


def write_frames(points: DataFrame, path: str, key: str = "frame") -> None:
    """Frames as a partitioned table; writing one again replaces it and no other."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_frames(spark, path: str, first: int | None = None, key: str = "frame") -> DataFrame:
    """All frames, or the first few by number; the others' files are not read."""
    df = spark.read.parquet(path)
    if first is None:
        return df
    last = [r[0] for r in df.select(key).distinct().orderBy(key).limit(first).collect()]
    return df.filter(F.col(key).isin(last))
