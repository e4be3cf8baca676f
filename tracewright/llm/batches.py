"""Arrow batches in, Arrow batches out."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of text handed to Python at a time, so that long texts don't fill a worker.
ROWS = 512


def map_iterators(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``fn`` turns the batches of a partition, of ROWS rows at most, into others; memory that it frees goes back to the system."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    owner = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release_others(owner)
        try:
            yield from fn(batches)
        finally:
            _trim()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """``fn`` turns each record batch into a dict of columns (lists, numpy or Arrow arrays)."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return map_iterators(df, run, kind)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts; null reads as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


_HELD: list = []
_OWNER: list = [None]


def _release_others(owner: str) -> None:
    """Drops what another operator has left in this Python worker."""
    if _OWNER[0] != owner:
        _HELD.clear()
        _OWNER[0] = owner
        gc.collect()
        _trim()


def _trim() -> None:
    """Returns freed memory to the system, as a worker idles while later stages run in the JVM alone."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def held(key, make: Callable):
    """What a Python worker keeps from batch to batch: one object at a time, so that stages don't add up."""
    if not _HELD or _HELD[0] != key:
        _HELD.clear()
        _HELD.extend((key, make()))
    return _HELD[1]
