"""Helpers shared by the corpus operators: tables, durable intermediates (the library's), bounded Arrow slices."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import removed as discard
from ..storage import settled
from ..storage import written as stash

__all__ = ["as_bytes", "discard", "held_out", "kept_between_tasks", "map_arrow", "released", "settled", "shuffle_partitions", "slices", "stash", "table"]

#: Bytes of text handled at once inside a Python worker; one longer text is handled alone.
SLICE_BYTES = 4 << 20


#: Bytes that the JVM puts into one Arrow batch. Its own default of 64 MB stands several times in buffers outside the
#: heap and again in the Python worker, for each running task.
BATCH_BYTES = "4m"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of a few MB. Spark reads this size from the session only, so it is set there where
    the user has set none; nothing else of the session is touched."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df.mapInArrow(function, schema)


#: What this Python process keeps between tasks; workers live on and serve other stages.
_kept: list[dict] = []


def kept_between_tasks() -> dict:
    """A table for what is dear to make anew in each task, until ``released`` empties it."""
    _kept.append({})
    return _kept[-1]


def released() -> None:
    """Drop what earlier stages keep in this Python process, and give the memory back to the system."""
    if any(_kept):
        for held in _kept:
            held.clear()
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one string or binary column holds at most ``limit`` bytes in each piece (or one row)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus == remainder
