"""FASTQ files back as numbered records.

A compressed file is one split to a scan: one task would decompress all of it. But a file that was joined from parts is a row
of members, each compressed on its own and holding whole records. With their sizes known each is read by a task of its
own, in blocks, and numbers go on from the counts of the members before it: no row is moved to be numbered.
"""
from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContactError
from ..operators import prefix
from .tiled import _opened

CODECS = {".gz": lambda stream: gzip.GzipFile(fileobj=stream), ".bz2": bz2.BZ2File}
#: Lines of a record.
LINES = 4
#: Bytes of plain text that a task reads at once.
BLOCK = 4 << 20


def _blocks(path: str, at: int, size: int) -> Iterator[bytes]:
    """The plain bytes of a stretch of a file; compressed streams may follow each other in it."""
    plain = next((c for s, c in CODECS.items() if path.endswith(s)), lambda stream: stream)
    with _opened(path) as file, plain(file.get_stream(at, size)) as stream:
        while data := stream.read(BLOCK):
            yield data


def _whole(blocks: Iterator[bytes]) -> Iterator[pa.Array]:
    """Records of some blocks at a time, without the end of their last line; a last line may go without one."""
    left = b""
    for data in blocks:
        data = left + data
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[LINES - 1 :: LINES]
        if len(ends):
            yield _cut(data, ends)
            left = data[ends[-1] + 1 :]
        else:
            left = data
    if left:
        if left.count(b"\n") != LINES - 1:
            raise ContactError("a record has less than four lines")
        yield _cut(left + b"\n", np.array([len(left)]))


def _cut(data: bytes, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.binary_slice(lines, 0, -1)


def read_records(spark: SparkSession, path: str, sizes: list[int] | None = None) -> DataFrame:
    """(n, record): the four lines of each record of a file, numbered from 1 in their order. ``sizes`` are the bytes of the
    parts that the file was joined from, one task each; without them one task reads the file. Every reading of the
    result reads the file again. Files that aren't in a mounted file system are scanned by Spark."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        return _scanned(spark, path)
    length, where = fs.getFileStatus(where).getLen(), fs.makeQualified(where).toString()
    sizes = [length] if sizes is None else sizes
    if sum(sizes) != length:
        raise ContactError(f"{path} has {length} bytes, its parts {sum(sizes)}")
    places = [(at, n) for at, n in zip([0, *accumulate(sizes)], sizes, strict=False) if n]
    if not places:
        return spark.createDataFrame([], "n long, record string")
    parts = spark.range(0, len(places), 1, len(places))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sum(map(len, _whole(_blocks(where, *places[k]))))], pa.int64())], ["part", "n"])

    count = dict(map(tuple, parts.mapInArrow(counted, "part long, n long").collect()))  # one row a part
    before = [0, *accumulate(count[k] for k in range(len(places)))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                n = before[k]
                for found in _whole(_blocks(where, *places[k])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, n + len(found) + 1)), found.cast(pa.string())], ["n", "record"])
                    n += len(found)

    return parts.mapInArrow(read, "n long, record string")


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's text reader, for stores whose ranges aren't opened here."""
    lines = prefix.numbered(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")), ["at"], "line")
    found = lines.groupBy((F.floor((F.col("line") - 1) / LINES) + 1).alias("n")).agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("held"))
    return found.select("n", F.array_join(F.transform("held", lambda x: x["value"]), "\n").alias("record"))
