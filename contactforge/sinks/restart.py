"""Runs that a lost driver doesn't lose: pairs are written range by range, and a range is there as a whole or not at all.

A pair is a function of its number, so a range gives the same bytes whenever it is made. Each finished range is a folder of
sorted parts that is renamed into place; the same command goes on with the ranges that aren't there. At the end all parts
are joined in order of their ranges, without another sort.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContactError
from ..operators.reads import summary
from ..storage import owned, renamed, written
from .records import joined, output_kind, records

RANGES = 16


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _claimed(spark: SparkSession, folder: str, key: dict) -> None:
    """The folder's note says what run it belongs to; another run's folder is an error."""
    said = json.dumps(key, sort_keys=True, default=str)
    fs, note = _fs(spark, f"{folder}/run")
    if not fs.exists(note):
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{folder}/pending-{(name := uuid.uuid4().hex)}")
        renamed(spark, f"{folder}/pending-{name}", f"{folder}/run")
    if "\n".join(r[0] for r in spark.read.text(f"{folder}/run").collect()) != said:
        raise ContactError(f"{folder} holds ranges of another run")


def write_ranges(spark: SparkSession, make: Callable[[DataFrame], DataFrame], total: int, first: str, second: str | None, folder: str, key: dict, ranges: int = RANGES) -> dict:
    """The reads of pair numbers 1 to ``total`` as one file, or two; returns the counts of the run's summary.

    ``make`` gives the pairs of numbers (idx). ``folder`` holds the finished ranges until the outputs are there, and
    ``key`` is all that the bytes depend on.
    """
    kind, codec = output_kind(first, second)
    outputs = [(first, (1, 2))] if second is None else [(first, (1,)), (second, (2,))]
    size = max(1, -(-total // ranges))
    starts = list(range(1, total + 1, size))
    _claimed(spark, folder, key | {"total": total, "size": size, "kind": kind, "codec": codec, "outputs": len(outputs)})
    for r, start in enumerate(starts):
        place = f"{folder}/range-{r:05d}"
        fs, where = _fs(spark, place)
        if fs.exists(where):
            continue
        beside = f"{folder}/pending-{uuid.uuid4().hex}"
        with owned(spark):
            held = written(make(spark.range(start, min(total + 1, start + size)).select(F.col("id").alias("idx"))))
            rows = records(held, kind)
            for k, (_, keep) in enumerate(outputs):
                rows.where(F.col("r1r2").isin(*keep)).orderBy("idx", "r1r2").select("record").write.option("compression", codec).text(f"{beside}/out-{k}")
            summary(held).write.parquet(f"{beside}/summary")
        renamed(spark, beside, place)
    places = [f"{folder}/range-{r:05d}" for r in range(len(starts))]
    counts = spark.read.parquet(*(f"{p}/summary" for p in places))
    said = counts.agg(*(F.sum(c).alias(c) for c in counts.columns)).first().asDict()
    for k, (path, _) in enumerate(outputs):
        joined(spark, [f"{p}/out-{k}" for p in places], path)
    fs, where = _fs(spark, folder)
    fs.delete(where, True)
    return said
