"""Running sums and row numbers over a whole table in two levels, without a window that sees all rows.

Rows are dealt out by ranges of their order and sorted there; each range sums its own rows as they stream by. The ranges'
totals (one number a range, whatever the number of rows) are summed on the driver and added back.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

_PART = "__range"


def _summed(columns: list[int | None]):
    """Adds the number of the range, and each column's running sum in it (of ones for None; nulls count as 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = [0] * len(columns), TaskContext.get().partitionId()
        for b in batches:
            added = []
            for k, c in enumerate(columns):
                own = np.ones(b.num_rows, np.int64) if c is None else pc.fill_null(b.column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                if before[k] + float(np.abs(own.astype(np.float64)).sum()) >= 2.0**62:
                    raise OverflowError("a running sum is beyond 62 bits")
                upto = before[k] + np.cumsum(own)
                before[k] = int(upto[-1]) if len(upto) else before[k]
                added.append(pa.array(upto, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), *added], [*b.schema.names, _PART, *(f"__upto{k}" for k in range(len(columns)))])

    return run


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, str | None], ranges: int | None = None) -> DataFrame:
    """Adds, for each name of ``sums``, the running sum of a whole-number column in the given order, the row's own
    value with it; None instead of a column numbers the rows from 1.

    Rows that are equal in ``order`` stay in one range, in no fixed order among themselves: it should end with a key.
    Nulls count as 0. Sums beyond 62 bits are an OverflowError. An empty table gives an empty table. The result is read
    from a written table.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    at = [None if sums[x] is None else rows.columns.index(sums[x]) for x in names]
    schema = T.StructType([*rows.schema.fields, T.StructField(_PART, T.IntegerType()), *(T.StructField(f"__upto{k}", T.LongType()) for k in range(len(names)))])
    held = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_summed(at), schema))
    last = [F.coalesce(F.sum(F.lit(1) if c is None else F.col(f"`{sums[x]}`")), F.lit(0)).cast("long").alias(f"t{k}") for k, (x, c) in enumerate(zip(names, at, strict=True))]
    totals = held.groupBy(_PART).agg(*last).orderBy(_PART).collect()  # one row a range
    before = zip(*([0, *accumulate(r[f"t{k}"] for r in totals)][:-1] for k in range(len(names))), strict=True)
    offsets = spark.createDataFrame([(r[_PART], *map(int, b)) for r, b in zip(totals, before, strict=True)], f"{_PART} int, " + ", ".join(f"__before{k} long" for k in range(len(names))))
    out = held.join(F.broadcast(offsets), _PART)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *((F.col(f"__upto{k}") + F.col(f"__before{k}")).alias(x) for k, x in enumerate(names)))


def numbered(rows: DataFrame, order: list[str | Column], into: str = "n", ranges: int | None = None) -> DataFrame:
    """Adds the row's number in the given order, from 1."""
    return running(rows, order, {into: None}, ranges)
