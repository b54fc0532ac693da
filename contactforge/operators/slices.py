"""Parts of sequences by an equi-join on (segment, tile), never by shipping whole sequences to every row."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digest import TILE


def take(rows: DataFrame, cut: DataFrame, seg: str, start: str, size: str, into: str, tile: int = TILE, documented: bool = False) -> DataFrame:
    """Adds column ``into``: the part of segment ``seg`` from ``start`` with ``size`` bases.

    ``cut`` are tiles whose overlap is at least the largest size. Circular: a negative start counts from the end and
    the part wraps, once. Linear: a negative start is 0 (the size stays) and a part that runs over the end stops one
    base before the last (``documented``: at it). A part of no bases, or of a segment without tiles, is empty.
    """
    right = cut.select(F.col("seg_id").alias("t_seg"), F.col("tile").alias("t_tile"), F.col("part").alias("t_part"))
    # The segment's length and shape must be known before the tile is: rows carry them.
    n, lin = F.col(f"{seg}_len"), F.col(f"{seg}_lin")
    at = F.when(F.col(start) < 0, F.when(lin, F.lit(0)).otherwise(F.pmod(F.col(start), n))).otherwise(F.col(start))
    over = at + F.col(size) > n
    last = n - (0 if documented else 1)
    size_ = F.when(over & lin, F.greatest(last - at, F.lit(0))).when(over, F.least(F.col(size), F.greatest(n - at, F.lit(0)) + n)).otherwise(F.col(size))
    ready = rows.withColumn("__at", at.cast("long")).withColumn("__size", F.greatest(size_, F.lit(0)).cast("int"))
    # A start at the very end has no tile of its own: what follows is the beginning of a circular segment.
    ready = ready.withColumn("__from", F.when(F.col("__at") >= n, F.lit(0)).otherwise(F.col("__at")))
    ready = ready.withColumn("__size", F.when((F.col("__at") >= n) & lin, F.lit(0)).otherwise(F.col("__size")))
    on = (F.col(seg) == F.col("t_seg")) & (F.floor(F.col("__from") / tile).cast("int") == F.col("t_tile"))
    joined = ready.join(right, on, "left")
    text = F.substring("t_part", (F.col("__from") % tile + 1).cast("int"), F.col("__size"))
    return joined.withColumn(into, F.coalesce(text, F.lit(""))).drop("t_seg", "t_tile", "t_part", "__at", "__size", "__from")
