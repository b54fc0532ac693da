"""Weights of segments and weighted draws.

All weights are integers (copies in thousandths times bases or sites), so running sums are exact at any size. The
segments of a replicon, and the replicons of a cell, are neighbours in one community-wide order; one running sum thus
serves draws from the community, from a replicon, and from a cell without one of its replicons (its own stretch
is skipped), and no table grows with the square of a cell's replicons.

A drawn number is found by an equi-join on its bucket: a stretch is listed under each bucket that it touches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SingleReplicon
from . import prefix

#: Rows that a lookup table may have to be sent to every task; larger ones are dealt out with the rows that are looked up.
FEW = 20_000


def running(table: DataFrame, weight: str) -> DataFrame:
    """Adds lo, hi (the segment's stretch), repl_lo, repl_hi, cell_lo, cell_hi, total to (cell, repl, seg_id, weight).

    One running sum over ranges of the order; the stretches of replicons and cells are its ends there. No task sees more
    than a range of the segments, however many a replicon or a cell has.
    """
    placed = prefix.running(table, ["cell", "repl", "seg_id"], {"hi": weight}).withColumn("lo", F.col("hi") - F.col(weight))
    replicons = placed.groupBy("cell", "repl").agg(F.min("lo").alias("repl_lo"), F.max("hi").alias("repl_hi"))
    cells = replicons.groupBy("cell").agg(F.min("repl_lo").alias("cell_lo"), F.max("repl_hi").alias("cell_hi"))
    total = F.coalesce(table.select(F.sum(weight)).scalar(), F.lit(0)).cast("long")
    return placed.join(replicons.join(cells, "cell"), ["cell", "repl"]).withColumn("total", total)


def cdf(table: DataFrame, weight: str, *groups: str) -> DataFrame:
    """Running share of the weight within the groups (the whole table if none), in order of cell, repl, seg_id."""
    keys = [k for k in ("cell", "repl", "seg_id") if k not in groups]
    placed = prefix.running(table, [*groups, *keys], {"__hi": weight})
    if not groups:
        return placed.withColumn("cdf", F.col("__hi") / table.select(F.sum(weight)).scalar()).drop("__hi")
    ends = placed.groupBy(*groups).agg(F.min(F.col("__hi") - F.col(weight)).alias("__from"), F.max("__hi").alias("__to"))
    share = (F.col("__hi") - F.col("__from")) / (F.col("__to") - F.col("__from"))
    return placed.join(ends, list(groups)).withColumn("cdf", share).drop("__hi", "__from", "__to")


def excluding(placed: DataFrame) -> DataFrame:
    """(cell, repl, other_weight): what is left of a cell's weight without each of its replicons."""
    return placed.select("cell", "repl", (F.col("cell_hi") - F.col("cell_lo") - F.col("repl_hi") + F.col("repl_lo")).alias("other_weight")).distinct()


def anywhere(u: Column, total) -> Column:
    return F.floor(u * total).cast("long")


def in_replicon(u: Column) -> Column:
    return (F.col("repl_lo") + F.floor(u * (F.col("repl_hi") - F.col("repl_lo")))).cast("long")


def in_other_replicon(u: Column) -> Column:
    """A number in the cell's stretch with the own replicon's left out; null if nothing else is there."""
    own = F.col("repl_hi") - F.col("repl_lo")
    x = F.col("cell_lo") + F.floor(u * (F.col("cell_hi") - F.col("cell_lo") - own))
    there = F.when(x < F.col("repl_lo"), x).otherwise(x + own)
    return F.when(F.col("cell_hi") - F.col("cell_lo") > own, there).cast("long")


def check_other_replicons(placed: DataFrame) -> None:
    """SingleReplicon if a cell has just one replicon, so that none other can be drawn there."""
    alone = placed.where("n_repl < 2").select("cell").distinct().limit(5).collect()
    if alone:
        raise SingleReplicon("cells with one replicon: " + ", ".join(r[0] for r in alone))


def bucketed(placed: DataFrame, total: int, n: int) -> tuple[DataFrame, int]:
    """The stretches under each bucket of ``width`` that they touch: about five quarters of n rows with 4 n buckets."""
    width = max(1, total // max(1, 4 * n))
    live = placed.where("hi > lo")
    listed = live.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    # Spark sees the file's compressed size, without the copies: it would collect a large table on the driver.
    return (listed if 5 * n <= FEW else listed.hint("merge")), width


def look_up(rows: DataFrame, buckets: DataFrame, width: int, x: str, how: str = "inner") -> DataFrame:
    """Join each drawn number to the segment whose stretch it falls into."""
    right = buckets.withColumnsRenamed({"bucket": "__bucket", "lo": "__lo", "hi": "__hi"})
    on = (F.floor(F.col(x) / width) == F.col("__bucket")) & (F.col(x) >= F.col("__lo")) & (F.col(x) < F.col("__hi"))
    return rows.join(right, on, how).drop("__bucket", "__lo", "__hi")
