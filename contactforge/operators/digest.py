"""Restriction digestion and lookups of cut sites.

Sequences are cut into tiles, so that one chromosome is scanned by many tasks; a site is found in the tile where it
begins. Sites become *gaps*: the stretch between two neighbouring sites, listed under every tile that it touches.
Nearest, first and covered sites are then one equi-join on (segment, tile) with one match, not a search.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .enzymes import Enzyme
from .scan import Pattern, occurrences

TILE = 4096


def tiles(sequences: DataFrame, overlap: int, tile: int = TILE) -> DataFrame:
    """(seg_id, linear, length, tile, part) from (seg_id, linear, seq): each tile with ``overlap`` bases after it.

    A circular sequence is read on from its beginning, once at most. Parts are cut from bytes, as cutting a string
    would walk through all of its characters.
    """
    length = F.length("seq")
    after = F.when(F.col("linear"), F.col("seq")).otherwise(F.concat("seq", F.substring(F.col("seq"), F.lit(1), F.least(length, F.lit(overlap)))))
    wide = sequences.select("seg_id", "linear", length.alias("length"), after.cast("binary").alias("bytes"))
    # No filter on the length: it would be pushed down and build every sequence once more.
    count = F.when(F.col("length") > 0, F.sequence(F.lit(0), F.floor((F.col("length") - 1) / tile).cast("int")))
    each = wide.select("seg_id", "linear", "length", "bytes", F.explode(count).alias("tile"))
    return each.select("seg_id", "linear", "length", "tile", F.substring("bytes", F.col("tile") * tile + 1, F.lit(tile + overlap)).cast("string").alias("part"))


def cut_sites(sequences: DataFrame, enzymes: list[Enzyme], tile: int = TILE, cut: DataFrame | None = None) -> DataFrame:
    """(seg_id, pos, enz, rank) from (seg_id, linear, seq), or from tiles ``cut`` of it: the base after each cut, 0-based; enz is the enzyme's number; rank counts from 0.

    On a linear sequence a cut behind the last base is none; on a circular one positions wrap, and sites may span
    the origin. Where two enzymes cut at one place both are listed, in the enzymes' order.
    """
    cut = tiles(sequences, max(len(e.site) for e in enzymes) - 1, tile) if cut is None else cut
    found = occurrences(cut, [Pattern(i, e.site, e.cut) for i, e in enumerate(enzymes)], tile)
    order = Window.partitionBy("seg_id").orderBy("pos", "enz")
    return found.withColumn("rank", F.row_number().over(order) - 1)


def site_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("seg_id").agg(F.count("*").alias("n_sites"))


def gaps(segments: DataFrame, sites: DataFrame, tile: int = TILE) -> DataFrame:
    """(seg_id, tile, lo, lo_enz, hi, hi_enz, first, last, length, linear) from segments (seg_id, length, linear).

    lo <= x < hi for the positions x of a gap. Before the first and after the last site of a circular segment stand
    the last and first one, moved by length - 1; on a linear one nothing does (null). Of two enzymes at one place the
    first counts.
    """
    own = sites.groupBy("seg_id", "pos").agg(F.min("enz").alias("enz"))
    order = Window.partitionBy("seg_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = F.struct(F.col("pos").alias("p"), F.col("enz").alias("e"))
    seen = own.select("seg_id", both.alias("lo"), F.lead(both).over(order).alias("hi"), F.first(both).over(whole).alias("first"), F.last(both).over(whole).alias("last"))
    leading = seen.where("hi IS NULL").select("seg_id", F.lit(None).cast("struct<p:int,e:int>").alias("lo"), F.col("first").alias("hi"), "first", "last")
    every = seen.unionByName(leading).join(segments.select("seg_id", "length", "linear").hint("merge"), "seg_id")
    turn = F.col("length") - 1
    wrapped = lambda near, by: F.when(~F.col("linear"), F.struct((near["p"] + by).alias("p"), near["e"].alias("e")))
    every = every.withColumn("from", F.coalesce(F.col("lo.p"), F.lit(0))).withColumn("to", F.coalesce(F.col("hi.p"), F.col("length") + 1))
    every = every.where(F.col("to") > F.col("from"))
    every = every.withColumn("lo", F.coalesce("lo", wrapped(F.col("last"), -turn))).withColumn("hi", F.coalesce("hi", wrapped(F.col("first"), turn)))
    each = every.withColumn("tile", F.explode(F.sequence(F.floor(F.col("from") / tile).cast("int"), F.floor((F.col("to") - 1) / tile).cast("int"))))
    return each.select("seg_id", "tile", "from", "to", F.col("lo.p").alias("lo"), F.col("lo.e").alias("lo_enz"), F.col("hi.p").alias("hi"), F.col("hi.e").alias("hi_enz"), F.col("first.p").alias("first"), F.col("first.e").alias("first_enz"), F.col("last.p").alias("last"), F.col("length").alias("gap_length"), F.col("linear").alias("gap_linear"))


def in_gap(rows: DataFrame, gap: DataFrame, seg: str, pos: str, tile: int = TILE) -> DataFrame:
    """Left join of each row (0 <= pos <= length) to its gap. The gap's columns follow the rows'."""
    right = gap.withColumnRenamed("seg_id", "gap_seg").withColumnRenamed("tile", "gap_tile")
    on = (F.col(seg) == F.col("gap_seg")) & (F.floor(F.col(pos) / tile).cast("int") == F.col("gap_tile")) & (F.col(pos) >= F.col("from")) & (F.col(pos) < F.col("to"))
    return rows.join(right, on, "left").drop("gap_seg", "gap_tile", "from", "to")


GAP_COLUMNS = ("lo", "lo_enz", "hi", "hi_enz", "first", "first_enz", "last", "gap_length", "gap_linear")


def _real_low() -> Column:
    """Whether lo is a site where it stands. A last site on the last base, moved by length - 1, stands at 0 without being one:
    before the first site nothing is real."""
    return F.coalesce(F.col("lo") >= F.col("first"), F.lit(False))


def nearest(pos: Column) -> tuple[Column, Column]:
    """(position, enzyme) of the nearest site, from a row's gap; a tie goes down; circular results wrap at length - 1."""
    low = F.col("hi").isNull() | (F.col("lo").isNotNull() & (pos - F.col("lo") <= F.col("hi") - pos))
    at = F.when(low, F.col("lo")).otherwise(F.col("hi"))
    wrapped = F.when(F.col("gap_linear") | (F.col("gap_length") < 2), at).otherwise(F.pmod(at, F.col("gap_length") - 1))
    return wrapped, F.when(low, F.col("lo_enz")).otherwise(F.col("hi_enz"))


def first_toward(pos: Column, origin: Column) -> tuple[Column, Column]:
    """(position, enzyme) of the first site met from ``pos`` toward ``origin``, a site, without wrapping."""
    inside_low = _real_low()
    inside_high = F.col("hi").isNotNull() & (F.col("hi") < F.col("gap_length"))
    down = pos > origin
    here = inside_low & (F.col("lo") == pos)
    at = F.when(down, F.when(inside_low, F.col("lo")).otherwise(F.col("first"))).when(here, pos).otherwise(F.when(inside_high, F.col("hi")).otherwise(origin))
    enz = F.when(down, F.when(inside_low, F.col("lo_enz")).otherwise(F.col("first_enz"))).when(here, F.col("lo_enz")).otherwise(F.col("hi_enz"))
    return at, enz


def covers(pos: Column, size: Column) -> Column:
    """Whether there is a site in (pos, pos + size] of a linear, in [pos, pos + size] of a circular segment, from
    pos's gap. A circular stretch wraps at length - 1."""
    end = pos + size
    turn = F.col("gap_length") - 1
    after = F.when(F.col("hi") <= F.col("last"), F.col("hi"))
    linear = after.isNotNull() & (after <= end)
    at_or_after = F.when(_real_low() & (F.col("lo") == pos), pos).otherwise(after)
    over = (F.col("first") <= F.pmod(end, turn)) | (F.col("last") >= pos)
    circular = F.when(end > turn, over).otherwise(at_or_after.isNotNull() & (at_or_after <= end))
    return F.coalesce(F.when(F.col("gap_linear"), linear).otherwise(circular), F.lit(False))
