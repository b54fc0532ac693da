"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of all words by its weight, but at most ``max_epochs`` times its own words; the excess is
shared again among the others by weight until none is above. With sources in order of cap / weight, the ones that
stop at their cap are a prefix of that order, so the fixed point needs one pass of running sums over the sources.

A source whose target is r times its size repeats each document floor(r) times; the rest is a seeded draw: documents
in the order of md5(seed:doc_id) are taken once more until the missing words are reached to the nearest document.
Where that order stops is found from sums over hash prefixes, so only one prefix a source is ever sorted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stash, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
PREFIX = 3
#: Up to so many sources the per-source table (about 100 bytes a row) is broadcast; beyond it, joins shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size): the same with target. One row a source; null is a source of its own, last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = (
        weighed.withColumn("left_weight", F.sum("weight").over(rest))
        .withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("stops", F.col("cap").cast("decimal(38,0)") * F.col("left_weight") <= F.col("weight").cast("decimal(38,0)") * F.col("left_words"))
    )
    # The first source below its cap has the largest remaining weight of those; all of them share its level.
    level = F.min(F.when(~F.col("stops"), F.struct((-F.col("left_weight")).alias("k"), (F.col("left_words") / F.col("left_weight")).alias("v")))).over(everything)["v"]
    return left.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def by_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join on source, null equal to null: broadcast behind the count of sources, else by shuffle (AQE splits skew)."""
    small = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return rows.alias("r").join(small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """From (doc_id, source, size, h): per source its source_size, target, whole repetitions and the last drawn key."""
    buckets = sized.groupBy("source", F.substring("h", 1, PREFIX).alias("prefix")).agg(F.sum("size").alias("words"))
    buckets = stash(buckets)
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = stash(targets.withColumn("whole", F.floor(ratio)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    n = targets.count()
    running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = by_source(buckets, targets.select("source", "need"), n).withColumn("upto", F.sum("words").over(running))
    full = placed.where("upto <= need").groupBy("source").agg(F.max(F.concat("prefix", F.lit("g"))).alias("full"))
    edge = placed.where("upto > need AND upto - words < need").select("source", F.col("prefix").alias("edge"), (F.col("upto") - F.col("words")).alias("already"), "need")
    edge = stash(edge)
    inside = by_source(sized, edge, n).where(F.substring("h", 1, PREFIX) == F.col("edge"))
    # Rows of one doc_id have one key and are drawn together.
    inside = inside.groupBy("source", "h", "already", "need").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = inside.withColumn("middle", F.col("already") + upto - F.col("size") / 2).where("middle <= need").groupBy("source").agg(F.max("h").alias("last"))
    limits = full.unionByName(drawn, allowMissingColumns=True).groupBy("source").agg(F.max(F.greatest(F.coalesce("full", F.lit("")), F.coalesce("last", F.lit("")))).alias("limit"))
    done = stash(by_source_left(targets, limits).select("source", "source_size", "target", "whole", F.coalesce("limit", F.lit("")).alias("limit")))
    for used in (buckets, targets, edge):
        discard(used)
    return done, n


def by_source_left(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left").drop(F.col("s.source"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document.

    Null texts and texts without words have size 0 and take nothing; a null source is a source of its own; rows with
    equal doc_id (null too) are drawn alike; other columns are not read; an empty table gives an empty table.
    """
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("h", draw_key(F.col("doc_id"), seed)))
    sources, n = plan(sized, weights, max_epochs)
    copies = F.col("whole") + (F.col("h") <= F.col("limit")).cast("long")
    return by_source(sized, sources, n).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size and how many of its words the mix takes."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with all columns, whatever their names. Nulls, ties,
    repeated rows and empty tables as in ``mix``; texts are counted whole."""
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("h", draw_key(F.col("doc_id"))))
    sources, n = plan(sized)
    discard(sized)
    # The document stands apart from the operator's own columns.
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "source", draw_key(F.col("doc_id")).alias("h"))
    keyed = by_source(held, sources.select("source", "whole", "limit"), n)
    copies = F.col("whole") + (F.col("h") <= F.col("limit")).cast("long")
    again = keyed.withColumn("copies", copies).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return again.select("doc.*")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w
), l AS (
  SELECT *, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS lw,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lt
  FROM o
), t AS (
  SELECT source, source_size, CASE WHEN cap::HUGEINT * lw <= weight::HUGEINT * lt THEN cap::DOUBLE
    ELSE weight * (SELECT lt / lw FROM l WHERE cap::HUGEINT * lw > weight::HUGEINT * lt ORDER BY k LIMIT 1) END AS target
  FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), g AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS need, d.source, d.h,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN upto - own / 2 <= need AND (own > 0 OR upto < need) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM g
"""
