"""Interaction domains: random, nested, merged, and blocks of equal effect."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import below, unit


def random_domains(chromosomes: DataFrame, number: int = 10, shortest: int = 20000, longest: int = 250000, own: float = 0.5, seed: int = 1) -> DataFrame:
    """(chrom, begin, end, prob, depth) from (chrom, length): ``number`` random domains each, and the chromosome itself
    with probability ``own``; the others share the rest by random weights. Domains longer than the chromosome fall out."""
    each = chromosomes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    keys = ("chrom", "k")
    drawn = each.withColumn("begin", below(unit(seed, "begin", *keys), F.col("length"))).withColumn("size", shortest + below(unit(seed, "size", *keys), longest - shortest))
    drawn = drawn.withColumn("u", unit(seed, "prob", *keys)).withColumn("prob", F.col("u") * (1 - own) / F.sum("u").over(Window.partitionBy("chrom")))
    inner = drawn.where("size < length").select("chrom", "begin", (F.col("begin") + F.col("size")).alias("end"), "prob", F.lit(1).alias("depth"))
    outer = chromosomes.select("chrom", F.lit(0).cast("long").alias("begin"), F.col("length").cast("long").alias("end"), F.lit(own).alias("prob"), F.lit(0).alias("depth"))
    return outer.unionByName(inner)


def nested_domains(chromosomes: DataFrame, number: int = 5, shortest: float = 0.05, longest: float = 0.2, depth: int = 2, own: float = 0.5, seed: int = 1) -> DataFrame:
    """(chrom, begin, end, prob, depth): each interval is divided into ``number`` adjacent ones, ``depth`` times over."""
    level = chromosomes.select("chrom", F.lit(0).cast("long").alias("begin"), F.col("length").cast("long").alias("end"), F.lit("").alias("path"))
    found = None
    for d in range(1, depth + 1):
        parts = level.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(number))))
        size = F.col("end") - F.col("begin")
        parts = parts.withColumn("x", shortest + (longest - shortest) * unit(seed, f"cut{d}", "chrom", "path", "k"))
        own_part = Window.partitionBy("chrom", "path")
        upto = own_part.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        step = F.floor(F.col("x") / F.sum("x").over(own_part) * size).cast("long")
        parts = parts.withColumn("step", step).withColumn("upto", F.sum("step").over(upto))
        stop = F.when(F.col("k") == number, F.col("end")).otherwise(F.col("begin") + F.col("upto"))
        start = F.col("begin") + F.col("upto") - F.col("step")
        level = parts.select("chrom", start.alias("begin"), stop.alias("end"), F.concat_ws("/", "path", F.col("k").cast("string")).alias("path"))
        found = level.withColumn("depth", F.lit(d)) if found is None else found.unionByName(level.withColumn("depth", F.lit(d)))
    weighed = found.withColumn("u", unit(seed, "prob", "chrom", "path"))
    inner = weighed.select("chrom", "begin", "end", (F.col("u") * (1 - own) / F.sum("u").over(Window.partitionBy("chrom"))).alias("prob"), "depth")
    outer = chromosomes.select("chrom", F.lit(0).cast("long").alias("begin"), F.col("length").cast("long").alias("end"), F.lit(own).alias("prob"), F.lit(0).alias("depth"))
    return outer.unionByName(inner)


def merged(domains: DataFrame) -> DataFrame:
    """(chrom, begin, end, prob, length): overlapping domains become one; probabilities are averaged one after the
    other in order of position, lengths are added."""
    order = Window.partitionBy("chrom").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = domains.withColumn("new", F.when(reach.isNull() | (F.col("begin") >= reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    own = Window.partitionBy("chrom", "island")
    # The fold 0.5 * (so far + next) as weights: halved once for each later domain, the first as often as the second.
    k, n = F.row_number().over(own.orderBy("begin", "end", "prob")), F.count("*").over(own)
    weighed = islands.withColumn("part", F.col("prob") * F.pow(F.lit(0.5), n - F.greatest(k, F.lit(2)) + 1))
    weighed = weighed.withColumn("part", F.when(n == 1, F.col("prob")).otherwise(F.col("part")))
    held = weighed.groupBy("chrom", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("part").alias("prob"), F.sum(F.col("end") - F.col("begin")).alias("length"))
    return held.select("chrom", "begin", "end", "prob", "length")


def blocks(domains: DataFrame) -> DataFrame:
    """(chrom, block_begin, block_end, begin, end, share): between neighbouring ends of domains, the domains there with
    their probabilities scaled to 1."""
    ends = domains.select("chrom", F.explode(F.array("begin", "end")).alias("x")).distinct()
    cut = ends.withColumn("block_end", F.lead("x").over(Window.partitionBy("chrom").orderBy("x"))).where("block_end IS NOT NULL")
    # No domain ends inside a block: it is there if it holds the block's first base.
    both = containing(cut, domains).withColumnRenamed("x", "block_begin")
    return both.withColumn("share", F.col("prob") / F.sum("prob").over(Window.partitionBy("chrom", "block_begin"))).select("chrom", "block_begin", "block_end", "begin", "end", "share")


#: Bins of 2^14 bases, and of eight times as many on each level above; the last level is one bin a chromosome.
LEVELS = (14, 17, 20, 23, 26, 29, 32, 62)


def binned(domains: DataFrame) -> DataFrame:
    """Each interval that isn't empty once, with the smallest bin that holds it: level and number of the bin."""
    fits = lambda s: F.call_function("shiftright", F.col("begin"), F.lit(s)) == F.call_function("shiftright", F.col("end") - 1, F.lit(s))
    level = F.coalesce(*(F.when(fits(s), F.lit(s)) for s in LEVELS))
    return domains.where("end > begin").withColumn("level", level).withColumn("bin", F.call_function("shiftright", F.col("begin"), F.col("level")))


def containing(points: DataFrame, domains: DataFrame) -> DataFrame:
    """Points (chrom, x, ...) with every domain that holds them: begin <= x < end. An equi-join on bins: an interval is listed
    once, whatever its width, and a point looks up the one bin of each level that it lies in."""
    level = F.explode(F.array(*map(F.lit, LEVELS))).alias("level")
    at = points.select("*", level).withColumn("bin", F.call_function("shiftright", F.col("x"), F.col("level")))
    return at.join(binned(domains), ["chrom", "level", "bin"]).where("begin <= x AND x < end").drop("level", "bin")
