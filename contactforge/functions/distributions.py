"""Distributions of pair separation, error rates and abundances."""
from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OutOfBounds

#: Separation model: geometric with this shape, mixed with a uniform part.
SHAPE = 3.5e-6
BINS = 1000
#: The mixing part in use, and the one that the documentation of the model names.
ALPHA, ALPHA_DOCUMENTED = 0.333, 0.1


def geometric(x: Column, shape: float) -> Column:
    return 1.0 - F.pow(F.lit(1.0 - shape), x)


def geometric_uniform(x: Column, length: Column, shape: float = SHAPE, alpha: float = ALPHA) -> Column:
    """Distribution function of the mixture, over 0 to length."""
    return (1.0 - alpha) * geometric(x, shape) + alpha * x / length


def geometric_uniform_half(x: Column, length: Column, shape: float = SHAPE) -> Column:
    return 0.5 * (geometric(x, shape) + x / length)


def geometric_uniform_density(x: Column, length: Column, shape: float = SHAPE) -> Column:
    return 0.5 * (shape * F.pow(F.lit(1.0 - shape), x) + 1.0 / length)


def checked_cdf(x: Column, length: Column, shape: float = SHAPE, alpha: float = ALPHA) -> Column:
    """The distribution function with an error for values beyond the length."""
    return F.when(x > length, F.raise_error(F.lit("out of bounds"))).otherwise(geometric_uniform(x, length, shape, alpha))


def check_bounds(rows: DataFrame, x: str, length: str) -> None:
    """OutOfBounds if a value lies below 0 or beyond its row's length."""
    bad = rows.where((F.col(x) < 0) | (F.col(x) > F.col(length))).select(x, length).limit(1).collect()
    if bad:
        raise OutOfBounds(f"{bad[0][0]} is outside 0 to {bad[0][1]}")


def sampled(length: Column, bins: int = BINS, shape: float = SHAPE, alpha: float = ALPHA) -> Column:
    """Array of (x, y): the function at ``bins`` even points, scaled to end at 1."""
    top = geometric_uniform(length.cast("double"), length, shape, alpha)
    at = lambda k: length.cast("double") * k / F.lit(bins - 1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.struct(at(k).alias("x"), (geometric_uniform(at(k), length, shape, alpha) / top).alias("y")))


def sampled_rows(rows: DataFrame, length: str, bins: int = BINS, shape: float = SHAPE, alpha: float = ALPHA) -> DataFrame:
    """``sampled`` as rows: n, x and y instead of the length. Points are made before the function is taken of them, so that
    it is compiled and no array of a row's points is held; what all points of a row share is taken once."""
    n = F.col(length)
    once = rows.withColumn("__top", geometric_uniform(n.cast("double"), n, shape, alpha))
    each = once.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("x", n.cast("double") * F.col("n") / F.lit(bins - 1.0))
    return each.withColumn("y", geometric_uniform(F.col("x"), n, shape, alpha) / F.col("__top")).drop("__top", length)


def inverse(u: Column, length: Column, bins: int = BINS, shape: float = SHAPE, alpha: float = ALPHA) -> Column:
    """The sampled function's inverse with linear interpolation: the bin is bisected, not looked up in an array."""
    top = geometric_uniform(length.cast("double"), length, shape, alpha)
    at = lambda k: length.cast("double") * k / F.lit(bins - 1.0)
    y = lambda k: geometric_uniform(at(k), length, shape, alpha) / top
    rounds = (bins - 1).bit_length()

    def halve(span, _):
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        low = y(middle) <= u
        return F.struct(F.when(low, middle).otherwise(span["lo"]).alias("lo"), F.when(low, span["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(bins - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: at(s["lo"]) + (u - y(s["lo"])) / (y(s["lo"] + 1) - y(s["lo"])) * (length / F.lit(bins - 1.0)))


def binomial_tails(read_length: int, probability: float, most: int = 2, documented: bool = False) -> list[float]:
    """Chance of more than i errors in a read for i = 1.. (``documented``: of at least i)."""
    def more_than(i):
        return 1.0 - sum(comb(read_length, k) * probability**k * (1 - probability) ** (read_length - k) for k in range(i + 1))

    most = min(most, read_length)
    return [more_than(i - 1 if documented else i) for i in range(1, most + 1)]


def error_tails(read_length: Column, probability: float) -> tuple[Column, Column]:
    """Chances of more than one and of more than two errors in reads of a length that differs by row."""
    n, q = read_length.cast("double"), 1.0 - probability
    none, one = F.pow(F.lit(q), n), n * probability * F.pow(F.lit(q), n - 1)
    two = n * (n - 1) / 2 * probability**2 * F.pow(F.lit(q), n - 2)
    return 1.0 - none - one, 1.0 - none - one - two


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10.0)


def scaled_counts(counts: Column) -> Column:
    """Cumulative counts scaled to end at one million."""
    last = F.element_at(counts, -1)
    return F.transform(counts, lambda c: F.call_function("div", c.cast("long") * 1000000, last.cast("long")))
