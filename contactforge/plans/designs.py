"""Many experiments' parameters at once: a table of designs is checked by the rules that ``Settings`` has for one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .experiment import METHODS


def problems() -> list[tuple[Column, str]]:
    """The rules in order: what is wrong, and how it is said. Null parameters are not given."""
    c = F.col
    dnase = c("method") == "dnase"
    return [
        (~F.coalesce(c("method").isin(*METHODS), F.lit(False)), "unknown method"),
        (dnase & (c("n_enzymes") > 0), "dnase takes no enzymes"),
        (~dnase & ~c("n_enzymes").between(1, 2), "one or two enzymes are needed"),
        (c("bridge").isNotNull() & ~dnase, "a bridge is for dnase only"),
        (c("bridge").isNotNull() & ~F.upper("bridge").rlike(r"\A[ACGT]+\z"), "a bridge holds ACGT only"),
        (~((c("insert_min") > 50) & (c("insert_min") < c("insert_mean")) & (c("insert_sd") > 0)), "inserts need 50 < minimum < mean and a positive deviation"),
        (c("insert_max").isNotNull() & (c("insert_max") <= c("insert_mean")), "the largest insert must be above the mean"),
        (c("read_length") < 1, "reads need a positive length"),
    ]


def checked(designs: DataFrame) -> DataFrame:
    """Adds problem (the first rule that a design breaks, or null) and the efficiency in effect (the method's where none, or
    zero, is given; null for an unknown method)."""
    first = F.coalesce(*(F.when(wrong, F.lit(said)) for wrong, said in problems()))
    usual = F.create_map(*(F.lit(x) for pair in METHODS.items() for x in pair))[F.col("method")]
    given = F.when(F.col("efficiency") != 0, F.col("efficiency"))
    return designs.withColumn("problem", first).withColumn("efficiency", F.coalesce(given, usual))
