"""Machine quality profiles: for each read and position, qualities with cumulative counts."""
from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ContactError
from ..functions.distributions import scaled_counts

# Names of the machine profiles that users ask for. Their files are not part of this library.
MACHINES = (
    "Emp100", "Emp36", "Emp44", "Emp50", "Emp75", "EmpMiSeq250", "EmpR36", "EmpR44", "EmpR50", "EmpR75", "HiSeq2500L125", "HiSeq2500L150", "HiSeq2500L150filt",
    "HiSeq2kL100", "HiSeqXPCRfreeL150", "HiSeqXtruSeqL150", "MiSeqv3L250", "NextSeq500v2L75",
)


#: A machine without files: see ``parametric``.
PARAMETRIC = "parametric"
_QUALITIES = (2, 14, 21, 27, 32, 36, 40)


def parametric(spark: SparkSession, read_length: int) -> DataFrame:
    """Levels of a made-up machine for reads of any length: at each position seven qualities in normal shares around a
    mean that falls from 38 by 6 (read 1) or 9 (read 2) with the square of the position, deviation 4 to 7."""
    def share(read: int, pos: int) -> dict:
        x = pos / max(read_length - 1, 1)
        mean, sd = 38 - (6, 9)[read - 1] * x * x, 4 + 3 * x
        weights = [exp(-0.5 * ((q - mean) / sd) ** 2) + 1e-3 for q in _QUALITIES]
        cum = [round(1_000_000 * sum(weights[: k + 1]) / sum(weights)) for k in range(len(weights))]
        return {"cum": cum[:-1] + [1_000_000], "qual": list(_QUALITIES)}

    one = "array<struct<cum:array<bigint>,qual:array<int>>>"
    return spark.createDataFrame([tuple([share(r, p) for p in range(read_length)] for r in (1, 2))], f"level1 {one}, level2 {one}")


def profile_files(name: str, folder: str) -> tuple[str, str]:
    """Where the two files of a named profile are looked for."""
    if name not in MACHINES:
        raise ContactError(f"unknown machine profile {name}")
    return f"{folder}/{name}R1.txt", f"{folder}/{name}R2.txt"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(pos, cum, qual) from (n, value), lines of one file in order: pairs of qualities and cumulative counts for all
    symbols; only the combined ones (``.``) are used. Reading stops at the first blank line."""
    end = lines.where("trim(value) = ''").agg(F.min("n").alias("e"))
    kept = lines.withColumn("e", end.scalar()).where("(e IS NULL OR n < e) AND NOT startswith(value, '#')")
    parts = F.split("value", "\t")
    kept = kept.where(F.element_at(parts, 1) == ".").select("n", F.element_at(parts, 2).cast("int").alias("pos"), F.transform(F.filter(F.slice(parts, 3, 100000), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long")).alias("v"))
    both = kept.withColumn("k", F.row_number().over(Window.partitionBy("pos").orderBy("n")))
    rows = both.groupBy("pos").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("q"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("c"), F.count("*").alias("lines"))
    bad = (F.col("lines") != 2) | (F.size("q") != F.size("c")) | (F.size("q") < 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad quality profile at position "), F.col("pos").cast("string")))).otherwise(F.col("c"))
    return rows.select("pos", scaled_counts(checked).alias("cum"), F.transform("q", lambda x: x.cast("int")).alias("qual"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    numbered = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return parse_lines(numbered)


def levels(first: DataFrame, second: DataFrame, read_length: int) -> DataFrame:
    """One row: level1 and level2, arrays over the read's positions. An error if a profile is shorter."""
    out = []
    for df, name in ((first, "level1"), (second, "level2")):
        n = df.where(F.col("pos") < read_length).count()
        if n < read_length:
            raise ContactError(f"the profile has {n} positions, reads have {read_length}")
        ordered = F.array_sort(F.collect_list(F.struct("pos", "cum", "qual")))
        out.append(df.where(F.col("pos") < read_length).agg(F.transform(ordered, lambda x: F.struct(x["cum"].alias("cum"), x["qual"].alias("qual"))).alias(name)))
    return out[0].withColumn("level2", out[1].scalar())
