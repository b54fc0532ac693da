"""FASTA files as a DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SequenceError
from ..functions.sequence import ambiguous_to_n, checked


def read_fasta(spark: SparkSession, path: str, convert: bool = False, validate: bool = True) -> DataFrame:
    """(seg_id, seq): the name up to the first blank, and the upper-case sequence. A record begins with ``>`` at the start
    of a line; one elsewhere in a header is part of it.

    ``convert`` turns ambiguous symbols into N; ``validate`` makes other symbols than ACGTN an error when read.
    Compressed files are read as they are; each record must fit into one row (2 GB).
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"\A\s*>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"\A([^\r\n]*)", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s", "")
    out = raw.select(F.regexp_extract(head, r"\A\s*(\S+)", 1).alias("seg_id"), F.upper(body).alias("seq"))
    if convert:
        out = out.withColumn("seq", ambiguous_to_n(F.col("seq")))
    if validate:
        out = out.withColumn("seq", checked(F.col("seq"), F.col("seg_id")))
    return out


def repeated(sequences: DataFrame, name: str = "seg_id") -> DataFrame:
    """(name, count) of names that are there more than once."""
    return sequences.groupBy(name).count().where("count > 1")


def check_unique(sequences: DataFrame, name: str = "seg_id") -> None:
    """SequenceError if a name is repeated, of sequences or of a profile's segments, or none is there."""
    again = repeated(sequences, name).limit(5).collect()
    if again:
        raise SequenceError("repeated names: " + ", ".join(r[0] for r in again))
    if sequences.limit(1).count() == 0:
        raise SequenceError("no sequences")


def sequence_ids(sequences: DataFrame) -> DataFrame:
    return sequences.select("seg_id")


def check_known(segments: DataFrame, sequences: DataFrame) -> None:
    """SequenceError if a segment of the profile has no sequence."""
    lost = segments.join(sequences.select("seg_id"), "seg_id", "left_anti").limit(5).collect()
    if lost:
        raise SequenceError("segments without sequence: " + ", ".join(r["seg_id"] for r in lost))
