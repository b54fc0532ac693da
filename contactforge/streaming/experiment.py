"""The same experiment over a stream: pair numbers arrive as a stream, the community is static.

Every step of a pair is a stateless expression or a join of the stream with a static table, so the plan of
``plans.experiment`` runs unchanged and a micro-batch gives the rows that a batch run gives for its numbers.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.experiment import Community, Settings, simulate


def numbers(spark: SparkSession, rows_per_second: int = 1000) -> DataFrame:
    """An endless stream of pair numbers from 1."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select((F.col("value") + 1).alias("idx"))


def simulate_stream(stream: DataFrame, community: Community, settings: Settings, sink, levels: DataFrame | None = None, checkpoint: str | None = None):
    """Start a query that hands each micro-batch of read pairs, made from the stream's numbers, to ``sink(df, epoch)``."""
    def batch(df: DataFrame, epoch: int) -> None:
        sink(simulate(df, community, settings, levels), epoch)

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
