"""Segments of a store that holds others too."""
from pyspark.sql import functions as F

from contactforge.plans import experiment


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_segments_of_a_used_store_are_not_collected(spark):
    """What a store holds beside the wanted segments is told apart by names that are dealt out, whether rows are made or read."""
    seqs = spark.createDataFrame([("dealt-a", True, "ACGATCGT" * 40), ("dealt-b", True, "GATCA" * 30)], "seg_id string, linear boolean, seq string")
    segs = seqs.select("seg_id", F.lit("c").alias("cell"), F.lit("r").alias("repl"), F.lit(1.0).alias("copy_number"), "linear")
    s = experiment.Settings(enzymes=["DpnII"])
    both = experiment.prepare(segs, seqs, s)
    new = both._index().where("seg_id = 'dealt-b'")
    made, read = both._of(seqs, new), experiment.prepare(*(t.where("seg_id = 'dealt-b'") for t in (segs, seqs)), s).sites
    for df in (made, read):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)
    assert [r.seg_id for r in made.collect()] == ["dealt-b"]
    assert sorted((r.seg_id, r.pos) for r in read.collect()) == [("dealt-b", 5 * k) for k in range(30)]
