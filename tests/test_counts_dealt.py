"""Counts of sites."""
from contactforge.plans import experiment


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_counts_of_sites_are_not_collected(spark, monkeypatch):
    """What brings lengths and counts of sites to the segments is dealt out, one row a segment."""
    seen = []
    monkeypatch.setattr(experiment, "written", lambda df, f=experiment.written: seen.append(_plan(df)) or f(df))
    segs = spark.createDataFrame([("a", "c", "r", 1.0, True)], "seg_id string, cell string, repl string, copy_number double, linear boolean")
    c = experiment.prepare(segs, spark.createDataFrame([("a", "ACGATCGT" * 40)], "seg_id string, seq string"), experiment.Settings(enzymes=["DpnII"]))
    assert c.segments.first()["n_sites"] == 40
    base = next(p for p in seen if "copy_milli" in p)
    assert base.count("SortMergeJoin") == 2 and "Broadcast" not in base
