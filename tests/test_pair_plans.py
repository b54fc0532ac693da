"""Plans of pairs: no lookup is made twice."""
from conftest import SMALL
from pyspark.sql import functions as F

from contactforge.operators import weights
from contactforge.plans.queries import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_first_ends_are_found_once(spark, monkeypatch):
    """Both kinds of second ends come from one plan, and a gap that is known isn't looked up again."""
    monkeypatch.setattr(weights, "FEW", 0)
    for name, joins in (("hic_pairs", 6), ("meta3c_templates", 12)):
        assert _plan(QUERIES[name](spark, SMALL)).count("SortMergeJoin") <= joins


def test_sequences_that_know_their_shape_meet_no_profile(spark, monkeypatch):
    from contactforge.plans import experiment

    seen = []
    monkeypatch.setattr(experiment, "identified", lambda s, f=experiment.identified: seen.append(s) or f(s))
    seqs = spark.createDataFrame([("a", True, "ACGATCGT" * 40)], "seg_id string, linear boolean, seq string")
    segs = seqs.select("seg_id", F.lit("c").alias("cell"), F.lit("r").alias("repl"), F.lit(1.0).alias("copy_number"), "linear")
    c = experiment.prepare(segs, seqs, experiment.Settings(enzymes=["DpnII"]))
    assert c.segments.first()["n_sites"] == 40 and c.tiles.count() == 1
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
