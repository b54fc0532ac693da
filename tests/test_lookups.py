"""Lookups of sites at a segment's ends."""
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from contactforge.functions import distributions
from contactforge.operators import digest, reads, weights
from contactforge.operators.enzymes import enzyme
from contactforge.plans.queries import QUERIES, _levels


def test_last_base_is_not_the_first(spark):
    """A circular segment whose last site is on its last base: at 0 stands none, though the distance to it is none."""
    seq = "ATC" + "A" * 60 + "GATC" + "A" * 40 + "G"
    df = spark.createDataFrame([("a", False, seq)], "seg_id string, linear boolean, seq string")
    sites = digest.cut_sites(df, [enzyme("DpnII")])
    assert [r.pos for r in sites.orderBy("pos").collect()] == [63, len(seq) - 1]
    gap = digest.gaps(df.withColumn("length", F.length("seq")), sites)
    rows = spark.createDataFrame([("a", 0, 5, 63), ("a", 0, 70, 63), ("a", 63, 1, 63), ("a", 64, 5, 63)], "seg string, pos long, size long, origin long")
    first, _ = digest.first_toward(F.col("pos"), F.col("origin"))
    found = digest.in_gap(rows, gap, "seg", "pos").select("pos", "size", digest.covers(F.col("pos"), F.col("size")).alias("hit"), first.alias("first")).collect()
    assert {(r.pos, r.size): (r.hit, r.first) for r in found} == {(0, 5): (False, 63), (0, 70): (True, 63), (63, 1): (True, 63), (64, 5): (False, 63)}


@pytest.mark.parametrize("method", ["hic", "meta3c", "dnase"])
def test_large_tables_are_not_collected(spark, monkeypatch, method):
    """Beyond a bound of rows no lookup of a pair goes through the driver, whatever the size of the tables' files."""
    few = sorted(map(str, QUERIES[f"{method}_templates"](spark, SMALL).collect()))
    monkeypatch.setattr(weights, "FEW", 0, raising=False)
    made = QUERIES[f"{method}_templates"](spark, SMALL)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    # The junctions of the enzymes, one or four rows.
    assert plan.count("BroadcastHashJoin") == (method == "hic") and plan.count("SortMergeJoin") >= 5
    assert sorted(map(str, made.collect())) == few


def test_points_are_compiled(spark):
    """The sampled distribution as rows equals its array, and its plan evaluates no function of an array."""
    lengths = spark.createDataFrame([(1,), (7,), (4100,), (20_000_000,)], "l int")
    rows = distributions.sampled_rows(lengths.withColumn("k", F.col("l")), "l")
    want = {(r.l, n): (p.x, p.y) for r in lengths.select("l", distributions.sampled(F.col("l")).alias("p")).collect() for n, p in enumerate(r.p)}
    assert {(r.k, r.n): (r.x, r.y) for r in rows.collect()} == want
    assert "lambdafunction" not in QUERIES["sep_sampled"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_base_errors_by_batches(spark):
    held = _levels(spark).first()
    rows = spark.createDataFrame([(1, "ACGTNacgtnRYx"), (2, ""), (3, "ACGT" * 12)], "idx long, seq string")
    want = rows.withColumn("l", _levels(spark).select("level2").scalar()).select("idx", reads.base_errors(F.col("seq"), F.col("l"), 5, "idx", F.lit(2)).alias("x"))
    want = sorted((r.idx, "".join(x.base for x in r.x), [x.quality for x in r.x]) for r in want.collect())
    assert sorted((r.idx, r.base, r.quality) for r in reads.with_base_errors(rows, held["level2"], 5, 2).collect()) == want
    for name in ("qual_draw", "subst_errors"):
        assert "MapInArrow" in QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
