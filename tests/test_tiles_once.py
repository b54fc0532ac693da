"""Files are read once for their tiles, and texts become bases in one step."""
from conftest import SMALL
from pyspark.sql import functions as F

from contactforge.plans import corpus
from contactforge.sources import tiled


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_one_scan_cuts_all_tiles(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nACGTACGTAC\nGTA\n>b\nACG\n")
    segs = spark.createDataFrame([("a", False), ("b", True)], "seg_id string, linear boolean")
    made = tiled.SequenceFiles(spark, f"file://{tmp_path}/g.fa").tiles(segs, 5, 8)
    plan = _plan(made)
    assert plan.count("FileScan text") == 1 and "BroadcastHashJoin" not in plan
    assert {(r.seg_id, r.tile): r.part for r in made.collect()} == {("a", 0): "ACGTACGTACGTA", ("a", 1): "ACGTAACGTA", ("b", 0): "ACG"}


def test_records_are_counted_once(spark, tmp_path, monkeypatch):
    """Ranges are sampled from a written table, not from the files again; rows are handed on together."""
    seen = []
    monkeypatch.setattr(tiled.prefix, "running", lambda rows, *a, f=tiled.prefix.running: seen.append(_plan(rows)) or f(rows, *a))
    (tmp_path / "g.fa").write_text("".join(f">s{k}\nACGT\n" for k in range(1200)))
    source = tiled.SequenceFiles(spark, f"file://{tmp_path}/g.fa")
    assert source.lengths().agg(F.count("*"), F.sum("length")).first() == (1200, 4800)
    assert len(seen) == 1 and "MapInArrow" not in seen[0] and "Scan parquet" in seen[0]


def test_bases_of_odd_texts(spark):
    """One step gives what a regular expression and two translations give, and is left out where nobody asks for bases."""
    odd = spark.createDataFrame([(None,), ("",), ("12 .",), ("ßaÄb ıI ſs KK zZ \U0001f600x\x00y\n",), ("ﬁ ab́C",)], "text string")
    rows = odd.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("text"))
    plain = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), corpus.LETTERS, corpus.BASES)
    both = rows.select(plain.alias("plain"), corpus.dna("text").alias("made"))
    assert both.where(~F.col("plain").eqNullSafe(F.col("made"))).count() == 0
    genome = corpus.genome(spark, SMALL)
    assert "translate" not in _plan(genome) and _plan(genome).count("ArrowEvalPython") == 1
    assert "ArrowEvalPython" not in _plan(genome.select("seg_id", "cell"))
