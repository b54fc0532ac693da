"""Digested tables that are kept: reuse without a digest, rebuilt segments, writers side by side."""
import random

import pytest
from pyspark.sql import functions as F

from contactforge import store
from contactforge.operators import digest
from contactforge.plans.experiment import Settings, draw_pairs, prepare, templates
from contactforge.store import Store, file_stamp

SETTINGS = Settings(enzymes=["DpnII", "HinfI"], seed=3, insert_mean=150, insert_sd=20, read_length=40)


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


@pytest.fixture
def kept(spark, tmp_path):
    spark.conf.set(store.SETTING, f"file://{tmp_path}/store")
    yield Store(spark)
    spark.conf.unset(store.SETTING)


def community(spark, changed=(), stamp=None, linear=False, names=range(6)):
    seqs = spark.createDataFrame([(f"s{i}", dna(5000 + i, 100 + i if i in changed else i)) for i in names], "seg_id string, seq string")
    segs = spark.createDataFrame([(f"s{i}", f"c{i % 2}", f"r{i % 3}", 1.0 + i, linear) for i in names], "seg_id string, cell string, repl string, copy_number double, linear boolean")
    return prepare(segs, seqs, SETTINGS, stamp)


def rows(c):
    """All that a community digests."""
    order = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    return [order(x) for x in (c.sites, c.tiles, c.gaps, c.segments)]


def sizes(kept, kind):
    """Segments of each generation of the first table of the kind."""
    kind = next(n for n in kept._listed("") if n.startswith(kind))
    return sorted(kept.spark.read.parquet(f"{kept.root}/{kind}/index-{g}").count() for g in kept.generations(kind))


def test_known_stamps_digest_nothing(spark, kept, monkeypatch):
    numbers = spark.range(1, 100).withColumnRenamed("id", "idx")
    pairs = lambda c: sorted(map(repr, templates(draw_pairs(numbers, c, SETTINGS), c, SETTINGS).collect()))
    c = community(spark, stamp="a")
    first = rows(c), pairs(c)

    def never(*a, **k):
        raise AssertionError("digested again")

    for name in ("tiles", "cut_sites", "gaps"):
        monkeypatch.setattr(digest, name, never)
    monkeypatch.setattr("contactforge.plans.experiment.identified", never)
    c = community(spark, stamp="a")
    assert (rows(c), pairs(c)) == first
    # Another method under the same stamp knows the segments' lengths, too.
    own = SETTINGS
    monkeypatch.setattr("test_store.SETTINGS", Settings(method="dnase"))
    assert sorted(r.length for r in community(spark, stamp="a").segments.collect()) == [5000 + i for i in range(6)]
    monkeypatch.setattr("test_store.SETTINGS", own)
    with pytest.raises(AssertionError):
        rows(community(spark, changed=[1], stamp="b"))


def test_a_changed_base_costs_its_segment(spark, kept):
    rows(community(spark, stamp="a"))
    changed = rows(community(spark, changed=[4], stamp="b"))
    assert sizes(kept, "sites") == sizes(kept, "tiles") == sizes(kept, "gaps") == [1, 6]
    rows(community(spark))  # the first again, without a stamp
    fewer = rows(community(spark, changed=[4], names=range(2, 6)))
    assert sizes(kept, "sites") == [1, 6]
    turned = rows(community(spark, linear=True))
    assert sizes(kept, "sites") == [1, 6, 6]
    kept.clear()
    assert rows(community(spark, changed=[4])) == changed and rows(community(spark, changed=[4], names=range(2, 6))) == fewer and rows(community(spark, linear=True)) == turned


def test_two_writers_of_one_segment(spark, kept, monkeypatch):
    first = rows(community(spark))
    real, seen = Store.generations, []
    monkeypatch.setattr(Store, "generations", lambda self, kind: real(self, kind) if seen else seen.append(kind) or [])
    asked = store.identified(spark.createDataFrame([(f"s{i}", dna(5000 + i, i), False) for i in range(3)], "seg_id string, seq string, linear boolean"))
    kind = next(n for n in kept._listed("") if n.startswith("sites"))
    # The second writer looked before the first one's generation was there.
    again = kept.rows(kind, lambda: asked, lambda new: spark.read.parquet(f"{kept.root}/{kind}/data-*").join(new.select("seg_id"), "seg_id", "left_semi"))
    assert sizes(kept, "sites") == [3, 6] and rows(community(spark)) == first
    assert sorted(map(repr, again.select(sorted(again.columns)).collect())) == [r for r in first[0] if any(f"'s{i}'" in r for i in range(3))]


def test_stamps_follow_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a").write_text("one")
    one = file_stamp(spark, str(tmp_path / "x"), "read")
    assert one == file_stamp(spark, str(tmp_path / "x"), "read") != file_stamp(spark, str(tmp_path / "x"), "otherwise")
    (tmp_path / "x/a").write_text("other")
    assert one != file_stamp(spark, str(tmp_path / "x"), "read")


def test_weights_without_a_global_window(spark):
    from contactforge.operators import weights
    from contactforge.sources import profile

    t = spark.createDataFrame([("c", "r", f"s{i}", i) for i in range(50)], "cell string, repl string, seg_id string, w long")
    for df in (weights.running(t, "w"), weights.cdf(t, "w"), weights.cdf(t, "w", "cell"), profile.distribute(t.select(F.col("seg_id").alias("name")), "uniform")):
        assert "Window" not in df._jdf.queryExecution().toString()
