"""Sequence files as tiles: any split, any line width, ranges in proportion to what is asked for."""
import random

import pytest
from pyspark.sql import functions as F

from contactforge import store
from contactforge.errors import SequenceError
from contactforge.operators import digest
from contactforge.plans.experiment import Settings, prepare
from contactforge.sources import fasta, tiled

KINDS = [tiled.SequenceFiles, tiled.IndexedFiles]


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def text(records, width=60, end="\n"):
    out = []
    for name, seq in records:
        out.append(f">{name} of > something{end}")
        out += [seq[i : i + width] + end for i in range(0, len(seq), width)]
    return "".join(out)


def plain(spark, records, linear, overlap, tile):
    df = spark.createDataFrame([(n, s, linear(n)) for n, s in records], "seg_id string, seq string, linear boolean")
    return rows(digest.tiles(df, overlap, tile))


def rows(df):
    return sorted(map(repr, df.select("seg_id", "linear", "length", "tile", "part").collect()))


@pytest.fixture
def splits(spark):
    """Splits of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


RECORDS = [("long", dna(5000, 1)), ("short", dna(7, 2)), ("none", ""), ("middle", dna(480, 3)), ("x", dna(61, 4))]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("width,end", [(60, "\n"), (53, "\r\n"), (10**6, "\n"), (10**6, "\r\n")])
def test_any_split_equals_the_whole(spark, splits, tmp_path, monkeypatch, kind, width, end):
    monkeypatch.setattr(tiled, "RANGE", 1000)
    monkeypatch.setattr(tiled, "CHUNK", 200)
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.fa").write_text(text(RECORDS[:3], width, end).lower().replace("long", "long").rstrip("\r\n"), newline="")
    (tmp_path / "g/b.fa").write_text(text(RECORDS[3:], width, end), newline="")
    source = kind(spark, f"file://{tmp_path}/g")
    linear = lambda n: n in ("long", "x")
    segs = spark.createDataFrame([(n, linear(n)) for n, _ in RECORDS], "seg_id string, linear boolean")
    for overlap, tile in ((30, 64), (150, 64)):
        assert rows(source.tiles(segs, overlap, tile)) == plain(spark, RECORDS, linear, overlap, tile)
    turned = segs.withColumn("linear", ~F.col("linear"))
    assert rows(source.tiles(turned, 100, 64)) == plain(spark, RECORDS, lambda n: not linear(n), 100, 64)
    assert {(r.seg_id, r.length) for r in source.lengths().collect()} == {(n, len(s)) for n, s in RECORDS}


@pytest.mark.parametrize("kind", KINDS)
def test_uneven_lines_and_errors(spark, splits, tmp_path, kind):
    (tmp_path / "u.fa").write_text(">a\nACG T\nAC\n\nACGTACGT\nA\n>b\nNNRYN\n")
    segs = spark.createDataFrame([("a", True), ("b", True)], "seg_id string, linear boolean")
    got = kind(spark, f"file://{tmp_path}/u.fa", convert=True).tiles(segs, 5, 64).collect()
    assert {r.seg_id: r.part for r in got} == {"a": "ACGTACACGTACGTA", "b": "NNNNN"}
    with pytest.raises(Exception, match="illegal symbols in sequence b"):
        kind(spark, f"file://{tmp_path}/u.fa").tiles(segs, 5, 64).collect()
    (tmp_path / "twice.fa").write_text(">a\nAC\n>a\nGT\n")
    (tmp_path / "empty.fa").write_text("")
    for name, why in (("twice", "repeated"), ("empty", "no sequences")):
        with pytest.raises(SequenceError, match=why):
            kind(spark, f"file://{tmp_path}/{name}.fa").lengths().collect()


def test_bases_without_a_header(spark, tmp_path):
    (tmp_path / "h.fa").write_text("ACGT\n>a\nACGT\n")
    with pytest.raises(SequenceError, match="before the first header"):
        tiled.SequenceFiles(spark, str(tmp_path / "h.fa")).lengths().collect()


def test_bytes_follow_what_is_asked_for(spark, tmp_path):
    spark.conf.set(store.SETTING, f"file://{tmp_path}/store")
    try:
        records = [(f"s{i}", dna(20_000, i)) for i in range(20)]
        (tmp_path / "g.fa").write_text(text(records))
        source = tiled.IndexedFiles(spark, f"file://{tmp_path}/g.fa")
        source.lengths().collect()
        for n in (1, 5, 20):
            segs = spark.createDataFrame([(f"s{i}", True) for i in range(n)], "seg_id string, linear boolean")
            read = source.taken(segs, 400).agg(F.sum("read")).first()[0]
            assert read == pytest.approx(n * 20_000 * 61 / 60, rel=0.01)
    finally:
        spark.conf.unset(store.SETTING)


@pytest.mark.parametrize("kind", KINDS)
def test_communities_from_files(spark, splits, tmp_path, kind):
    """A community digested from tiles equals one from whole sequences."""
    records = [(f"s{i}", dna(3000 + i, i)) for i in range(3)]
    (tmp_path / "g.fa").write_text(text(records))
    s = Settings(enzymes=["DpnII"], insert_mean=150, insert_sd=20)
    segs = spark.createDataFrame([(n, "c", "r", 1.0, n == "s1") for n, _ in records], "seg_id string, cell string, repl string, copy_number double, linear boolean")
    order = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    one = prepare(segs, fasta.read_fasta(spark, str(tmp_path / "g.fa")), s)
    other = prepare(segs, kind(spark, f"file://{tmp_path}/g.fa"), s)
    for x, y in ((one.sites, other.sites), (one.tiles, other.tiles), (one.gaps, other.gaps), (one.segments, other.segments)):
        assert order(x) == order(y)
