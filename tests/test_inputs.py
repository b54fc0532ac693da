"""FASTA records, doubled segments, output files, profiles on disk, the default machine."""
import bz2
import gzip
import logging
import random

import pytest
from pyspark.sql import functions as F

from contactforge import cli
from contactforge.errors import ContactError, OutOfBounds, SequenceError, SingleReplicon
from contactforge.functions import distributions, draws
from contactforge.operators import domains, weights
from contactforge.plans.experiment import Settings, prepare
from contactforge.sinks.records import write_profile
from contactforge.sources import fasta, quality


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def test_fasta_headers_with_arrows(spark, tmp_path):
    (tmp_path / "g.fa").write_bytes(b">s1 alpha->beta >gamma\r\nACG\r\nt\r\n>s2\nAC\n\nGT\n>s3 x\n>s4 nothing before\nNNN")
    got = {r.seg_id: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "g.fa")).collect()}
    assert got == {"s1": "ACGT", "s2": "ACGT", "s3": "", "s4": "NNN"}


def test_doubled_segments_are_an_error(spark, tmp_path):
    (tmp_path / "g.fa").write_text("".join(f">s{i}\n{dna(3000, i)}\n" for i in range(2)))
    args = ["-e", "DpnII", "-n", "100", "-l", "30", "-r", "1", "--simple-reads", "-P", str(tmp_path / "p.tsv"), str(tmp_path / "g.fa"), str(tmp_path / "o.fq")]
    (tmp_path / "p.tsv").write_text("s0\tc1\tr1\t1\t1\ns1\tc1\tr2\t1\t1\ns1\tc2\tr1\t1\t1\n")
    assert cli.main(args, spark) == 1
    (tmp_path / "p.tsv").write_text("s0\tc1\tr1\t1\t1\ns1\tc1\tr2\t1\t1\n")
    assert cli.main(args, spark) == 0
    assert (tmp_path / "o.fq").read_text().count("\n") == 100 * 8
    seg = spark.createDataFrame([("a", "c", "r", 1.0, False)] * 2, "seg_id string, cell string, repl string, copy_number double, linear boolean")
    with pytest.raises(SequenceError, match="repeated"):
        prepare(seg, spark.createDataFrame([("a", dna(2000, 1))], "seg_id string, seq string"), Settings(enzymes=["DpnII"]))


def test_outputs_are_single_files_in_order(spark, tmp_path, capsys):
    (tmp_path / "g.fa").write_text("".join(f">s{i}\n{dna(3000, i)}\n" for i in range(3)))
    common = ["-e", "DpnII", "-n", "300", "-l", "40", "-r", "1", str(tmp_path / "g.fa")]  # the default machine, with errors
    assert cli.main([*common, str(tmp_path / "r.fq.gz")], spark) == 0
    assert "wgs_count" in capsys.readouterr().out
    assert cli.main([*common, str(tmp_path / "r1.fq.bz2"), str(tmp_path / "r2.fq.bz2")], spark) == 0
    with gzip.open(tmp_path / "r.fq.gz", "rt") as f:
        both = f.read().splitlines()
    split = []
    for n in (1, 2):
        with bz2.open(tmp_path / f"r{n}.fq.bz2", "rt") as f:
            split.append(f.read().splitlines())
    heads = [int(x.split(":")[5].split(" ")[0]) for x in both[::4]]
    assert heads == [i for i in range(1, 301) for _ in (1, 2)]
    assert split[0] == [x for i in range(0, len(both), 8) for x in both[i : i + 4]] and split[1] == [x for i in range(0, len(both), 8) for x in both[i + 4 : i + 8]]
    assert cli.main([*common, "--folders", str(tmp_path / "parts.fq")], spark) == 0 and (tmp_path / "parts.fq").is_dir()


def test_profile_files_are_kept(spark, tmp_path, caplog):
    rows = spark.createDataFrame([("s2", "c", "m", 0.5, 1.0), ("s1", "c", "m", 0.5, 2.0)], "seg_id string, cell string, repl string, abundance double, copy_number double")
    path = str(tmp_path / "p.tsv")
    write_profile(rows, path)
    assert (tmp_path / "p.tsv").read_text() == "#chrom\tcell\tmolecule\tabundance\tcopy_number\ns1\tc\tm\t0.500000\t2\ns2\tc\tm\t0.500000\t1\n"
    with pytest.raises(ContactError, match="exists"):
        write_profile(rows, path)
    write_profile(rows, path, overwrite=True)
    (tmp_path / "g.fa").write_text("".join(f">s{i}\n{dna(2000, i)}\n" for i in range(3)))
    args = ["-v", "-e", "DpnII", "-n", "20", "-l", "30", "--dist", "uniform", "--simple-reads", "--profile-name", path, str(tmp_path / "g.fa"), str(tmp_path / "o.fa")]
    assert cli.main(args, spark) == 1
    with caplog.at_level(logging.INFO):
        assert cli.main([*args[:-2], "--overwrite", *args[-2:]], spark) == 0
    assert any("contactforge 0" in r.message for r in caplog.records)


def test_parametric_machine(spark):
    row = quality.parametric(spark, 60).first()
    for name in ("level1", "level2"):
        assert len(row[name]) == 60
        assert all(x["cum"] == sorted(x["cum"]) and x["cum"][-1] == 1_000_000 and len(x["cum"]) == len(x["qual"]) for x in row[name])
    mean = lambda x: sum(q * (c - p) for q, c, p in zip(x["qual"], x["cum"], [0, *x["cum"]], strict=False)) / 1e6
    assert mean(row["level1"][0]) > mean(row["level1"][-1]) > mean(row["level2"][-1])


def test_checks_raise_their_own_errors(spark):
    rows = spark.createDataFrame([("c", 1, 5, 4), ("d", 2, 1, 4)], "cell string, n_repl int, x int, length int")
    with pytest.raises(SingleReplicon):
        weights.check_other_replicons(rows)
    weights.check_other_replicons(rows.where("cell = 'd'"))
    with pytest.raises(OutOfBounds):
        distributions.check_bounds(rows, "x", "length")
    distributions.check_bounds(rows.where("cell = 'd'"), "x", "length")


def test_every_base_is_a_site_without_enzymes(spark):
    seg = spark.createDataFrame([("a", "c", "r", 1.0, False)], "seg_id string, cell string, repl string, copy_number double, linear boolean")
    seqs = spark.createDataFrame([("a", dna(2000, 1))], "seg_id string, seq string")
    rows = spark.createDataFrame([("a", 5, 1), ("a", 1900, 1500)], "seg string, pos long, size int")
    assert [r.covered for r in prepare(seg, seqs, Settings(method="dnase")).covers(rows, "seg", "pos", "size").collect()] == [True, True]
    assert prepare(seg, seqs, Settings(enzymes=["DpnII"])).covers(rows, "seg", "pos", "size").where("covered").count() >= 1


def test_intervals_across_stretches(spark):
    r = random.Random(3)
    doms = [("x", b := r.randrange(10**6), b + r.randrange(0, 400_000)) for _ in range(60)]
    points = [("x", r.randrange(1_400_000)) for _ in range(300)] + [("x", d[1]) for d in doms] + [("x", d[2]) for d in doms]
    got = domains.containing(spark.createDataFrame(points, "chrom string, x long").distinct(), spark.createDataFrame([(*d, 0.1) for d in doms], "chrom string, begin long, end long, prob double"))
    want = sorted((x, b, e) for x in {p for _, p in points} for _, b, e in doms if b <= x < e)
    assert sorted((q.x, q.begin, q.end) for q in got.collect()) == want


def test_numbered_draws_are_even(spark):
    import numpy as np

    keys = np.array([[0x12345678, 0x9ABCDEF0]], np.uint32).repeat(6000, 0)
    u = draws.counted_array(keys, np.arange(6000))
    assert abs(u.mean() - 0.5) < 0.02 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.05 and np.histogram(u, 10, (0, 1))[0].min() > 500
    got = spark.range(50).select(draws.counted(F.lit("123456789abcdef0" + "0" * 16), F.col("id")).alias("u")).collect()
    assert [r.u for r in got] == u[:50].tolist()


def test_parts_are_joined_by_tasks(spark, tmp_path, monkeypatch):
    """Each part at its own place, whatever was there before; the driver reads none of them."""
    from contactforge.sinks import records

    monkeypatch.setattr(records, "BLOCK", 7)
    folder = tmp_path / "with space"
    for codec, opened in (("none", open), ("gzip", gzip.open), ("bzip2", bz2.open)):
        folder.mkdir(exist_ok=True)
        (folder / "out").write_text("something longer that was there before" * 100)
        spark.range(0, 1000, 1, 7).select(F.concat(F.lit("line "), F.col("id").cast("string"))).write.mode("overwrite").option("compression", codec).text(f"{folder}/out.parts")
        assert records.joined_parts(spark, f"{folder}/out.parts", f"{folder}/out") == "places"
        with opened(folder / "out", "rt") as f:
            assert f.read() == "".join(f"line {i}\n" for i in range(1000))
        assert sorted(p.name for p in folder.iterdir()) == ["out"]
    spark.createDataFrame([], "v string").write.text(f"{folder}/none.parts")
    records.joined_parts(spark, f"{folder}/none.parts", f"{folder}/none")
    assert (folder / "none").read_text() == ""
    assert spark.read.text(f"{folder}/none").count() == 0


def test_an_interval_is_listed_once(spark):
    r = random.Random(9)
    doms = [("x", 0, 2**33), ("x", 16383, 16385), ("x", 5, 5), *(("x", b := r.randrange(2**31), b + r.randrange(1, 2**r.randrange(1, 31))) for _ in range(200))]
    df = spark.createDataFrame(doms, "chrom string, begin long, end long")
    bins = domains.binned(df).collect()
    assert len(bins) == len(doms) - 1 and all(b.begin >> b.level == (b.end - 1) >> b.level == b.bin for b in bins)
    xs = sorted({x for _, b, e in doms for x in (b - 1, b, e - 1, e) if x >= 0})
    got = domains.containing(spark.createDataFrame([("x", x) for x in xs], "chrom string, x long"), df)
    assert sorted((q.x, q.begin, q.end) for q in got.collect()) == sorted((x, b, e) for x in xs for _, b, e in doms if b <= x < e)


def test_a_replicon_of_many_segments_as_toml(spark, tmp_path):
    """Headings and ends of lists across many ranges; names are quoted, and no plan gathers a list."""
    from contactforge.sinks.records import toml_lines, write_toml
    from contactforge.sources import profile

    rows = [(f's{i:05d}\\"x', "c1", "r1", 0.25, 2.0) for i in range(20_000)] + [("a", "c1", "r0", 0.25, 1.0), ("b", 'c"2', "r", 0.75, 1e-5)]
    df = spark.createDataFrame(rows, "seg_id string, cell string, repl string, abundance double, copy_number double").repartition(8)
    write_toml(df, str(tmp_path / "c.toml"), 0.03)
    back, spurious = profile.read_toml(spark, (tmp_path / "c.toml").read_text())
    assert spurious == 0.03 and sorted(map(tuple, back.select("seg_id", "cell", "repl", "abundance", "copy_number").collect())) == sorted(rows)
    text = (tmp_path / "c.toml").read_text()
    assert text.count("[[community.cells]]") == 2 and text.count("[[community.cells.replicons]]") == 3
    plan = toml_lines(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
