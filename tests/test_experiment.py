"""Digestion and whole experiments against plain Python."""
import random
import re

import pytest
from pyspark.sql import functions as F

from contactforge import cli
from contactforge.errors import ContactError, NoCutSites
from contactforge.operators import digest, reads
from contactforge.operators.enzymes import enzyme
from contactforge.plans.experiment import Settings, draw_pairs, prepare, simulate, templates
from contactforge.plans.queries import _levels


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def plain_sites(seq, linear, names):
    out = set()
    for i, n in enumerate(names):
        e = enzyme(n)
        long = seq if linear else seq + seq[: len(e.site) - 1]
        for m in re.finditer(f"(?={e.site.replace('N', '[ACGT]')})", long):
            p = m.start() + e.cut
            if m.start() < len(seq) and (not linear or p < len(seq)):
                out.add((p % len(seq), i))
    return sorted(out)


@pytest.mark.parametrize("linear", [True, False])
def test_sites_and_lookups(spark, linear):
    seqs = {"a": "TC" + dna(56, 1).replace("GATC", "GTTC") + "GA", "b": dna(9000, 2), "c": "A" * 50, "d": "GATC", "e": dna(4100, 3) + "GATC" + dna(100, 4)}
    names = ["DpnII", "HinfI"]
    df = spark.createDataFrame([(k, linear, v) for k, v in seqs.items()], "seg_id string, linear boolean, seq string")
    sites = digest.cut_sites(df, [enzyme(n) for n in names], tile=64)
    got = {}
    for r in sites.orderBy("seg_id", "rank").collect():
        got.setdefault(r.seg_id, []).append((r.pos, r.enz))
    want = {k: s for k, v in seqs.items() if (s := plain_sites(v, linear, names))}
    assert got == want
    gap = digest.gaps(df.withColumn("length", F.length("seq")), sites, tile=64)
    r = random.Random(5)
    probes = [(s, r.randrange(len(seqs[s])), r.randrange(1, 300)) for s in want for _ in range(60)]
    rows = digest.in_gap(spark.createDataFrame(probes, "seg string, pos long, size long"), gap, "seg", "pos", tile=64)
    at, _ = digest.nearest(F.col("pos"))
    for row in rows.select("seg", "pos", "size", at.alias("near"), digest.covers(F.col("pos"), F.col("size")).alias("hit")).collect():
        n, own = len(seqs[row.seg]), [p for p, _ in want[row.seg]]
        turn = n - 1
        there = own if linear else [own[-1] - turn, *own, own[0] + turn]
        best = min(there, key=lambda p: (abs(p - row.pos), p))
        assert row.near == (best if linear else best % turn), row
        if linear:
            hit = any(row.pos < p <= row.pos + row.size for p in own)
        elif row.pos + row.size > turn:
            hit = any(p <= (row.pos + row.size) % turn or p >= row.pos for p in own)
        else:
            hit = any(row.pos <= p <= row.pos + row.size for p in own)
        assert row.hit == hit, row


@pytest.fixture(scope="module")
def tables(spark):
    names = [("s1", "c1", "r1"), ("s2", "c1", "r1"), ("s3", "c1", "r2"), ("s4", "c2", "r1"), ("s5", "c3", "r1")]
    seqs = {n: dna(3000 + 500 * i, 10 + i) for i, (n, _, _) in enumerate(names)} | {"s5": "A" * 500}
    seg = spark.createDataFrame([(*n, float(1 + i % 2), False) for i, n in enumerate(names)], "seg_id string, cell string, repl string, copy_number double, linear boolean")
    return seg, spark.createDataFrame(list(seqs.items()), "seg_id string, seq string"), seqs


@pytest.mark.parametrize("method", ["hic", "meta3c", "dnase"])
def test_experiment(spark, tables, method):
    seg, seq, seqs = tables
    s = Settings(method=method, enzymes=[] if method == "dnase" else ["DpnII"], seed=4, read_length=40, insert_mean=150, insert_sd=20, efficiency=0.5)
    c = prepare(seg, seq, s)
    numbers = spark.range(1, 801).withColumnRenamed("id", "idx")
    p = {r.idx: r for r in draw_pairs(numbers, c, s).collect()}
    assert sorted(p) == list(range(1, 801))
    n3c = sum(r.mode == "3C" for r in p.values())
    assert (300 < n3c < 500) if method != "meta3c" else (50 < n3c < 400)
    if method != "dnase":
        assert "s5" not in {r.seg_id1 for r in p.values()}  # no site
    cells = {"s1": ("c1", "r1"), "s2": ("c1", "r1"), "s3": ("c1", "r2"), "s4": ("c2", "r1"), "s5": ("c3", "r1")}
    for r in p.values():
        if r.kind == "trans":
            assert cells[r.seg_id1][0] == cells[r.seg_id2][0] and cells[r.seg_id1] != cells[r.seg_id2]
        if r.kind == "cis":
            assert cells[r.seg_id1] == cells[r.seg_id2]
        if r.mode == "3C" and method == "hic":
            assert (r.pos1, r.enz1) in plain_sites(seqs[r.seg_id1], False, ["DpnII"])
    again = {r.idx: r for r in draw_pairs(numbers.repartition(9), c, s).collect()}
    assert again == p
    made = {r.idx: r.template for r in templates(draw_pairs(numbers, c, s), c, s).collect()}
    for i, r in p.items():
        def part(name, start, size):
            q = seqs[name]
            start = start % len(q) if start < 0 else start
            return (q + q)[start : start + size]

        if r.mode == "WGS":
            want = part(r.seg_id1, r.pos1, r.ins_len)
        else:
            middle = "GATCGATC" if method == "hic" else ""
            want = part(r.seg_id1, r.pos1 - r.midpoint, r.midpoint) + middle + part(r.seg_id2, r.pos2, r.ins_len - r.midpoint)
        assert made[i] == want, r
    c.release()


def test_reads(spark, tables):
    seg, seq, _ = tables
    base = {"enzymes": ["DpnII"], "seed": 4, "read_length": 40, "insert_mean": 150, "insert_sd": 20}
    s = Settings(**base)
    c = prepare(seg, seq, s)
    numbers = spark.range(1, 301).withColumnRenamed("id", "idx")
    simple = {r.idx: r for r in simulate(numbers, c, s).collect()}
    assert all(len(r.seq1) == len(r.seq2) == 40 and r.qual1 == [40] * 40 for r in simple.values())
    levels = _levels(spark)
    noisy = {r.idx: r for r in simulate(numbers, c, Settings(**base, simple=False, ins_rate=0.02, del_rate=0.02), levels).collect()}
    assert all(len(r.seq1) == len(r.qual1) == 40 for r in noisy.values())
    assert any(noisy[i].seq1 != simple[i].seq1 for i in simple)
    none = {r.idx: r for r in simulate(numbers, c, Settings(**base, simple=False, ins_rate=0.0, del_rate=0.0), levels).collect()}
    differ = sum(a != b for i in simple for a, b in zip(none[i].seq1, simple[i].seq1, strict=True)) / (300 * 40)
    assert 0.001 < differ < 0.2
    # The Arrow path and the expression give the same bases and qualities.
    one = spark.createDataFrame([(i, r.seq1) for i, r in simple.items()], "idx long, seq string").withColumn("l", levels.select("level1").scalar())
    for r in one.select("idx", reads.base_errors(F.col("seq"), F.col("l"), 4, "idx", F.lit(1)).alias("x")).collect():
        assert "".join(b.base for b in r.x) == none[r.idx].seq1 and [b.quality for b in r.x] == none[r.idx].qual1


@pytest.mark.parametrize("way", [0, 1])
def test_indel_draws_agree(spark, way):
    dele, ins, bases = reads.indel_draws(9, 30, [0.5, 0.3], [0.6, 0.3], way, "id", F.lit(2))
    for r in spark.range(400).select("id", dele.alias("d"), ins.alias("i"), bases.alias("b")).collect():
        got = reads.read_indels(9, 30, [0.5, 0.3], [0.6, 0.3], way, f"{r.id}:2")
        assert got == (r.d, r.i, "".join(r.b))
        assert len(set(r.d) | set(r.i)) == len(r.d) + len(r.i) and 0 not in r.d
        if way:
            assert len(r.d) <= len(r.i)


def test_settings():
    for bad in ({"method": "x"}, {"enzymes": []}, {"method": "dnase", "enzymes": ["DpnII"]}, {"enzymes": ["DpnII"], "bridge": "ACGT"}, {"enzymes": ["DpnII"], "insert_min": 50}):
        with pytest.raises(ContactError):
            Settings(**bad)
    assert Settings(enzymes=["DpnII"], efficiency=0.0).efficiency == 0.5


def test_no_sites(spark):
    seg = spark.createDataFrame([("a", "c", "r", 1.0, False)], "seg_id string, cell string, repl string, copy_number double, linear boolean")
    s = Settings(enzymes=["DpnII"])
    c = prepare(seg, spark.createDataFrame([("a", "A" * 300)], "seg_id string, seq string"), s)
    with pytest.raises(NoCutSites):
        draw_pairs(spark.range(3).withColumnRenamed("id", "idx"), c, s)


def test_command_line(spark, tmp_path):
    (tmp_path / "g.fa").write_text("".join(f">s{i}\n{dna(2000, i)}\n" for i in range(3)))
    out = str(tmp_path / "r.fq.gz")
    args = ["-e", "DpnII", "-n", "50", "-l", "30", "-r", "1", "--simple-reads", str(tmp_path / "g.fa"), out]
    assert cli.main(args, spark) == 0
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert len(lines) == 400 and sum(x.startswith("@SIM:") for x in lines) >= 100
    assert cli.main(["-m", "dnase", "-e", "DpnII", "-n", "5", "-l", "30", str(tmp_path / "g.fa"), out], spark) == 1


def test_stream_equals_batch(spark, tables, tmp_path):
    from contactforge.streaming.experiment import simulate_stream

    seg, seq, _ = tables
    s = Settings(enzymes=["DpnII"], seed=4, read_length=40, insert_mean=150, insert_sd=20)
    c = prepare(seg, seq, s)
    numbers = spark.range(1, 101).withColumnRenamed("id", "idx")
    numbers.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = simulate_stream(stream, c, s, lambda df, epoch: df.write.mode("append").parquet(str(tmp_path / "out")), checkpoint=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    columns = ["idx", "name1", "seq1", "name2", "seq2"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).orderBy("idx").collect()
    assert got == simulate(numbers, c, s).select(columns).orderBy("idx").collect() and len(got) == 100
