"""Column functions, enzymes and profiles on hand-made rows."""
import pytest
from pyspark.sql import functions as F

from contactforge.errors import ContactError, SequenceError
from contactforge.functions import distributions, draws
from contactforge.functions import sequence as sq
from contactforge.operators.enzymes import CUTS, enzyme, junction, junctions, vestige
from contactforge.sinks.records import output_kind, write_toml
from contactforge.sources import fasta, profile, quality


def one(spark, col, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(col.alias("x")).first()[0]


def test_reverse_complement(spark):
    assert one(spark, sq.reverse_complement(F.lit("ACGTNRacgu"))) == "ACGTNNACGT"
    assert one(spark, sq.reverse_complement(sq.reverse_complement(F.lit("ACGTTGN")))) == "ACGTTGN"


def test_ambiguous_and_illegal(spark):
    assert one(spark, sq.ambiguous_to_n(F.lit("ACGTRyNn"))) == "ACGTNnNn"
    assert one(spark, sq.has_illegal(F.lit("ACGTN"))) is False and one(spark, sq.has_illegal(F.lit("ACR"))) is True


@pytest.mark.parametrize(("name", "expected"), [("DpnII", "GATCGATC"), ("HindIII", "AAGCTAGCTT"), ("HinfI", "GANTANTC"), ("NlaIII", "CATGCATG"), ("PstI", "CTGCATGCAG"), ("SmaI", "")])
def test_junctions(name, expected):
    assert junction(enzyme(name), enzyme(name)) == expected


def test_vestige_and_pairs(spark):
    assert vestige(enzyme("HindIII"), "AAGCTAGCTT") == "AAGCT"
    assert vestige(enzyme("SmaI"), "") == ""
    rows = junctions(spark, [enzyme("DpnII"), enzyme("HinfI")]).collect()
    assert [(r.enz_a, r.enz_b, r.junction) for r in rows] == [(0, 0, "GATCGATC"), (0, 1, "GATCANTC"), (1, 0, "GANTGATC"), (1, 1, "GANTANTC")]
    with pytest.raises(ContactError):
        enzyme("None")


def test_sites_are_palindromes():
    turn = str.maketrans("ACGTNRY", "TGCANYR")
    for name in CUTS:
        site = enzyme(name).site
        assert site.translate(turn)[::-1] == site, name


def test_slices(spark):
    seq = F.lit("ABCDEFGHIJ")
    assert one(spark, sq.slice_circular(seq, F.lit(-2), F.lit(5))) == "IJABC"
    assert one(spark, sq.slice_circular(seq, F.lit(8), F.lit(30))) == "IJABCDEFGHIJ"
    assert one(spark, sq.slice_linear(seq, F.lit(-2), F.lit(5))) == "ABCDE"
    assert one(spark, sq.slice_linear(seq, F.lit(7), F.lit(5))) == "HI"
    assert one(spark, sq.slice_linear(seq, F.lit(7), F.lit(5), documented=True)) == "HIJ"


def test_indels(spark):
    def apply(ref, d, i, b):
        array = lambda v, t: F.array(*map(F.lit, v)).cast(f"array<{t}>")
        return one(spark, sq.apply_indels(F.lit(ref), array(d, "int"), array(i, "int"), array(b, "string")))

    assert apply("ACGTAC", [], [], []) == "ACGTAC"
    assert apply("ACGTAC", [2], [], []) == "ACTAC"
    assert apply("ACGTAC", [], [0, 3], ["T", "G"]) == "TACGGTAC"


def test_draws(spark):
    u = [r[0] for r in spark.range(2000).select(draws.unit(3, "x", "id")).collect()]
    assert 0 <= min(u) and max(u) < 1 and 0.45 < sum(u) / len(u) < 0.55
    again = [r[0] for r in spark.range(2000).repartition(7).select("id", draws.unit(3, "x", "id").alias("u")).orderBy("id").select("u").collect()]
    assert u == again
    assert {r[0] for r in spark.range(200).select(draws.other_nucleotide(draws.unit(1, "o", "id"), F.lit("C"))).collect()} == set("AGT")


def test_inverse_is_inverse(spark):
    row = spark.range(1).select(F.lit(4_000_000).alias("n"), F.lit(0.37).alias("u"))
    x = distributions.inverse(F.col("u"), F.col("n"))
    top = distributions.geometric_uniform(F.col("n").cast("double"), F.col("n"))
    got = row.select((distributions.geometric_uniform(x, F.col("n")) / top).alias("y")).first()[0]
    assert abs(got - 0.37) < 1e-5


def test_tails():
    one_, two = distributions.binomial_tails(150, 9e-5)
    assert abs(one_ - 8.97e-5) < 1e-6 and abs(two - 3.98e-7) < 1e-8
    assert distributions.binomial_tails(150, 9e-5, documented=True)[0] > 0.013


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACGT\nacgr\n>s2\nGGG\n")
    got = {r.seg_id: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), convert=True).collect()}
    assert got == {"s1": "ACGTACGN", "s2": "GGG"}
    with pytest.raises(Exception, match="illegal symbols"):
        fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    with pytest.raises(SequenceError):
        fasta.check_unique(spark.createDataFrame([("a",), ("a",)], "seg_id string"))


def test_profiles(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# c\n\ns1\tc1\tr1\t3\t2\ns2\tc1\tr1\t9\t5\ns3\tc2\tr1\t1\t1\n")
    got = {r.seg_id: (r.cell, r.abundance, r.copy_number) for r in profile.read_table(spark, str(tmp_path / "p.tsv"), True).collect()}
    assert got == {"s1": ("c1", 0.75, 2.0), "s2": ("c1", 0.75, 2.0), "s3": ("c2", 0.25, 1.0)}
    write_toml(profile.read_table(spark, str(tmp_path / "p.tsv")), str(tmp_path / "p.toml"), 0.05)
    df, rate = profile.read_toml(spark, (tmp_path / "p.toml").read_text())
    assert rate == 0.05 and sorted((r.seg_id, r.abundance, r.copy_number) for r in df.collect()) == [("s1", 3.0, 2.0), ("s2", 3.0, 2.0), ("s3", 1.0, 1.0)]
    with pytest.raises(ContactError):
        profile.read_toml(spark, "x = ")


def test_quality_profile(spark):
    lines = [".\t0\t2\t30", ".\t0\t10\t40", "A\t0\t2\t30", "A\t0\t1\t2", ".\t1\t5", ".\t1\t7", "", ".\t2\t5", ".\t2\t7"]
    got = quality.parse_lines(spark.createDataFrame(list(enumerate(lines)), "n int, value string")).orderBy("pos").collect()
    assert [(r.pos, r.cum, r.qual) for r in got] == [(0, [250000, 1000000], [2, 30]), (1, [1000000], [5])]


def test_suffixes():
    assert output_kind("a.fq.gz", "b.fq.gz") == ("fastq", "gzip") and output_kind("a.fa") == ("fasta", "none")
    for bad in (("a.txt", None), ("a.fq", "b.fq.gz")):
        with pytest.raises(ContactError):
            output_kind(*bad)
