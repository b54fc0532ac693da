"""Runs that are killed and continued."""
import gzip
import random

import pytest
from pyspark.sql import functions as F

from contactforge import cli
from contactforge.errors import ContactError
from contactforge.sinks import restart


def pairs(numbers):
    """Made-up pairs: names and reads by number."""
    text = lambda p: F.concat(F.lit(p), F.col("idx").cast("string"))
    cols = {"mode": F.when(F.col("idx") % 3 == 0, "3C").otherwise("WGS"), "too_short": F.col("idx") % 7 == 0, "too_long": F.lit(False)}
    for r in (1, 2):
        cols |= {f"name{r}": text(f"n{r}:"), f"seq{r}": text("ACGT"), f"qual{r}": F.array(F.lit(40))}
    return numbers.withColumns(cols)


def test_a_killed_run_goes_on(spark, tmp_path):
    made = []

    def make(numbers, stop=10**9):
        first = numbers.agg(F.min("idx")).first()[0]
        if first >= stop:
            raise KeyboardInterrupt
        made.append(first)
        return pairs(numbers)

    out = lambda name: [f"{tmp_path}/{name}1.fq.gz", f"{tmp_path}/{name}2.fq.gz"]
    whole = restart.write_ranges(spark, make, 1000, *out("a"), f"{tmp_path}/run-a", {"seed": 1}, 4)
    assert made == [1, 251, 501, 751] and whole["wgs_count"] == 667 and whole["lig_count"] == 333
    made.clear()
    with pytest.raises(KeyboardInterrupt):
        restart.write_ranges(spark, lambda x: make(x, 500), 1000, *out("b"), f"{tmp_path}/run-b", {"seed": 1}, 4)
    (tmp_path / "run-b/pending-left").mkdir()  # what a lost writer leaves
    with pytest.raises(ContactError, match="another run"):
        restart.write_ranges(spark, make, 1000, *out("b"), f"{tmp_path}/run-b", {"seed": 2}, 4)
    again = restart.write_ranges(spark, make, 1000, *out("b"), f"{tmp_path}/run-b", {"seed": 1}, 4)
    assert made == [1, 251, 501, 751] and again == whole and not (tmp_path / "run-b").exists()
    for a, b in zip(out("a"), out("b"), strict=True):
        with gzip.open(a) as x, gzip.open(b) as y:
            text = x.read()
            assert text == y.read() and text.count(b"\n") == 4000


def test_command_with_ranges_gives_the_same_file(spark, tmp_path, capsys):
    r = random.Random(1)
    (tmp_path / "g.fa").write_text("".join(f">s{i}\n{''.join(r.choice('ACGT') for _ in range(3000))}\n" for i in range(2)))
    args = ["-e", "DpnII", "-n", "50", "-l", "30", "-r", "3", "--simple-reads"]
    assert cli.main([*args, str(tmp_path / "g.fa"), str(tmp_path / "a.fq")], spark) == 0
    one = capsys.readouterr().out
    assert cli.main([*args, "--restart", str(tmp_path / "run"), "--ranges", "2", str(tmp_path / "g.fa"), str(tmp_path / "b.fq")], spark) == 0
    assert capsys.readouterr().out == one
    assert (tmp_path / "a.fq").read_text() == (tmp_path / "b.fq").read_text()
    assert cli.main([*args, "--restart", "x", "--folders", str(tmp_path / "g.fa"), str(tmp_path / "b.fq")], spark) == 1
