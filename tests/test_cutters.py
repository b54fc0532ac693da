"""All enzymes in one scan against a plain search of every site at every place."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactforge.errors import ContactError
from contactforge.operators import cutters, digest, scan
from contactforge.operators.enzymes import enzyme

PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
MEANS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def plain(seq, linear, names):
    out = set()
    for i, name in enumerate(names):
        text = {**cutters.CUTS, **cutters.GAPPED, **cutters.BEHIND}[name]
        if "^" in text:
            kinds = [(text.replace("^", ""), text.index("^"), False)]
        else:
            site, (up, down) = text.split("(")[0], map(int, text.split("(")[1][:-1].split("/"))
            kinds = [(site, len(site) + up, False), (site, -down, True)]
        for site, cut, reverse in kinds:
            n = len(seq)
            wide = seq if linear else seq + seq[: len(site) - 1]
            for p in range(len(wide) - len(site) + 1 if linear else n):
                window = wide[p : p + len(site)]
                if len(window) < len(site):
                    continue
                if reverse:
                    window = "".join(PAIR.get(c, c) for c in reversed(window))
                if all(c in MEANS[s] for c, s in zip(window, site, strict=True)):
                    at = p + cut
                    if not linear:
                        out.add((at % n, i))
                    elif 0 <= at < n:
                        out.add((at, i))
    return out


def test_every_enzyme_equals_a_plain_search(spark):
    r = random.Random(2)
    seqs = [("".join(r.choice("ACGT" if k else "ACGTN") for _ in range(n)), k % 2 == 0) for k, n in enumerate((3000, 2500, 40, 12, 7, 1))]
    # Long sites are rare: each is put somewhere, on either strand and across cuts of tiles and the origin.
    planted = "".join(r.choice("ACGT") for _ in range(55)) + "".join("".join(r.choice(MEANS[c]) for c in x.replace("^", "").split("(")[0]) + "".join(r.choice("ACGT") for _ in range(r.randrange(9))) for x in [*cutters.GAPPED.values(), *cutters.BEHIND.values(), *cutters.CUTS.values()])
    seqs += [(planted, True), (planted[17:] + planted[:17], False), ("".join(PAIR[c] for c in reversed(planted)), False)]
    names = cutters.everything()
    df = spark.createDataFrame([(f"s{i}", s, linear) for i, (s, linear) in enumerate(seqs)], "seg_id string, seq string, linear boolean")
    got = {}
    for row in cutters.all_sites(df, names, tile=64).collect():
        got.setdefault(row.seg_id, []).append((row.pos, row.enz))
    for i, (s, linear) in enumerate(seqs):
        found = got.get(f"s{i}", [])
        assert len(found) == len(set(found)) and set(found) == plain(s, linear, names), i
    assert {names[e] for x in got.values() for _, e in x} == set(names)


def test_two_enzymes_equal_the_digest(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(f"s{i}", "".join(r.choice("ACGT") for _ in range(6000)), bool(i)) for i in range(2)], "seg_id string, seq string, linear boolean")
    names = ["DpnII", "ApoI"]
    want = {tuple(x) for x in digest.cut_sites(df, [enzyme(n) for n in names]).select("seg_id", "pos", "enz").collect()}
    assert {tuple(x) for x in cutters.all_sites(df, names).collect()} == want
    counts = {x.enzyme: x.n for x in cutters.cut_counts(cutters.all_sites(df, names), names).collect()}
    assert counts == {n: sum(e == i for *_, e in want) for i, n in enumerate(names)}


def test_mirror_images():
    assert cutters.turned("GGTCTC") == "GAGACC" and cutters.turned("TCCRAC") == "GTYGGA"
    # A site that is its own mirror image has one pattern, and its table says so.
    assert all(cutters.turned(p.site) == p.site for p in cutters.patterns([*cutters.CUTS, *cutters.GAPPED]))
    with pytest.raises(ContactError, match="unknown"):
        cutters.patterns(["NoSuchI"])


def test_cost_does_not_grow_with_enzymes():
    """One table a window length, however many sites are looked for."""
    many = scan.Scanner(cutters.patterns(cutters.everything()))
    assert len(many.tables) <= 5 and sum(map(len, many.tables.values())) <= sum(4**n for n in range(1, 9))
    at, who = many.find(np.array([4, 4, 4], np.uint8))
    assert len(at) == len(who) == 0 and many.find(np.zeros(0, np.uint8))[0].size == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "seg_id string, seq string, linear boolean")
    assert cutters.all_sites(empty, ["BsaI"]).count() == 0 and cutters.all_sites(empty.withColumn("x", F.lit(1)), ["DpnII"]).count() == 0
