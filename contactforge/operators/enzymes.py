"""Restriction enzymes, and the junctions that ligation of filled-in ends leaves."""
from __future__ import annotations

from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContactError

# Recognition sites of common palindromic enzymes with the cut of the upper strand marked.
CUTS = {
    "DpnII": "^GATC", "MboI": "^GATC", "Sau3AI": "^GATC", "FatI": "^CATG", "MluCI": "^AATT", "HindIII": "A^AGCTT", "EcoRI": "G^AATTC", "BamHI": "G^GATCC",
    "BglII": "A^GATCT", "BclI": "T^GATCA", "NcoI": "C^CATGG", "XbaI": "T^CTAGA", "XhoI": "C^TCGAG", "SalI": "G^TCGAC", "NheI": "G^CTAGC", "SpeI": "A^CTAGT",
    "AvrII": "C^CTAGG", "MfeI": "C^AATTG", "ApoI": "R^AATTY", "HinfI": "G^ANTC", "DdeI": "C^TNAG", "MseI": "T^TAA", "CviQI": "G^TAC", "HpyCH4IV": "A^CGT",
    "TaqI": "T^CGA", "HpaII": "C^CGG", "MspI": "C^CGG", "HinP1I": "G^CGC", "BfaI": "C^TAG", "MluI": "A^CGCGT", "BssHII": "G^CGCGC", "AscI": "GG^CGCGCC",
    "NotI": "GC^GGCCGC", "ClaI": "AT^CGAT", "NdeI": "CA^TATG", "AseI": "AT^TAAT", "NlaIII": "CATG^", "HhaI": "GCG^C", "PstI": "CTGCA^G", "NsiI": "ATGCA^T",
    "SphI": "GCATG^C", "KpnI": "GGTAC^C", "SacI": "GAGCT^C", "ApaI": "GGGCC^C", "AatII": "GACGT^C", "SacII": "CCGC^GG", "PvuI": "CGAT^CG", "SbfI": "CCTGCA^GG",
    "FseI": "GGCCGG^CC", "PacI": "TTAAT^TAA", "SmaI": "CCC^GGG", "EcoRV": "GAT^ATC", "ScaI": "AGT^ACT", "StuI": "AGG^CCT", "AluI": "AG^CT", "HaeIII": "GG^CC",
    "RsaI": "GT^AC", "DraI": "TTT^AAA", "PvuII": "CAG^CTG", "SspI": "AAT^ATT", "BstUI": "CG^CG", "HpyCH4V": "TG^CA",
}


@dataclass(frozen=True)
class Enzyme:
    """A palindromic cutter: its site and how many bases of it stand before the upper strand's cut."""

    name: str
    site: str
    cut: int

    @property
    def overhang(self) -> str:
        low, high = sorted((self.cut, len(self.site) - self.cut))
        return self.site[low:high]

    @property
    def ends(self) -> tuple[str, str]:
        """The parts of the site on either side of the overhang; empty if there is none, or nothing else."""
        kept = min(self.cut, len(self.site) - self.cut)
        if not self.overhang or not kept:
            return "", ""
        return self.site[:kept], self.site[-kept:]


def enzyme(name: str) -> Enzyme:
    if name not in CUTS:
        raise ContactError(f"unknown enzyme {name}")
    cut = CUTS[name]
    return Enzyme(name, cut.replace("^", ""), cut.index("^"))


def junction(a: Enzyme, b: Enzyme) -> str:
    """What joins a part cut by ``a`` to one cut by ``b`` after fill-in."""
    return a.ends[0] + a.overhang + b.overhang + b.ends[1]


def vestige(a: Enzyme, joined: str) -> str:
    """The longest beginning of the site that the junction still shows; N in the site fits anything."""
    return "".join(j for _, j in takewhile(lambda x: x[0] in ("N", x[1]), zip(a.site, joined, strict=False)))


def junction_rows(enzymes: list[Enzyme]) -> list[tuple]:
    rows = []
    for i, a in enumerate(enzymes):
        for j, b in enumerate(enzymes):
            joined = junction(a, b)
            left = vestige(a, joined)
            rows.append((i, j, a.name, b.name, joined, left, len(joined), len(left), joined.replace("N", "[ACGT]"), a == b))
    return rows


def junctions(spark: SparkSession, enzymes: list[Enzyme]) -> DataFrame:
    """All ordered pairs of one or two enzymes: 1 or 4 rows."""
    if not 1 <= len(enzymes) <= 2:
        raise ContactError("one or two enzymes are needed")
    return spark.createDataFrame(
        junction_rows(enzymes),
        "enz_a int, enz_b int, name_a string, name_b string, junction string, vestigial string, junc_len int, vest_len int, pattern string, same_enzyme boolean",
    )


def ligated(rows: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Adds to rows with two enzyme names what joins their ends: junction, vestigial, junc_len, vest_len, pattern and
    same_enzyme. The table of all pairs has a fixed size, the square of the catalogue's."""
    every = [enzyme(n) for n in CUTS]
    table = rows.sparkSession.createDataFrame([r[2:] for r in junction_rows(every)], "__a string, __b string, junction string, vestigial string, junc_len int, vest_len int, pattern string, same_enzyme boolean")
    return rows.join(F.broadcast(table), (F.col(name_a) == F.col("__a")) & (F.col(name_b) == F.col("__b"))).drop("__a", "__b")
