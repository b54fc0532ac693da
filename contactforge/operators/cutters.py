"""All enzymes in one scan: many recognition sites on both strands, with cuts inside or outside the site.

The scan itself is ``scan``; here are the enzymes, and what one pass over the tiles gives for all of them.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContactError
from .digest import TILE, tiles
from .enzymes import CUTS
from .scan import BASES, Pattern, occurrences

# Recognition sites of common enzymes that cut behind their site: bases after it on the upper / lower strand.
BEHIND = {
    "AcuI": "CTGAAG(16/14)", "AlwI": "GGATC(4/5)", "BbsI": "GAAGAC(2/6)", "BccI": "CCATC(4/5)", "BciVI": "GTATCC(6/5)", "BfuAI": "ACCTGC(4/8)", "BpmI": "CTGGAG(16/14)",
    "BsaI": "GGTCTC(1/5)", "BseRI": "GAGGAG(10/8)", "BsgI": "GTGCAG(16/14)", "BsmAI": "GTCTC(1/5)", "BsmBI": "CGTCTC(1/5)", "BsmFI": "GGGAC(10/14)", "BsrDI": "GCAATG(2/0)",
    "BtgZI": "GCGATG(10/14)", "BtsI": "GCAGTG(2/0)", "EarI": "CTCTTC(1/4)", "EciI": "GGCGGA(11/9)", "EcoP15I": "CAGCAG(25/27)", "FokI": "GGATG(9/13)", "HgaI": "GACGC(5/10)",
    "HphI": "GGTGA(8/7)", "MboII": "GAAGA(8/7)", "MlyI": "GAGTC(5/5)", "MmeI": "TCCRAC(20/18)", "NmeAIII": "GCCGAG(21/19)", "PleI": "GAGTC(4/5)", "SapI": "GCTCTTC(1/4)", "SfaNI": "GCATC(5/9)",
}
# Palindromes around a gap, with the cut of the upper strand marked.
GAPPED = {"BglI": "GCCNNNN^NGGC", "SfiI": "GGCCNNNN^NGGCC", "XmnI": "GAANN^NNTTC", "DraIII": "CACNNN^GTG", "BstXI": "CCANNNNN^NTGG", "XcmI": "CCANNNNN^NNNNTGG"}


def turned(site: str) -> str:
    """The site as it stands on the upper strand where the enzyme binds the lower one."""
    by_bits = {v: k for k, v in BASES.items()}
    flip = lambda b: (b & 1) << 3 | (b & 2) << 1 | (b & 4) >> 1 | (b & 8) >> 3
    return "".join(by_bits[flip(BASES[c])] for c in reversed(site))


def patterns(names: list[str]) -> list[Pattern]:
    """One or, for sites that aren't their own mirror image, two patterns of each named enzyme, numbered by the list."""
    out = []
    for i, name in enumerate(names):
        text = CUTS.get(name) or GAPPED.get(name) or BEHIND.get(name)
        if text is None:
            raise ContactError(f"unknown enzyme {name}")
        if behind := re.fullmatch(r"([A-Z]+)\((\d+)/(\d+)\)", text):
            site, upper, lower = behind[1], int(behind[2]), int(behind[3])
            out += [Pattern(i, site, len(site) + upper), Pattern(i, turned(site), -lower)]
        else:
            out.append(Pattern(i, text.replace("^", ""), text.index("^")))
    return out


def everything() -> list[str]:
    return sorted([*CUTS, *GAPPED, *BEHIND])


def all_sites(sequences: DataFrame | None, names: list[str], tile: int = TILE, cut: DataFrame | None = None) -> DataFrame:
    """(seg_id, pos, enz) from (seg_id, linear, seq), or from tiles ``cut`` of it that overlap by the longest site: the base
    after each cut of the upper strand, 0-based, by each enzyme of the list.

    On a linear sequence cuts before its first base or behind its last are none; on a circular one positions wrap and
    sites may span the origin. Sites of both strands that cut at one place are listed once.
    """
    found = patterns(names)
    longest = max(len(p.site) for p in found)
    # From the first base of one strand's site to the last one of the other's, where both cut at one place.
    reach = max((p.cut - q.cut for p, q in zip(found, found[1:], strict=False) if p.enz == q.enz), default=0)
    rows = occurrences(tiles(sequences, reach + longest - 1, tile) if cut is None else cut, found, tile)
    # A tile with that overlap sees both sites, so nothing has to be gathered.
    return rows.distinct() if reach and (cut is not None or reach + longest > tile) else rows


def cut_counts(sites: DataFrame, names: list[str]) -> DataFrame:
    """(enzyme, n) of every enzyme of the list that cuts."""
    listed = F.array(*map(F.lit, names))
    return sites.groupBy("enz").agg(F.count("*").alias("n")).select(F.element_at(listed, F.col("enz") + 1).alias("enzyme"), "n")
