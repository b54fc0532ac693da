"""Functions of nucleotide sequences held as ASCII strings."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each symbol and its complement; other IUPAC symbols become N, upper and lower case.
SYMBOLS = "acgtumrwsykvhdbnACGTUMRWSYKVHDBN"
COMPLEMENTS = "TGCAAnnnnnnnnnnnTGCAANNNNNNNNNNN"
# The IUPAC symbols that stand for several bases.
AMBIGUOUS = "mrwsykvhdbMRWSYKVHDB"
IUPAC = {"R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, SYMBOLS, COMPLEMENTS))


def ambiguous_to_n(seq: Column) -> Column:
    return F.translate(seq, AMBIGUOUS, "".join("n" if c.islower() else "N" for c in AMBIGUOUS))


def has_illegal(seq: Column) -> Column:
    """Whether there is a symbol besides ACGTN in either case."""
    return seq.rlike("[^ACGTNacgtn]")


def checked(seq: Column, name: Column) -> Column:
    """The sequence, or an error that names it where it holds an illegal symbol."""
    return F.when(has_illegal(seq), F.raise_error(F.concat(F.lit("illegal symbols in sequence "), name))).otherwise(seq)


def site_pattern(site: str) -> str:
    """A recognition site as a regular expression over upper-case ACGT."""
    return "".join(IUPAC.get(c, c) for c in site.upper())


def slice_circular(seq: Column, start: Column, size: Column) -> Column:
    """Part of a circular sequence: a negative start counts from the end; it wraps once, so it ends where the
    sequence has been read to its end again."""
    n = F.length(seq)
    at = F.when(start < 0, F.pmod(start, n)).otherwise(start)
    return F.substring(F.concat(seq, seq), at.cast("int") + 1, size.cast("int"))


def slice_linear(seq: Column, start: Column, size: Column, documented: bool = False) -> Column:
    """Part of a linear sequence: a negative start is zero with the size unchanged; a part that runs over the end
    stops one base before the last (``documented``: at the last)."""
    n = F.length(seq)
    at = F.greatest(start, F.lit(0))
    take = F.when(at + size > n, F.greatest(n - at - (0 if documented else 1), F.lit(0))).otherwise(size)
    return F.substring(seq, at.cast("int") + 1, take.cast("int"))


def phred(qualities: Column) -> Column:
    """Array of qualities to their text, offset 33; nulls in it have none. One quality throughout is a symbol repeated, which
    is faster than a text from single symbols."""
    low = F.array_min(qualities)
    # Whether an array holds what it can't hold is unknown if it has nulls.
    same = (low == F.array_max(qualities)) & ~F.array_contains(qualities, low - 1)
    single = F.array_join(F.transform(qualities, lambda q: F.char(q + 33)), "")
    return F.when(same, F.repeat(F.char(low + 33), F.size(qualities))).otherwise(single)


def apply_indels(ref: Column, deleted: Column, inserted: Column, bases: Column) -> Column:
    """A read from its reference part: read positions in ``deleted`` (array of int) skip a reference base, those in
    ``inserted`` show the matching one of ``bases``."""
    n_before = lambda k: F.size(F.filter(inserted, lambda p: p < k))
    steps = F.sequence(F.lit(0), F.length(ref) + F.size(inserted) - 1)

    def step(k):
        own = F.element_at(bases, F.array_position(inserted, k).cast("int"))
        at = k - n_before(k)
        base = F.when(F.array_contains(deleted, k), F.lit("")).otherwise(F.substring(ref, at + 1, F.lit(1)))
        return F.when(F.array_contains(inserted, k), F.when(at <= F.length(ref), own).otherwise("")).otherwise(base)

    return F.when((F.size(deleted) == 0) & (F.size(inserted) == 0), ref).when(F.length(ref) + F.size(inserted) == 0, F.lit("")).otherwise(F.array_join(F.transform(steps, step), ""))
