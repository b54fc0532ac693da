"""Read pairs from templates, with and without errors: Spark expressions, but for the draws of each base that
sequencing errors need, which are done on Arrow batches (the same as an expression is ``base_errors``)."""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import binomial_tails
from ..functions.draws import below, counted, counted_array, digest, nucleotide, part
from ..functions.sequence import apply_indels, reverse_complement

SIMPLE_QUALITY = 40



def join_parts(method: str, a: Column, b: Column, junction: Column | None = None, bridge: str | None = None) -> Column:
    """The template of a ligation product: site duplicated (hic), plain (meta3c), or bridged (dnase)."""
    if method == "hic":
        return F.concat(a, F.coalesce(junction, F.lit("")), b)
    if method == "dnase":
        return F.concat(a, F.lit(bridge or ""), b)
    return F.concat(a, b)


def forward_part(template: Column, size) -> Column:
    return F.substring(template, F.lit(1), size if isinstance(size, Column) else F.lit(size))


def reverse_part(template: Column, size) -> Column:
    """The first bases of the reverse complement; only the template's end is turned round."""
    size = size if isinstance(size, Column) else F.lit(size)
    n = F.length(template)
    return reverse_complement(F.substring(template, F.greatest(n - size, F.lit(0)) + 1, F.least(size, n)))


def simple_reads(pairs: DataFrame, read_length: int, template: str = "template") -> DataFrame:
    """Adds seq1, seq2 and quality arrays qual1, qual2: both ends of the template, without errors."""
    out = pairs.withColumn("seq1", forward_part(F.col(template), read_length)).withColumn("seq2", reverse_part(F.col(template), read_length))
    for r in (1, 2):
        out = out.withColumn(f"qual{r}", F.array_repeat(F.lit(SIMPLE_QUALITY), F.length(f"seq{r}")))
    return out


def _two_tails(rates: list[float], u2: Column, u1: Column) -> Column:
    """How many errors: two if its draw says so, else one if its own draw says so, else none."""
    n = F.lit(0)
    if rates:
        n = F.when(F.lit(rates[0]) >= u1, F.lit(1)).otherwise(n)
    if len(rates) > 1:
        n = F.when(F.lit(rates[1]) >= u2, F.lit(2)).otherwise(n)
    return n


def _choose(n: Column, us: list[Column], taken: Column, low: int, high: int) -> Column:
    """``n`` (0 to 2) distinct places in [low, high) that are not in the sorted array ``taken``, without redrawing: a
    place is drawn among the free ones and moved up past each taken one that is not above it."""
    def past(x, used):
        return F.aggregate(F.array_sort(used), x, lambda at, t: F.when(t <= at, at + 1).otherwise(at))

    span = F.lit(high - low)
    inside = F.filter(taken, lambda t: t >= low)
    first = past((below(us[0], span - F.size(inside)) + low).cast("int"), inside)
    both = F.concat(inside, F.array(first))
    second = past((below(us[1], span - F.size(both)) + low).cast("int"), both)
    none = F.array().cast("array<int>")
    return F.when(n >= 2, F.array(first, second)).when(n == 1, F.array(first)).otherwise(none)


def indel_draws(seed: int, read_length: int, ins_rates: list[float], del_rates: list[float], way: int, *keys) -> tuple[Column, Column, Column]:
    """(deleted, inserted, bases) of a read. ``way`` 0 draws deletions first; 1 insertions first, and never more
    deletions than insertions. Place 0 is never deleted."""
    tag = f"indel{way}"
    tails, places = digest(seed, f"{tag}t", *keys), digest(seed, f"{tag}p", *keys)
    bases = digest(seed, f"{tag}b", *keys)
    n_del = _two_tails(del_rates, part(tails, 0), part(tails, 1))
    n_ins = _two_tails(ins_rates, part(tails, 2), part(tails, 3))
    if read_length < 2:
        n_del = F.lit(0)
    n_ins = F.least(n_ins, F.lit(read_length) - n_del) if way == 0 else F.least(n_ins, F.lit(read_length))
    if way:
        n_del = F.least(n_del, n_ins, F.lit(read_length) - n_ins)
    none = F.array().cast("array<int>")
    if way == 0:
        deleted = _choose(n_del, [part(places, 0), part(places, 1)], none, 1, read_length)
        inserted = _choose(n_ins, [part(places, 2), part(places, 3)], deleted, 0, read_length)
    else:
        inserted = _choose(n_ins, [part(places, 2), part(places, 3)], none, 0, read_length)
        deleted = _choose(n_del, [part(places, 0), part(places, 1)], inserted, 1, read_length)
    return deleted, inserted, F.slice(F.array(nucleotide(part(bases, 0)), nucleotide(part(bases, 1))), F.lit(1), F.size(inserted))


def quality_at(cum: Column, qual: Column, draw: Column) -> Column:
    """The first quality whose cumulative count reaches the draw, a number from 1 to a million."""
    return F.element_at(qual, F.size(F.filter(cum, lambda c: c < draw)) + 1)


def substitute(base: Column, quality: Column, chance: Column, which: Column) -> Column:
    """The base read: N stays; another base is shown where the draw ``chance`` is below the quality's error chance."""
    wrong = F.substring(F.replace(F.lit("ACGT"), base, F.lit("")), (F.floor(which * 3) + 1).cast("int"), F.lit(1))
    known = base.isin("A", "C", "G", "T")
    return F.when(known & (chance < F.pow(F.lit(10.0), -quality / 10.0)), wrong).when(known, base).otherwise("N")


def base_errors(seq: Column, levels: Column, seed: int, *keys) -> Column:
    """Array of (base, quality) of a read: ``levels`` is the array over read positions of (cum, qual).

    One digest a read, three numbered draws a base, one step after the other: each step's results are bound before the
    next one uses them, so nothing is computed twice.
    """
    start = digest(seed, "base", *keys)
    symbols = F.filter(F.split(F.upper(seq), ""), lambda c: c != "")
    drawn = F.transform(symbols, lambda c, i: F.struct(c.alias("b"), i.alias("i"), F.element_at(levels, i + 1).alias("l"), (below(counted(start, i * 3), 1_000_000) + 1).alias("n")))
    scored = F.transform(drawn, lambda x: F.struct(x["b"].alias("b"), x["i"].alias("i"), quality_at(x["l"]["cum"], x["l"]["qual"], x["n"]).alias("q")))
    return F.transform(scored, lambda x: F.struct(substitute(x["b"], x["q"], counted(start, x["i"] * 3 + 1), counted(start, x["i"] * 3 + 2)).alias("base"), F.when(x["b"] == "N", F.lit(1)).otherwise(x["q"]).alias("quality")))


def batch_errors(levels: list, seed: int, read: int):
    """The same results as ``base_errors``, as a function of Arrow arrays (sequences, pair numbers) that gives (bases,
    qualities): a few array steps for each batch. ``levels`` is a list over read positions of (cum, qual), a size fixed
    by the read."""
    wide = max(len(x["cum"]) for x in levels)
    cum = np.array([list(x["cum"]) + [1 << 40] * (wide - len(x["cum"])) for x in levels])
    qual = np.array([list(x["qual"]) + [0] * (wide - len(x["qual"])) for x in levels])
    chance = np.power(10.0, -np.arange(128) / 10.0)
    code = np.full(256, 4, np.int64)
    for k, c in enumerate(b"ACGT"):
        code[c] = k
    letters = np.frombuffer(b"ACGTN", np.uint8)
    other = np.array([[x for x in range(4) if x != k] for k in range(4)] + [[4] * 3])

    def run(seq: pa.Array, idx: pa.Array) -> tuple[pa.Array, pa.Array]:
        texts = [(x or "").upper().encode() for x in seq.to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        start = b"".join(md5(b"%d:base:%d:%d" % (seed, i, read)).digest()[:8] for i in idx.to_pylist())
        keys = np.repeat(np.frombuffer(start, ">u4").astype(np.uint32).reshape(-1, 2), sizes, 0)
        at = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
        shown_as = np.frombuffer(b"".join(texts), np.uint8)
        base = code[shown_as]
        n_draw = np.floor(counted_array(keys, at * 3) * 1_000_000).astype(np.int64) + 1
        level = np.zeros(len(at), np.int64)
        for k in range(wide):
            level += cum[at, k] < n_draw
        quality = qual[at, level]
        wrong = np.flatnonzero((counted_array(keys, at * 3 + 1) < chance[quality]) & (base < 4))
        seen = base.copy()
        seen[wrong] = other[base[wrong], np.floor(counted_array(keys[wrong], at[wrong] * 3 + 2) * 3).astype(np.int64)]
        quality = np.where(shown_as == ord("N"), 1, quality).astype(np.int32)
        shown, offsets = letters[seen].tobytes(), np.concatenate([[0], ends]).astype(np.int32)
        bases = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(shown))
        return bases, pa.ListArray.from_arrays(pa.array(offsets), pa.array(quality))

    return run


def with_base_errors(rows: DataFrame, levels: list, seed: int, read: int, seq: str = "seq") -> DataFrame:
    """Adds base (string) and quality (array) of the read in column ``seq``, as ``base_errors`` gives them, batch by batch.
    Rows are keyed by idx; a null read is empty."""
    coder, names = batch_errors(levels, seed, read), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *coder(b.column(seq), b.column("idx"))], [*names, "base", "quality"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", base string, quality array<int>")


def read_indels(seed: int, read_length: int, ins_rates: list[float], del_rates: list[float], way: int, key: str) -> tuple[list[int], list[int], str]:
    """``indel_draws`` for one read in Python; nearly all reads stop at the first digest."""
    def parts(name):
        h = md5(f"{seed}:indel{way}{name}:{key}".encode()).digest()
        return [int.from_bytes(h[4 * k : 4 * k + 4], "big") / 4294967296.0 for k in range(4)]

    def two(rates, u2, u1):
        return 2 if len(rates) > 1 and rates[1] >= u2 else 1 if rates and rates[0] >= u1 else 0

    u = parts("t")
    n_del = two(del_rates, u[0], u[1]) if read_length >= 2 else 0
    n_ins = two(ins_rates, u[2], u[3])
    n_ins = min(n_ins, read_length - n_del if way == 0 else read_length)
    if way:
        n_del = min(n_del, n_ins, read_length - n_ins)
    if not n_del and not n_ins:
        return [], [], ""
    p = parts("p")

    def choose(n, us, taken, low):
        used = [t for t in taken if t >= low]
        out = []
        for k in range(n):
            at = int(us[k] * (read_length - low - len(used))) + low
            for t in sorted(used):
                at += t <= at
            used.append(at)
            out.append(at)
        return out

    if way == 0:
        deleted = choose(n_del, p[:2], [], 1)
        inserted = choose(n_ins, p[2:], deleted, 0)
    else:
        inserted = choose(n_ins, p[2:], [], 0)
        deleted = choose(n_del, p[:2], inserted, 1)
    return deleted, inserted, "".join("ACGT"[int(x * 4)] for x in parts("b")[:n_ins])


def with_indels(ref: str, deleted: list[int], inserted: list[int], bases: str) -> str:
    """``apply_indels`` for one read."""
    out, at, new = [], 0, dict(zip(inserted, bases, strict=True))
    for k in range(len(ref) + len(inserted)):
        if k in new:
            if at <= len(ref):
                out.append(new[k])
            continue
        if k not in deleted:
            out.append(ref[at : at + 1])
        at += 1
    return "".join(out)


def error_reads(pairs: DataFrame, levels: DataFrame, read_length: int, seed: int, ins_rate: float = 9e-5, del_rate: float = 1.1e-4, template: str = "template", documented: bool = False) -> DataFrame:
    """Adds seq1, seq2, qual1, qual2 with indels, qualities and substitutions; the template goes.

    ``levels``: one row, level1 and level2, the arrays over positions of (cum, qual) of both reads (their size is fixed
    by the read length). Rows are keyed by idx. Python sees the template's two ends only, not all of it.
    """
    ins, dels = binomial_tails(read_length, ins_rate, documented=documented), binomial_tails(read_length, del_rate, documented=documented)
    held = levels.first()  # read_length short arrays for each read
    most = read_length + len(dels)
    kept = [c for c in pairs.columns if c != template]
    coders = [batch_errors(held[f"level{r}"], seed, r) for r in (1, 2)]

    def cut(ends: pa.Array, idx: pa.Array, sizes: pa.Array, r: int) -> pa.Array:
        out = []
        for ref, i, n in zip(ends.to_pylist(), idx.to_pylist(), sizes.to_pylist(), strict=True):
            key = f"{i}:{r}"
            found = read_indels(seed, read_length, ins, dels, 0, key)
            # A read that would run over the template draws again the second way.
            if read_length - (len(found[1]) - len(found[0])) > n:
                found = read_indels(seed, read_length, ins, dels, 1, key)
            ref = ref[: max(read_length - len(found[1]) + len(found[0]), 0)]
            out.append(with_indels(ref, *found)[:read_length] if found[0] or found[1] else ref)
        return pa.array(out, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            idx = b.column("idx")
            got = [coders[r - 1](cut(b.column(f"__end{r}"), idx, b.column("__n"), r), idx) for r in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), got[0][0], got[1][0], got[0][1], got[1][1]], [*kept, "seq1", "seq2", "qual1", "qual2"])

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", seq1 string, seq2 string, qual1 array<int>, qual2 array<int>"
    whole = F.col(template)
    return pairs.select(*kept, forward_part(whole, most).alias("__end1"), reverse_part(whole, most).alias("__end2"), F.length(whole).alias("__n")).mapInArrow(run, schema)


def named(pairs: DataFrame, prefix: str) -> DataFrame:
    """Adds name1 and name2 of the records."""
    out = pairs
    for r in (1, 2):
        out = out.withColumn(f"name{r}", F.format_string(f"{prefix}:%s:1:1:1:%d {r}:Y:18:1 %s", "mode", "idx", "desc"))
    return out


def read_id(ref: Column, n: Column) -> Column:
    return F.concat_ws("-", ref, n.cast("string"))


def part_description(reverse: Column, start: Column, size: Column, length: Column, linear: Column) -> Column:
    """``strand:start:end`` of a part, counted from 1; a circular part that wraps ends where it stops again."""
    at = F.when(start < 0, F.when(linear, F.lit(0)).otherwise(F.pmod(start, length))).otherwise(start)
    stop = at + size
    end = F.when(stop <= length, stop).when(linear, length).otherwise(stop - length)
    return F.format_string("%d:%d:%d", reverse.cast("int"), at + 1, end)


def summary(pairs: DataFrame) -> DataFrame:
    """One row: WGS and ligation pairs, inserts raised to the minimum and cut to the maximum."""
    return pairs.agg(
        F.count_if(F.col("mode") == "WGS").alias("wgs_count"), F.count_if(F.col("mode") == "3C").alias("lig_count"),
        F.count_if("too_short").alias("too_short"), F.count_if("too_long").alias("too_long"),
    )


__all__ = ["base_errors", "error_reads", "indel_draws", "join_parts", "named", "part_description", "read_id", "simple_reads", "summary"]
