"""Near copies by word shingles: Jaccard similarity of the distinct five-word shingles, 0.8 or more.

Nodes are distinct texts, named by their MD5. Candidates come from two sides. Operator 6's SimHash fingerprints are searched by
its vantage-point trees: of equal fingerprints, and of those at most two bits apart, a spanning forest of pairs. Further
candidates meet in buckets: 40 bands of 7 MinHash values each, so a pair
at similarity 0.8 misses every bucket with a chance of 1 in 12,000, a closer pair more rarely still. Every link is then
counted exactly on the shingle sets (as 64-bit XXH64 values).

SimHash fingerprints and vantage-point trees can't find all of these pairs: at similarity 0.8 fingerprints lie some 10 of 64
bits apart (6 to 16), unlike texts 32 (20 to 44), and a tree that must send on everything within 16 bits of a
radius sends nearly all fingerprints to both sides. So the trees keep operator 6's radius of 2, and the buckets add what
lies beyond it.

Large groups of near copies would give pairs by the square. So first only neighbours in each bucket are compared, twice
in different orders, which joins such groups in steps that grow with their size. Buckets that still hold several
components are then searched for pairs of different ones whose 280 MinHash bits agree in 222 places at least (at
similarity 0.8 the mean is 252, and 222 is six standard deviations below). Where one of the two components is large, the
text of the smaller one is sent to the large one's texts, a part of them at a time, and compared there, so that its pairs
never become rows; other pairs are counted one by one.

No bucket is one task's: rows are dealt out by ranges of (bucket, text), neighbours across a cut are linked as well, and
the search for pairs goes by blocks of a bucket. The texts of a bucket's largest component meet the blocks of the others
only, so a group of any size with few outliers is sent once for each block of outliers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, map_arrow, released, shuffle_partitions, slices, stash
from .neardup import components, fingerprint, links, shingle_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 7
AGREE = 222
#: Rows of a bucket that are compared with each other in one piece.
BLOCK = 4096
#: Texts of a component above which it is large, and bytes of shingles that one part of it holds.
LARGE = 64
PART_BYTES = 16 << 20
_rng = np.random.default_rng(17)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, a wordless one has none. Texts are read in blocks."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, shingle_hashes(data, shingle))]))


def sketch(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bucket of each band and the lowest bit of each MinHash value."""
    h = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        x = h[i : i + 512] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    bucket = (low.astype(np.uint64).reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + _BAND
    bucket ^= bucket >> np.uint64(29)
    # The lowest bit of a linear hash follows the input's; a higher one is mixed.
    return bucket, np.packbits(((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def node(text_col: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for whole in batches:
            for b in slices(whole, 1):
                made = [sketch(shingle_set(x, shingle)) for x in as_bytes(b.column(1))]
                bands = [x.view(np.int64) for x, _ in made]
                fp = np.array([fingerprint(x) for x in as_bytes(b.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array([x for _, x in made], pa.binary()), pa.array(fp)], ["node", "bands", "bits", "fp"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x, shingle).tobytes() for x in as_bytes(b.column(1))], pa.binary())], ["node", "own"])

    return run


def _count(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in sets]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs(large: int):
    """From rows sorted by cell and root (bucket, i, j, own, node, bits, root, size of the root): pairs of different roots
    whose bits agree enough, as (a, b) of two nodes, or (a, root) of a node and a component of more than ``large`` texts. A
    cell compares block i of a bucket with block j; ``own`` is the row's block."""

    def close(i, j, held):
        own, nodes, bits, names, size = (np.concatenate([np.asarray(x[k], dtype=object) for x in held]) for k in range(5))
        bits, size = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), size.astype(np.int64)
        # Rows come in order of their root: within one block, pieces of one root are passed over.
        roots = np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]).astype(np.int64))
        mine = own.astype(np.int64) == i
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        within = i == j
        right = left if within else right
        two, one = set(), set()
        for x in range(0, len(left), 256):
            a = left[x : x + 256]
            first = x
            if within and roots[a[0]] == roots[a[-1]]:
                first = int(np.searchsorted(roots[left], roots[a[0]], "right"))
            for y in range(first, len(right), 1024):
                b = right[y : y + 1024]
                apart = np.bitwise_count(bits[a, None] ^ bits[None, b]).sum(2, dtype=np.int32)
                differ = roots[a, None] < roots[None, b] if within else roots[a, None] != roots[None, b]
                one_of, other_of = np.nonzero((apart <= BANDS * ROWS - AGREE) & differ)
                n, m = a[one_of], b[other_of]
                small = np.where((size[n] < size[m]) | ((size[n] == size[m]) & (roots[n] < roots[m])), n, m)
                other = n + m - small
                big = size[other] > large
                one.update(zip(nodes[small[big]], names[other[big]], strict=True))
                p, q = nodes[n[~big]], nodes[m[~big]]
                two.update(zip(np.where(p > q, q, p), np.where(p > q, p, q), strict=True))
                if len(two) + len(one) > 100_000:
                    yield out(two, one)
                    two, one = set(), set()
        if two or one:
            yield out(two, one)

    def out(two, one):
        a = [x for x, _ in two] + [x for x, _ in one]
        b, root = [y for _, y in two] + [None] * len(one), [None] * len(two) + [y for _, y in one]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b, root)], ["a", "b", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            columns = [batch.column(k).to_pylist() for k in range(3, 8)]
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if cell != (now := tuple(keys[:, i].tolist())) and held:
                    yield from close(*cell[1:], held)
                    held = []
                cell = now
                held.append([c[i:j] for c in columns])
        if held:
            yield from close(*cell[1:], held)

    return run


def blocked(rows: DataFrame) -> DataFrame:
    """Cells (bucket, i, j) of blocks to compare, for rows (bucket, node, bits, root, size) of buckets that hold several
    roots. The rows of a bucket's most frequent root have blocks of their own, which meet those of the others only."""
    of_root = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    of_bucket = of_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("bulk"), F.max("n").alias("n_bulk"), F.sum("n").alias("n"))
    of_bucket = of_bucket.select("bucket", "bulk", F.ceil(F.col("n_bulk") / BLOCK).alias("k_bulk"), F.ceil((F.col("n") - F.col("n_bulk")) / BLOCK).alias("k"))
    spread = F.xxhash64("node")
    own = F.when(F.col("root") == F.col("bulk"), F.col("k") + F.pmod(spread, F.col("k_bulk"))).otherwise(F.pmod(spread, F.col("k")))
    others = F.when(F.col("root") == F.col("bulk"), F.col("k")).otherwise(F.col("k") + F.col("k_bulk"))
    met = rows.join(of_bucket.hint("merge"), "bucket").withColumn("own", own.cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "bits", "root", "size")


def _against_part(least: float):
    """From rows sorted by (root, part, guest) with node and own set: one link of each guest to a text of the part that it
    is similar to, if there is one. A part is bounded in bytes; guests pass by one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, index = None, [], [], None
        for batch in batches:
            a, b = [], []
            for root, part, guest, node_, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (root, part):
                    key, nodes, sets, index = (root, part), [], [], None
                own = np.frombuffer(own, np.uint64)
                if not guest:
                    nodes.append(node_)
                    sets.append(own)
                    continue
                if not nodes:
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets])
                    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], who[order], sizes
                flat, who, sizes = index
                low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = high - low
                hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(who[hit], minlength=len(sizes))
                found = np.flatnonzero(common >= least * (sizes + len(own) - common))
                if len(found):
                    a.append(node_)
                    b.append(nodes[found[0]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a range of rows sorted by bucket: each node (b) with the one before it in its bucket (a). The first and the last
    row of the range are given besides, with their bucket and the number of the range."""
    part = TaskContext.get().partitionId()
    first = last = None
    for batch in batches:
        a, b = [], []
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last is None:
                first = row
            elif row[0] == last[0]:
                a.append(last[1])
                b.append(row[1])
            last = row
        yield _linked(a, b, [None] * len(a), [None] * len(a))
    if last is not None:
        yield _linked([None, last[1]], [first[1], None], [first[0], last[0]], [part, part])


def _linked(a: list, b: list, bucket: list, part: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(bucket, pa.int64()), pa.array(part, pa.int32())], ["a", "b", "bucket", "part"])


def neighbours(rows: DataFrame, *order: str) -> DataFrame:
    """(a, b), a < b, of all rows (bucket, node, ...) that are neighbours in their bucket, in the order of ``order``."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "bucket", *order).sortWithinPartitions("bucket", *order).select("bucket", "node")
    found = stash(map_arrow(ranged, _neighbours, "a binary, b binary, bucket long, part int"))
    ends = found.where("part IS NOT NULL").collect()  # two rows for each range
    before = {r.part: r for r in ends if r.b is None}
    after = {r.part: r for r in ends if r.a is None}
    parts = sorted(before)
    across = [(before[p].a, after[q].b) for p, q in zip(parts, parts[1:], strict=False) if before[p].bucket == after[q].bucket]
    both = found.where("part IS NULL").select("a", "b").unionByName(spark.createDataFrame(across, "a binary, b binary"))
    out = stash(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(found)
    return out


def by_fingerprints(made: DataFrame) -> DataFrame:
    """(a, b), a < b, of nodes (node, fp) whose SimHash fingerprints are equal or, by the vantage-point trees of operator 6, at
    most its limit apart: each node with the least one of its fingerprint, and these by a spanning forest of the links."""
    first = stash(made.groupBy("fp").agg(F.min("node").alias("first")))
    found = links(first, first.count())
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")).hint("merge") for c in ("a", "b"))
    across = found.join(one, "a").join(two, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    within = made.select("node", "fp").join(first.hint("merge"), "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    out = stash(across.unionByName(within).distinct())
    discard(first)
    return out


def roots(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, text_col: str = "text") -> DataFrame:
    """(node, root) of every distinct text that has a near copy: root is the smallest node it is linked with, directly or not."""
    if not 0.8 <= similar <= 1:
        raise ValueError("bands are made for similarities of 0.8 or more")
    parts = shuffle_partitions(docs.sparkSession)
    texts = docs.select(node(text_col).alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = stash(map_arrow(texts, _sketches(shingle), "node binary, bands array<long>, bits binary, fp long").dropDuplicates(["node"]))
    bands = made.select(F.explode("bands").alias("bucket"), "node")
    beside, by_trees = neighbours(bands, "node"), by_fingerprints(made)
    near = stash(beside.unionByName(by_trees).distinct())
    for used in (beside, by_trees):
        discard(used)
    meet = stash(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct())
    # Joins by merge at every size: the plan doesn't change as the input grows.
    wanted = texts.join(meet.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    sets = stash(map_arrow(wanted, _sets(shingle), "node binary, own binary"))

    def counted(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")).hint("merge")
        two = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")).hint("merge")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b")
        return stash(map_arrow(both, _count(similar), "a binary, b binary"))

    def joined(edges: DataFrame, so_far: DataFrame | None = None) -> DataFrame:
        if so_far is not None:
            edges = edges.unionByName(so_far.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return stash(components(edges))

    linked = counted(near)
    first = joined(linked)
    bits = stash(made.join(meet.hint("merge"), "node", "left_semi"))

    def mixed(now: DataFrame) -> DataFrame:
        """Rows of the buckets that hold several components."""
        rows = bits.join(now.hint("merge"), "node", "left")
        rows = rows.select(F.explode("bands").alias("bucket"), "node", "bits", F.coalesce("root", "node").alias("root"))
        several = rows.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("bucket")
        return stash(rows.join(several.hint("merge"), "bucket", "left_semi"))

    rows = mixed(first)
    turned = neighbours(rows.select("bucket", "node", F.xxhash64("bucket", "node").alias("at")), "at", "node")
    again = stash(turned.join(near.hint("merge"), ["a", "b"], "left_anti"))
    linked_again = counted(again)
    second = joined(linked_again, first)
    rows_again = mixed(second)
    sizes = second.select("root").groupBy("root").agg((F.count("*") + 1).alias("size"))
    sized = rows_again.join(sizes.hint("merge"), "root", "left").select("bucket", "node", "bits", "root", F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    cells = blocked(sized).repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "root")
    rest = stash(map_arrow(cells, _pairs(LARGE), "a binary, b binary, root binary").distinct())
    tested = near.unionByName(again)
    one_by_one = counted(rest.where("b IS NOT NULL").select("a", "b").join(tested.hint("merge"), ["a", "b"], "left_anti"))
    # Large components, in parts.
    sent = rest.where("b IS NULL").select("root", "a")
    wanted_roots = sent.select("root").distinct()
    members = second.select("node", "root").unionByName(second.select(F.col("root").alias("node"), "root").distinct()).join(wanted_roots.hint("merge"), "root", "left_semi")
    members = stash(members.join(sets.hint("merge"), "node").select("root", "node", "own"))
    bytes_of = members.groupBy("root").agg(F.ceil(F.sum(F.length("own")) / PART_BYTES).cast("int").alias("parts"))
    bytes_of = stash(bytes_of.withColumn("parts", F.greatest("parts", F.lit(1))))
    inside = members.join(bytes_of.hint("merge"), "root").select("root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("guest"), "node", "own")
    guests = sent.join(bytes_of.hint("merge"), "root").join(sets.withColumnRenamed("node", "a").hint("merge"), "a")
    guests = guests.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("guest"), F.col("a").alias("node"), "own")
    met = inside.unionByName(guests).repartition(parts, "root", "part").sortWithinPartitions("root", "part", "guest")
    by_part = stash(map_arrow(met, _against_part(similar), "a binary, b binary"))
    out = joined(one_by_one.unionByName(by_part), second)
    for used in (made, near, meet, sets, linked, first, bits, rows, turned, again, linked_again, second, rows_again, rest, one_by_one, members, bytes_of, by_part):
        discard(used)
    return out


def group(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (smallest doc_id of all near copies, linked directly or not) of every row, as ``neardup.group``.

    Null texts count as empty; texts without words are copies of each other; null doc_ids never name a component.
    """
    marked = stash(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), node(text_col).alias("node")))
    named = marked.groupBy("node").agg(F.min("doc_id").alias("first")).join(roots(docs, shingle, similar, text_col).hint("merge"), "node", "left")
    named = named.select("node", "first", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stash(named.join(lowest, "root").select("node", "component_id"))
    return marked.join(named.hint("merge"), "node").select("doc_id", "component_id")
