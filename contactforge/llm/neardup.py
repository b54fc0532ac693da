"""SimHash near-duplicates by vantage-point trees.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles. Only distinct fingerprints are compared.

Shards. An upper vantage-point tree, built from a bounded sample, splits the space: each inner node has a vantage
fingerprint and a radius, and a fingerprint goes inward if its Hamming distance is at most the radius, else outward.
By the triangle inequality a fingerprint outside can only link to one inside if its distance is at most radius +
limit, so just those boundary fingerprints are also sent inward; every linked pair then meets in some shard, whatever
the sample was. Inside a shard a lower tree, pruned by the same bounds, finds all pairs at the limit or nearer, and a
spanning forest of them is passed on. Forests of all shards are joined by large-star / small-star rounds.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, map_arrow, shuffle_partitions, slices, stash, table
from .words import splitter, word_blocks

BITS_APART = 2
SHINGLE = 3
#: Distinct fingerprints that a shard should hold (16 MB of them), fewer where that leaves tasks without work; sampled
#: fingerprints for each such shard.
SHARD = 1 << 21
LEAST_SHARD = 16384
SAMPLE = 64
#: A node is split if its larger side, with what stands on both sides, is at most this share of it.
SHRINKS = 0.9
LEAF = 96


#: Bytes of a text whose words stand in a list at once.
TEXT_BLOCK = 1 << 18
SPLIT = splitter(bytes(range(9, 14)))


def shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``shingle`` words, block by block; a shorter text is one run, a wordless one has none."""
    digest, tail, some = xxhash.xxh64_intdigest, [], False
    for words in word_blocks(data, SPLIT, TEXT_BLOCK):
        words = [*tail, *words]
        if len(words) < shingle:
            tail = words
            continue
        whole = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes + 1) - sizes - 1
        end = (begin + sizes)[shingle - 1 :].tolist()
        yield np.array([digest(whole[a:b], 42) for a, b in zip(begin.tolist(), end, strict=False)], np.uint64)
        tail, some = words[len(words) - shingle + 1 :], True
    if tail and not some:
        yield np.array([digest(b" ".join(tail), 42)], np.uint64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, shingle):
        n += len(hashes)
        for i in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 1):
            found = np.array([fingerprint(x) for x in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer. Null and wordless texts: zero."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(kept, _fingerprints, "doc_id long, fp long")


class UpperTree:
    """Vantage fingerprints and radii in arrays; children below zero are shards. Each sampled point stands for
    ``weight`` fingerprints; nodes are split while they stand for more than ``shard``, so that a dense ball of
    fingerprints is split further than an even region. A ball that no vantage splits any more stays one shard."""

    def __init__(self, sample: np.ndarray, weight: float, shard: int, limit: int):
        self.limit, self.vantage, self.radius, self.inner, self.outer, self.shards = limit, [], [], [], [], 0
        rng = np.random.default_rng(5)
        self.root = -1
        open_ = [(sample, None, None)]
        while open_:
            points, above, side = open_.pop()
            found = self._split(points, rng) if len(points) * weight > shard and len(points) > 2 else None
            if found is None:
                self.shards += 1
                at = -self.shards
            else:
                v, r, d = found
                at = len(self.vantage)
                for held, x in ((self.vantage, v), (self.radius, r), (self.inner, 0), (self.outer, 0)):
                    held.append(x)
                open_ += [(points[d <= r + limit], at, self.inner), (points[d > r], at, self.outer)]
            if above is None:
                self.root = at
            else:
                side[above] = at

    def _split(self, points: np.ndarray, rng) -> tuple[np.uint64, int, np.ndarray] | None:
        """The vantage and radius that leave the smallest larger side and the fewest copies."""
        best, seen = None, points if len(points) <= 1024 else points[rng.integers(0, len(points), 1024)]
        for k in range(12):
            v = rng.integers(0, 1 << 64, dtype=np.uint64) if k % 2 else points[rng.integers(len(points))]
            # Shares at distance r or less, for every r.
            upto = np.bincount(np.bitwise_count(seen ^ v), minlength=65 + self.limit).cumsum() / len(seen)
            inner, outer = upto[self.limit :], 1 - upto[: len(upto) - self.limit]
            larger = np.maximum(inner, outer)
            cost = np.where(larger <= SHRINKS, larger + 0.5 * (inner + outer - 1), 9.0)
            r = int(cost.argmin())
            if cost[r] < 9 and (best is None or cost[r] < best[0]):
                best = (cost[r], v, r)
        return None if best is None else (*best[1:], np.bitwise_count(points ^ best[1]))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the fingerprint, shard) of every copy: its own shard and those whose boundary it overlaps."""
        index, shard, open_ = [], [], [(self.root, np.arange(len(points)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                index.append(at)
                shard.append(np.full(len(at), -node - 1, np.int64))
                continue
            d = np.bitwise_count(points[at] ^ self.vantage[node])
            open_.append((self.inner[node], at[d <= self.radius[node] + self.limit]))
            open_.append((self.outer[node], at[d > self.radius[node]]))
        none = np.zeros(0, np.int64)
        return np.concatenate(index) if index else none, np.concatenate(shard) if shard else none


def close_pairs(points: np.ndarray, limit: int = BITS_APART, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of distinct fingerprints at most ``limit`` apart, in bounded blocks, by a lower tree.

    Each split sends the boundary of the outer part inward as *guests* that are compared with the inner part only.
    Guests of a node follow the same bounds on both sides, so nothing that could link is left out.
    """
    rng = np.random.default_rng(11)
    nothing = np.zeros(0, np.int64)
    open_ = [(np.arange(len(points)), nothing)]
    while open_:
        own, guests = open_.pop()
        if not len(own):
            continue
        if len(own) > leaf:
            v = points[own[rng.integers(len(own))]] if rng.random() < 0.25 else rng.integers(0, 1 << 64, dtype=np.uint64)
            d = np.bitwise_count(points[own] ^ v)
            r = int(np.median(d)) - 1
            if not (d <= r).any():
                r += 1
            if (d > r).any():
                g = np.bitwise_count(points[guests] ^ v)
                near = own[(d > r) & (d <= r + limit)]
                open_.append((own[d <= r], np.concatenate([guests[g <= r + limit], near])))
                open_.append((own[d > r], guests[g > r - limit]))
                continue
            # All own points are at one distance from this vantage; try others before comparing them all.
            v = points[own[0]]
            d = np.bitwise_count(points[own] ^ v)
            r = int(np.median(d))
            if (d > r).any():
                g = np.bitwise_count(points[guests] ^ v)
                near = own[(d > r) & (d <= r + limit)]
                open_.append((own[d <= r], np.concatenate([guests[g <= r + limit], near])))
                open_.append((own[d > r], guests[g > r - limit]))
                continue
        for i in range(0, len(own), 512):
            mine = own[i : i + 512]
            for others, same in ((own[i:], True), (guests, False)):
                for j in range(0, len(others), 8192):
                    them = others[j : j + 8192]
                    a, b = np.nonzero(np.bitwise_count(points[mine][:, None] ^ points[them]) <= limit)
                    if same and not j:
                        ahead = b > a
                        a, b = a[ahead], b[ahead]
                    if len(a):
                        yield mine[a], them[b]


def forest(points: np.ndarray, limit: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its root) that connect what is linked among these distinct fingerprints."""
    root = np.arange(len(points))
    for a, b in close_pairs(points, limit):
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
    linked = root != np.arange(len(points))
    return points[linked], points[root[linked]]


def _links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held):
            a, b = forest(np.unique(np.concatenate(held)).view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        shard, held = None, []
        for batch in batches:
            s, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if shard != s[i] and held:
                    yield close(held)
                    held = []
                shard = s[i]
                held.append(f[i:j])
        if held:
            yield close(held)

    return run


def links(distinct: DataFrame, n: int, limit: int = BITS_APART, shard: int | None = None) -> DataFrame:
    """Links (a, b) of a spanning forest over all pairs of ``n`` distinct fingerprints at most ``limit`` bits apart."""
    spark = distinct.sparkSession
    shard = shard or max(LEAST_SHARD, min(SHARD, ceil(n / (4 * shuffle_partitions(spark)))))
    # Where to split only; which fingerprints meet doesn't depend on the sample. It is one fingerprint in 32768 for
    # shards of full size, taken by hash without a sort.
    modulus = max(1, shard // SAMPLE)
    sample = np.sort(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(modulus)) == 0).select("fp").toArrow()["fp"].to_numpy()).view(np.uint64)
    tree = UpperTree(sample, modulus, shard, limit)
    shared = spark.sparkContext.broadcast(tree)  # one vantage for each shard

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy()
            index, to = shared.value.route(f.view(np.uint64))
            for i in range(0, len(index), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 200_000]), pa.array(f[index[i : i + 200_000]])], ["shard", "fp"])

    parts = max(shuffle_partitions(spark), min(tree.shards, 20 * shuffle_partitions(spark)))
    sent = map_arrow(distinct.select("fp"), route, "shard long, fp long").repartition(parts, "shard").sortWithinPartitions("shard")
    return map_arrow(sent, _links(limit), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node reachable. Alternates large-star and
    small-star until the edges rest; each round is written to the shared folder. Stars keep the edge count."""
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that a node with very many neighbours is split by the join (AQE).
        least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.where("a != b").distinct())
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = stash(small.where("a != b").distinct())
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for used in (now, least, large, low):
            discard(used)
        now = new
        if sign == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = sign


def group(docs: DataFrame, limit: int = BITS_APART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of all that are linked, directly or not) of every row.

    Repeated rows keep their rows; null doc_ids join a component but never name it (a component of null ids alone has
    a null id); other columns are not read; an empty table gives an empty table.
    """
    marked = stash(fingerprints(docs, id_col, text_col))
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = distinct.count()
    roots = components(links(distinct, n, limit))
    # Fingerprints without links need no join beyond this one.
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = stash(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stash(named.join(lowest, "root").select("fp", "component_id"))
    # A large group of copies is one key here: AQE splits it, as this is a plain sort-merge join of two tables.
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id of its component; awkward rows as in ``group``."""
    found = group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the smallest (doc_id, MD5 of its text) stays, with all
    columns. Near copies share 0.8 or more of their five-word shingles: candidates are what operator 6's fingerprints and trees
    link, and what MinHash buckets add beyond its radius; each is counted exactly (``wordcopies``).

    Rows that share an id but no text are judged apart, each by its own group. Of rows that repeat id and text one
    stays, the least by its columns that have an order. Rows with a null doc_id never stand for rows that have one, nor
    are they dropped for them; among themselves one of each group stays.
    """
    from . import wordcopies

    marked = docs.select(F.col("doc_id").alias("__id"), wordcopies.node().alias("__node"))
    texts = stash(marked.groupBy("__id", "__node").agg(F.count("*").alias("__rows")))
    no_id = F.col("__id").isNull().alias("__none")
    first = texts.groupBy("__node", no_id).agg(F.min(F.struct("__id", "__rows")).alias("m"))
    first = first.join(wordcopies.roots(docs).hint("merge"), F.col("__node") == F.col("node"), "left")
    least = F.min(F.struct("m.__id", "__node", "m.__rows")).alias("m")
    found = stash(first.groupBy(F.coalesce("root", "__node").alias("__root"), "__none").agg(least).select("m.*"))
    key = wordcopies.node()
    on = docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__node"))
    # One way at every size: both joins read the same exchange of the documents.
    once = docs.join(found.where("__rows = 1").hint("merge"), on, "left_semi")
    again = docs.join(found.where("__rows > 1").hint("merge"), on, "left_semi")
    ordered = [f.name for f in docs.schema if f.name != "doc_id" and not any(t in f.dataType.simpleString() for t in ("map<", "variant", "void"))]
    least = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in ordered))
    again = again.groupBy("doc_id", key.alias("__node")).agg(*(F.min_by(F.col(f"`{c}`"), least).alias(c) for c in docs.columns if c != "doc_id"))
    return once.unionByName(again.select(*(F.col(f"`{c}`") for c in docs.columns)))
