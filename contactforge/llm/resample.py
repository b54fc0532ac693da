"""Resampling documents toward a target collection by hashed word features, with an exact distributed selection.

A document's weight is the mean log ratio, over its features, of their bucket's share in the target and in the source; a
seeded Gumbel draw is added and the highest sums win (drawing without replacement in proportion to the weights). The
cutoff is found by weighted median of medians: each partition names the median of its remaining keys, the median of these
weighted by the partitions' sizes splits all remaining keys so that about a quarter is discarded at least, until
few are left and the exact cutoff key is known. Only the winners are sorted.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from .common import as_bytes, discard, map_arrow, slices, stash, table
from .words import splitter, word_blocks

BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
#: A feature is a run of so many words at most.
LONGEST = 1
#: Keys that are left when the driver takes the last step.
FINISH = 10_000
#: Words are runs of digits, letters, and all beyond ASCII.
SPLIT = splitter(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SHORT, _HELD = 64, 200_000


class _Bucket(dict):
    """Bucket of a feature; those of short ones are remembered, a bounded number."""

    def __missing__(self, feature: bytes) -> int:
        out = zlib.crc32(feature) % BUCKETS
        if len(feature) <= _SHORT:
            if len(self) >= _HELD:
                self.clear()
            self[feature] = out
        return out


def feature_buckets(text: bytes, longest: int, bucket: _Bucket) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text, its number of words and the buckets of its features (runs of 1 to ``longest`` words)."""
    tail: list[bytes] = []
    for words in word_blocks(text, SPLIT):
        found = [np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))]
        for n in range(2, longest + 1):
            near = [*tail[len(tail) - min(n - 1, len(tail)) :], *words]
            runs = [b" ".join(near[i : i + n]) for i in range(len(near) - n + 1)]
            found.append(np.fromiter(map(bucket.__getitem__, runs), np.int64, len(runs)))
        tail = [*tail, *words][-(longest - 1) :] if longest > 1 else []
        yield len(words), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row for each bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(BUCKETS, np.int64), _Bucket()
        for whole in batches:
            for b in slices(whole, 0):
                for text in as_bytes(b.column(0)):
                    for _, found in feature_buckets(text, longest, bucket):
                        np.add.at(total, found, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    got = map_arrow(texts.select(F.col(text_col).cast("string").alias("text")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of target to source share, both smoothed by one, in whole thousandths."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: str = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score. ``gain`` is one number a bucket, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bucket = shared.value, _Bucket()
        for whole in batches:
            for b in slices(whole, 1):
                out = []
                for doc_id, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    words = n = total = 0
                    for count, found in feature_buckets(text, longest, bucket):
                        words, n, total = words + count, n + len(found), total + int(own[found].sum())
                    weight = total // n if n else 0
                    out.append((doc_id, words, n, weight, weight + gumbel(doc_id, seed)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "n_words", "n_features", "weight", "score"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(kept, run, "doc_id long, n_words long, n_features long, weight long, score long")


# --- selection ----------------------------------------------------------------------------------------------------------

#: Keys rise: the highest score first, then the smallest id, a null id last.
LAST_ID = (1 << 63) - 1


def _key(score: Column, doc_id: Column) -> list[Column]:
    return [(-score).alias("a"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("b")]


def _before(a: int, b: int, same: bool = False) -> Column:
    """Whether a row's key is below (a, b), or equal to it too."""
    return (F.col("a") < a) | ((F.col("a") == a) & ((F.col("b") <= b) if same else (F.col("b") < b)))


def _median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's (lower) median key and its number of keys: two numbers a row are held."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        middle = np.lexsort((b, a))[(len(a) - 1) // 2]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (a[middle], b[middle], len(a))], ["a", "b", "n"])


def cutoff(keys: DataFrame, wanted: int, total: int, finish: int = FINISH) -> tuple[int, int] | None:
    """The ``wanted``-th smallest (a, b) of ``total`` keys, or None if none is wanted. What is left after a step is written, so
    that each key is read a few times on average; the driver sees one median a partition, and ``finish`` keys at the end.
    """
    if not wanted:
        return None
    held, made = keys, False
    while total > finish:
        medians = sorted(map(tuple, map_arrow(held, _median, "a long, b long, n long").collect()))
        half, upto = sum(n for *_, n in medians), 0
        for a, b, n in medians:
            upto += n
            if 2 * upto >= half:
                break
        below, equal = held.agg(F.count_if(_before(a, b)), F.count_if((F.col("a") == a) & (F.col("b") == b))).first()
        if below < wanted <= below + equal:
            if made:
                discard(held)
            return a, b
        if wanted <= below:
            left, total = held.where(_before(a, b)), below
        else:
            left, total, wanted = held.where(~_before(a, b, True)), total - below - equal, wanted - below - equal
        left = stash(left)
        if made:
            discard(held)
        held, made = left, True
    rest = held.toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    if made:
        discard(held)
    return rest["a"][wanted - 1].as_py(), rest["b"][wanted - 1].as_py()


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, seed: str = SEED, finish: int = FINISH) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document (doc_id, text); ``target`` has texts only.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) have a rank: 1, 2, ... by
    falling score, ties to the smaller id, a null id last; all others' rank is null. Null and empty texts, and texts
    without words, have no features, weight 0, and never a rank. Repeated rows (or ids) are documents of their own and
    score alike. Texts of any length are read whole, in blocks. Other columns are not read; an empty table of documents
    gives an empty table, an empty target evens out all target shares.
    """
    gain = gains(bucket_counts(docs, longest=longest), bucket_counts(target, longest=longest))
    rows = stash(scored(docs, gain, longest, seed))
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    wanted = n * percent // 100
    last = cutoff(rows.where(able).select(*_key(F.col("score"), F.col("doc_id"))), wanted, n, finish)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    marked = rows.select("*", *_key(F.col("score"), F.col("doc_id"))).withColumn("won", able & _before(*last, True))
    ranked = numbered(marked.where("won").select(*columns, "a", "b"), ["a", "b"], "rank")
    # Rows that are equal to the last winner in all may be more than are wanted.
    ranked = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return ranked.unionByName(marked.where("NOT won").select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of those of 20 words or more drawn toward the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum's table by its polynomial, checksums of distinct words byte by byte, then weights and ranks by windows.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
), d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), m AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), dw AS (SELECT k, unnest(ws) AS w FROM d), mw AS (SELECT unnest(ws) AS w FROM m),
types AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM mw)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a, b) % 256)::INT + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM types, crc
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM mw JOIN hashed USING (w) GROUP BY bucket),
g AS (
  SELECT b.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), w AS (SELECT k, count(*) AS n, sum(gain) AS total FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY k),
scores AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS luck
  FROM d LEFT JOIN w USING (k)
), r AS (
  SELECT doc_id, n_features, weight, weight + luck AS score, n_features >= 20 AS able,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + luck DESC, doc_id NULLS LAST) AS place FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM r WHERE able) * 10 // 100 THEN place END AS rank FROM r
"""
