"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors become integers floor(1024 * x). Candidates are packed into blocks in vertical layout (one row for each
dimension, dimensions of largest mass first); queries into blocks of their own. A task walks a query block through
its candidate blocks: scores grow dimension block by dimension block, and after each one a candidate stays only if
its partial score plus the product of the remaining masses (Cauchy-Schwarz) can still reach the query's k-th best
score so far. Survivors are compacted, so later dimensions touch fewer and fewer of them.

Every query block meets every candidate block once: a stated query set against all rows, in blocks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, shuffle_partitions, stash, table

SCALE = 1024
K = 10
#: Bytes of a block of candidates and of queries (components as 64-bit integers).
CANDIDATE_BYTES, QUERY_BYTES = 4 << 20, 1 << 18
#: A narrower vector counts as one of so many components: it is rows that the matrix of scores grows with.
NARROW = 64
STEP = 16
LIMIT = 1 << 63


def _pack(size: int):
    """Batches of (id, vector) into blocks of ``size`` bytes (one vector at least): ids, and components as 64-bit
    integers, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(width):
            ids, rows = held.pop(width)
            m = np.ascontiguousarray(np.array(rows, np.int64).reshape(len(ids), width).T)
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([min(ids)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["width", "first", "ids", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
            ends = np.cumsum(np.fromiter((len(x) for x in column), np.int64, b.num_rows))
            for i, e, s in zip(b.column(0).to_pylist(), ends.tolist(), [0, *ends.tolist()], strict=False):
                x = np.floor(flat[s:e] * SCALE)
                if (np.abs(x) >= 2.0**62).any():
                    raise ValueError(f"vector {i} has a component too large for an integer score")
                ids, rows = held.setdefault(e - s, ([], []))
                ids.append(i)
                rows.append(x.astype(np.int64))
                if len(ids) * 8 * max(e - s, NARROW) >= size:
                    yield block(e - s)
        for width in list(held):
            yield block(width)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows that take part: id and vector not null, all components present and finite."""
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


class Best:
    """The k best (score, id) of each query of one block so far; ties go to the smaller id."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int):
        self.qids, self.q, self.k = qids, q, k
        self.scores = np.full((len(qids), k), -LIMIT, np.int64)
        self.ids = np.full((len(qids), k), LIMIT - 1, np.int64)
        self.count = np.zeros(len(qids), np.int64)
        self.order = np.argsort(-np.abs(q.astype(np.float64)).sum(1), kind="stable")

    def visit(self, ids: np.ndarray, m: np.ndarray) -> None:
        dims, k = len(m), self.k
        small = np.abs(self.q).astype(np.float64).max(initial=0) * np.abs(m).astype(np.float64).max(initial=0) * max(dims, 1)
        if small >= 2.0**62:
            raise ValueError("inner products too large for an integer score")
        # Products and sums below 2**53 are exact in doubles, whose matrix product is the fast one.
        kind = np.float64 if small < 2.0**52 else np.int64
        q, m = self.q[self.order].astype(kind), m[self.order].astype(kind)
        cuts = list(range(0, dims, STEP)) + [dims]
        rest_q = [np.sqrt((q[c:].astype(np.float64) ** 2).sum(0)) for c in cuts]
        rest_m = [np.sqrt((m[c:].astype(np.float64) ** 2).sum(0)) for c in cuts]
        bound = np.where(self.count >= k, self.scores[:, -1].astype(np.float64), -np.inf)
        if (self.count < k).any():
            # The block's own candidates of largest mass along the query give a first bound: their whole scores.
            bound = np.maximum(bound, self._first_bound(q, m, ids))
        half = min(2, len(cuts) - 1)
        part = q[: cuts[half]].T @ m[: cuts[half]]
        # One part in 2**40 covers the rounding of the roots.
        reach = part + rest_q[half][:, None] * rest_m[half] * (1 + 2.0**-40) + 1
        own = self.qids[:, None] == ids
        qi, ci = np.nonzero((reach >= bound[:, None]) & ~own)
        part = part[qi, ci]
        for c in range(half, len(cuts) - 1):
            for s in range(0, len(qi), 1 << 17):
                e = s + (1 << 17)
                part[s:e] += np.einsum("ij,ij->j", q[cuts[c] : cuts[c + 1]][:, qi[s:e]], m[cuts[c] : cuts[c + 1]][:, ci[s:e]])
            stay = part + rest_q[c + 1][qi] * rest_m[c + 1][ci] * (1 + 2.0**-40) + 1 >= bound[qi]
            qi, ci, part = qi[stay], ci[stay], part[stay]
        self._merge(qi, part.astype(np.int64), ids[ci])

    def _first_bound(self, q: np.ndarray, m: np.ndarray, ids: np.ndarray, several: int = 4) -> np.ndarray:
        """A score that k candidates of this block reach, for each query: exact scores of the ones that lead after the
        first dimensions (the query's own row left out)."""
        n = min(len(ids), several * self.k + 1)
        if n <= self.k:
            return np.full(len(self.qids), -np.inf)
        lead = q[:STEP].T @ m[:STEP]
        lead[self.qids[:, None] == ids] = np.iinfo(np.int64).min if lead.dtype == np.int64 else -np.inf
        at = np.argpartition(-lead, n - 1, axis=1)[:, :n]
        whole = np.einsum("iq,iqn->qn", q, m[:, at]).astype(np.float64)
        whole[self.qids[:, None] == ids[at]] = -np.inf
        return np.sort(whole, axis=1)[:, -self.k]

    def _merge(self, qi: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        have = np.repeat(np.arange(len(self.qids)), self.k)
        old = (self.scores != -LIMIT).ravel() | (self.ids != LIMIT - 1).ravel()
        qi, score, ids = np.concatenate([have[old], qi]), np.concatenate([self.scores.ravel()[old], score]), np.concatenate([self.ids.ravel()[old], ids])
        order = np.lexsort((ids, -score, qi))
        qi, score, ids = qi[order], score[order], ids[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < self.k
        self.scores[qi[top], rank[top]], self.ids[qi[top], rank[top]] = score[top], ids[top]
        self.count = np.minimum(np.bincount(qi, minlength=len(self.qids)), self.k)

    def rows(self) -> pa.RecordBatch:
        found = np.arange(self.k) < self.count[:, None]
        who = np.broadcast_to(self.qids[:, None], found.shape)
        return pa.RecordBatch.from_arrays([pa.array(who[found]), pa.array(self.ids[found]), pa.array(self.scores[found])], ["query_id", "vec_id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["width"], row["q_first"]):
                    if best is not None:
                        yield best.rows()
                    key = (row["width"], row["q_first"])
                    qids = np.frombuffer(row["q_ids"], np.int64)
                    best = Best(qids, np.frombuffer(row["q_m"], np.int64).reshape(row["width"], len(qids)), k)
                ids = np.frombuffer(row["ids"], np.int64)
                best.visit(ids, np.frombuffer(row["m"], np.int64).reshape(row["width"], len(ids)))
        if best is not None:
            yield best.rows()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", candidate_bytes: int = CANDIDATE_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other vectors of its length.

    Vectors that are null or hold nulls or non-finite components take no part; neither do null ids. Rows that repeat
    an id are one vector's copies: none of them is its own query's candidate, and each other query may list them
    once per row. Ties go to the smaller id; fewer candidates than k give fewer rows; components or scores beyond 62
    bits raise ValueError; other columns are not read. An id that several query rows bear is asked once, with the
    smallest of their vectors in array order. Blocks are bounded in bytes, whatever the width. An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector_col)
    schema = "width int, first long, ids binary, m binary"
    blocks = map_arrow(kept, _pack(candidate_bytes), schema)
    asked = map_arrow(kept.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), _pack(query_bytes), schema)
    # Blocks meet in `parts` groups; each group holds its candidate blocks and streams all query blocks past them.
    parts = shuffle_partitions(spark)
    blocks = stash(blocks.withColumn("part", F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int")))
    asked = asked.select(F.col("width"), F.col("first").alias("q_first"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    asked = stash(asked)
    there = blocks.select("part", "width").distinct()
    sent = asked.join(there.withColumnRenamed("width", "w"), F.col("width") == F.col("w")).drop("w")
    # Dealt out by name, so that groups which are small in bytes but not in work aren't put together again.
    sent = sent.repartition(parts, "part", "width")
    met = sent.join(blocks.select("part", "width", "ids", "m").repartition(parts, "part", "width").hint("merge"), ["part", "width"])
    found = map_arrow(met.select("width", "q_first", "q_ids", "q_m", "ids", "m"), _search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth one."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
