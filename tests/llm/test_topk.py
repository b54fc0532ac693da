"""Top-k with repeated ids, ties, and any partitioning."""
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("contactforge.llm")
from contactforge.llm import topk  # noqa: E402


def test_repeated_ids_do_not_depend_on_partitions(spark):
    r = np.random.default_rng(7)
    rows = [(i // 3, r.normal(size=5).tolist(), "x") for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    ask = F.col("vec_id") % 50 == 0
    one = sorted(map(tuple, topk.top_k(df.repartition(1), ask).collect()))
    assert one == sorted(map(tuple, topk.top_k(df.repartition(7, "vec_id"), ask, candidate_bytes=400, query_bytes=80).collect()))
    whole = [np.floor(np.array(v) * 1024).astype(np.int64) for _, v, _ in rows]
    for q in range(0, 300, 50):
        query = np.floor(np.array(min(v for i, v, _ in rows if i == q)) * 1024).astype(np.int64)
        best = sorted((-int(w @ query), rows[n][0]) for n, w in enumerate(whole) if rows[n][0] != q)[:10]
        assert [(x[2], x[3]) for x in one if x[0] == q] == [(i, -s) for s, i in best]


def test_wide_vectors_and_few_candidates(spark):
    rows = [(i, [float(i % 4)] * 300) for i in range(30)] + [(1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, k=40, candidate_bytes=1).collect()
    assert len(got) == 29 and [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 30))
    ties = topk.top_k(df, F.col("vec_id") == 1).collect()
    assert [r.vec_id for r in sorted(ties, key=lambda r: r.rank)] == [3, 7, 11, 15, 19, 23, 27, 2, 6, 10]


@pytest.mark.parametrize("width", [1, 3, 8])
def test_narrow_vectors_in_blocks_of_bounded_rows(width):
    """Blocks hold no more rows than of wide vectors, so that the matrix of scores is bounded."""
    import pyarrow as pa

    n = 20_000
    v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.random.default_rng(1).normal(size=n * width)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), v], ["vec_id", "v"])
    for size in (topk.CANDIDATE_BYTES, topk.QUERY_BYTES):
        rows = [len(b.column(2)[0].as_py()) // 8 for b in topk._pack(size)(iter([batch]))]
        assert sum(rows) == n and max(rows) <= size // (8 * topk.NARROW)
