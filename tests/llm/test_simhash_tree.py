"""Shards of the upper tree: dense balls, awkward rows."""
import numpy as np
import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import neardup  # noqa: E402


def test_shards_of_dense_balls_and_even_regions():
    rng = np.random.default_rng(3)
    even = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    flips = np.zeros(20_000, np.uint64)
    for _ in range(5):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(flips)).astype(np.uint64)
    points = np.unique(np.concatenate([even, np.uint64(77) ^ flips]))
    tree = neardup.UpperTree(points[::8], 8, 2000, 2)
    index, shard = tree.route(points)
    assert np.bincount(shard).max() < 6000 and len(index) < 8 * len(points)
    # Linked fingerprints of the ball meet somewhere.
    own = {}
    for i, s in zip(index.tolist(), shard.tolist(), strict=True):
        own.setdefault(i, set()).add(s)
    ball = np.flatnonzero(np.bitwise_count(points ^ np.uint64(77)) <= 5)
    apart = np.bitwise_count(points[ball][:, None] ^ points[ball][:800])
    for a, b in zip(*np.nonzero(apart <= 2), strict=True):
        assert own[ball[a]] & own[ball[b]]


def test_shard_sizes_do_not_change_the_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3000)
    fps = np.unique(np.concatenate([base, base[:900] ^ (1 << rng.integers(0, 62, 900))]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = []
    for shard in (40, 700, 10**6):
        edges = neardup.links(df, len(fps), shard=shard)
        found.append({r.node: r.root for r in neardup.components(edges).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) >= 890


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, "all alone here now"), (7, None), (8, ""), (None, " "), (3, "One  TWO three four")]
    got = sorted(((r.doc_id, r.component_id) for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (None, None), (7, 7), (8, 7), (None, 7), (3, 3)], key=str)


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_hashes_in_blocks_equal_the_whole(monkeypatch, shingle):
    import random

    import xxhash

    r = random.Random(shingle)
    texts = [b"", b"  ", b"One", b"a b", b"x" * 900, *(b" \t".join(bytes(r.choices(b"abcAB\xc3\xa9", k=r.randrange(1, 9))) for _ in range(r.randrange(1, 400))) for _ in range(30))]
    for text in texts:
        words = text.lower().split()
        want = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(len(words) - shingle + 1, bool(words)))]
        for block in (7, 64, 1 << 18):
            monkeypatch.setattr(neardup, "TEXT_BLOCK", block)
            assert [int(h) for part in neardup.shingle_hashes(text, shingle) for h in part] == want


def test_long_texts_in_bounded_memory():
    """A text's list of words and hashes stands in memory for one block of it only."""
    import tracemalloc

    text = b"".join(b"%d the quick brown fox " % i for i in range(120_000))
    tracemalloc.start()
    assert neardup.fingerprint(text) and len(text) > 3_000_000
    assert tracemalloc.get_traced_memory()[1] < 15_000_000
    tracemalloc.stop()
