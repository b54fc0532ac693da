"""Near copies by word shingles against brute force."""
import random
from itertools import combinations

import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import neardup, wordcopies  # noqa: E402


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc_id -> smallest doc_id of its component."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if (not sets[i] and not sets[j]) or common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) > 0:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return {d: rows[top(i)][0] for i, (d, _) in enumerate(rows)}


def planted():
    """Texts in a row of steps: some near copies at similarities from 0.7 to 1, a large group, and what lies alone."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(60):
        base = [word() for _ in range(40 + 5 * k)]
        texts.append(base)
        for edits in (1, 2, 4):
            copy = list(base)
            for _ in range(edits * len(base) // 150 + 1):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    base = [word() for _ in range(150)]
    for _ in range(80):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        texts.append(copy)
    return list(enumerate([" ".join(t) for t in texts] + ["", None, "one two", "One  two", "one three"]))


def test_group_against_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in wordcopies.group(docs).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(rows) - 150
    assert wordcopies.group(docs.limit(0)).count() == 0


def test_stage_drops_ordinary_near_copies(spark):
    """Fingerprints of these copies lie more than two bits apart."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in neardup.keep_one(spark, docs, "").collect())
    assert kept == sorted(set(brute(rows).values()))
    assert kept != sorted({r.component_id for r in neardup.group(docs).collect()})


def test_recall_of_buckets():
    """Of 300 pairs just at 0.8 or above all meet in a bucket and pass the bits."""
    import numpy as np

    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = np.unique(x[:810]), np.unique(np.concatenate([x[:720], x[810:]]))
        assert wordcopies.similarity(a, b) >= 0.8
        (m, p), (n, q) = wordcopies.sketch(a), wordcopies.sketch(b)
        agree = 280 - int.bit_count(int.from_bytes(p) ^ int.from_bytes(q))
        missed += not (m == n).any() or agree < wordcopies.AGREE
    assert missed == 0


def test_rows_that_share_an_id(spark):
    """A text without any copy stays, whatever id it repeats; null ids are compared among themselves."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "k"), (2, a, "k"), (2, b, "k"), (3, c, "z"), (3, c, "y"), (None, b, "k"), (None, b, "l"), (None, a + " more", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = sorted(neardup.keep_one(spark, docs, "").collect(), key=str)
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id) == [(1, a), (2, b), (3, c)]
    assert [r.other for r in got if r.doc_id == 3] == ["y"]
    assert sorted(r.text for r in got if r.doc_id is None) == sorted([a + " more", b])
    assert neardup.keep_one(spark, docs.limit(0), "").count() == 0


def test_large_groups_with_outliers(spark, monkeypatch):
    """A group of near copies around one text, and outliers that are similar to a few of them only."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(260):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 6])):
            copy[rng.randrange(150)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for large, part, block in ((64, 16 << 20, 4096), (3, 4000, 10), (10**9, 1, 40)):
        monkeypatch.setattr(wordcopies, "LARGE", large)
        monkeypatch.setattr(wordcopies, "BLOCK", block)
        monkeypatch.setattr(wordcopies, "PART_BYTES", part)
        assert {r.doc_id: r.component_id for r in wordcopies.group(docs).collect()} == want


def test_blocks_meet_once(spark):
    """Every pair of different roots of a bucket meets in one cell; rows of the most frequent root never meet there."""
    from itertools import combinations as pairs_of

    rows = [(1, bytes([i]), b"", b"big" if i < 90 else bytes([i // 2]), 1) for i in range(120)]
    rows += [(2, b"a", b"", b"a", 1), (2, b"b", b"", b"b", 1)]
    monkey, wordcopies.BLOCK = wordcopies.BLOCK, 8
    try:
        got = wordcopies.blocked(spark.createDataFrame(rows, "bucket long, node binary, bits binary, root binary, size long")).collect()
    finally:
        wordcopies.BLOCK = monkey
    cells = {}
    for r in got:
        cells.setdefault((r.bucket, r.i, r.j), []).append((r.own, bytes(r.node), bytes(r.root)))
    met = []
    for (bucket, i, j), held in cells.items():
        assert not (i == j and len({root for *_, root in held}) == 1 and held[0][2] == b"big")
        met += [(bucket, *sorted((x[1], y[1]))) for x, y in pairs_of(held, 2) if x[2] != y[2] and (i == j or x[0] != y[0])]
    want = [(b, *sorted((x[1], y[1]))) for b in (1, 2) for x, y in pairs_of([(r[0], r[1], r[3]) for r in rows if r[0] == b], 2) if x[2] != y[2]]
    assert sorted(met) == sorted(want)


def test_neighbours_across_ranges(spark):
    """A bucket that fills several ranges is one chain."""
    rows = [(7, i.to_bytes(2)) for i in range(500)] + [(k, k.to_bytes(2)) for k in range(100, 120)]
    got = {(bytes(r.a), bytes(r.b)) for r in wordcopies.neighbours(spark.createDataFrame(rows, "bucket long, node binary"), "node").collect()}
    assert got == {(i.to_bytes(2), (i + 1).to_bytes(2)) for i in range(499)}
