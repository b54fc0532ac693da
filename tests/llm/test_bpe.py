"""Token ids of long texts in blocks, and awkward tables."""
import hashlib
import random
import resource

import numpy as np
import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P

    with open(P.path(bpe.VOCABULARY), "rb") as f:
        return bpe.coder(f.read(), P.PATTERN)


def test_blocks_give_what_the_whole_gives(coder, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice(["word", " ", "  ", "\n", "é", "日本", "🙂", "12", "!", "'s", "\t"]) for _ in range(500)) for _ in range(20)]
    want = [bpe.code(*coder, t.encode()) for t in texts]
    assert all(w[3] and w[2] == hashlib.sha256(t.encode()).hexdigest() for w, t in zip(want, texts, strict=True))
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "PIECES", 3)
    assert [bpe.code(*coder, t.encode()) for t in texts] == want


def test_a_hundred_megabytes_within_a_gigabyte(coder):
    raw = ("some words of a long text, 日本 and more\n" * 2_400_000).encode()
    assert len(raw) > 100_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n, _, back, same = bpe.code(*coder, raw)
    assert same and back == hashlib.sha256(raw).hexdigest() and n > 10_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_one_piece_of_a_whole_text(coder):
    """A text without a break is one piece: time is linear in its length."""
    raw = b"abcdefghij" * 200_000
    assert bpe.code(*coder, raw)[3]


def test_tables(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "same text", "y"), (3, "same text", "y"), (None, "no id", None)], "doc_id long, text string, ids string")
    rows = bpe.encode_texts(df, P.path(bpe.VOCABULARY), P.PATTERN, ids=True)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids) for r in rows.collect()), key=str)
    assert [x[0] for x in got] == [0, 1, 2, 3, 3] and got[1][1:] == got[2][1:] == (0, []) and got[3] == got[4]
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in rows.collect())
    assert bpe.encode_texts(df.limit(0), P.path(bpe.VOCABULARY), P.PATTERN).count() == 0
    assert bpe.decode_ids(rows.limit(0), P.path(bpe.VOCABULARY)).count() == 0


def test_released_caches_are_made_anew(coder):
    from contactforge.llm.common import released

    first = coder[1]["word"]
    assert bpe._coders
    released()
    released()
    assert not bpe._coders and coder[1]["word"] == first
