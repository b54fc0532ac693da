"""Language-model scores against a plain version with the same parameters, normalisation, held-out gain, awkward rows."""
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("contactforge.llm")
from contactforge.llm import lm  # noqa: E402
from contactforge.llm.common import held_out  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text):
    return (text or "").encode().translate(TABLE).split()


def is_held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def plain(docs, model):
    """Base and model scores of (doc_id, text) with explicit softmax over all units."""
    train = [tokens(x) for i, x in docs if not is_held(i)]
    c = Counter(w for x in train for w in x)
    n, types = sum(c.values()) + len(train), len(c) + bool(train)
    ranked = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], lm.key(x[0])))][: lm.FREQUENT - 1]
    unit = {w: k + 1 for k, w in enumerate(ranked)}
    cls = lambda w: zlib.crc32(lm.key(w)[-2:]) % lm.CLASSES
    share = Counter()
    for w, k in c.items():
        if w not in unit:
            share[cls(w)] += k + 0.5
    before, maps, after, bias = (x.astype(float) for x in (model.before, model.maps, model.after, model.bias))
    base = lambda k: log10((k + 0.5) / (n + 0.5 * (types + 1)))
    out = []
    for i, x in docs:
        words, at = tokens(x), [lm.START, lm.START]
        b = s = 0.0
        for w in words:
            b += base(c[w])
            u = unit.get(w) or lm.FREQUENT + cls(w)
            s += 0.0 if w in unit else log10((c[w] + 0.5) / (share[cls(w)] + 0.5))
            at.append(u)
        at.append(lm.END)
        for p, q, u in zip(at, at[1:], at[2:], strict=False):
            z = (np.concatenate([before[p], before[q]]) @ maps) @ after.T + bias
            s += (z[u] - np.log(np.exp(z - z.max()).sum()) - z.max()) / np.log(10)
        out.append((i, is_held(i), len(words) + 1, sum(c[w] > 0 for w in words) + bool(train), n, b + base(len(train)), s))
    return out


def close(got, want):
    order = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[6], 3))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6, rel=1e-9) and g[6] == pytest.approx(w[6], abs=1e-4, rel=1e-6), (g, w)


def run(spark, df, monkeypatch):
    kept, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(real(*a)) or kept[-1])
    got = lm.score_texts(df, held_out(F.col("doc_id"), 5, 1)).collect()
    monkeypatch.setattr(lm, "train", real)
    return got, kept[0]


@pytest.mark.parametrize("listed", [1 << 16, 700])
def test_query_equals_plain(spark, monkeypatch, listed):
    """With any number of listed words from that of frequent units on."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    real = lm.lexicon
    monkeypatch.setattr(lm, "lexicon", lambda c, n: real(c, n, listed))
    got, model = run(spark, df, monkeypatch)
    close(got, plain([(r.doc_id, r.text) for r in df.collect()], model))


def test_awkward_rows(spark, monkeypatch):
    words = " ".join(f"w{i % 97} the Éa{i % 13}" for i in range(3000))
    docs = [(1, None), (2, ""), (3, " \t"), (None, "no id"), (4, words), (4, words), (5, "x" * 70 + " " + "X" * 70), (6, "y" * 3_000_000), (7, "the end " * 300_000), (8, "\x00 a\x0bb\x85c d")]
    docs += [(i, f"word{i} the {i}") for i in range(10, 60)]
    df = spark.createDataFrame([(*d, 1.0, "a") for d in docs], "doc_id long, text string, score double, word string").repartition(5)
    got, model = run(spark, df, monkeypatch)
    close(got, plain(docs, model))


def test_nothing_to_learn_from(spark):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    empty = lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(False))
    assert empty.columns == names and empty.count() == 0
    row = lm.score_texts(spark.createDataFrame([(3, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score == pytest.approx(-3 * log10(lm.UNITS), abs=0.2)


def test_held_out_texts_gain(spark):
    got = lm.op12_lm(spark, MIDDLE).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = got[got.held_out]
    gain = (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum()
    print("gain", gain, "better", (out.score > out.base_score).mean(), "base", out.base_score.sum() / out.n_tokens.sum())
    assert gain > 0.1 and (out.score > out.base_score).mean() > 0.9


def test_probabilities_add_up():
    model = lm.beginning(np.arange(lm.UNITS))
    r = np.random.default_rng(2)
    model.after += r.normal(size=model.after.shape)
    both, norm = model.log_probabilities()
    for u, v in r.integers(0, lm.UNITS + 1, (20, 2)):
        assert np.exp(both[0, u] + both[1, v] - norm[u, v]).sum() == pytest.approx(1, abs=1e-9)
