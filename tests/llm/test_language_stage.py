"""Naive Bayes by hand, blocks of long texts, and what the language stage keeps."""
import math
import random
import resource
from collections import Counter

import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import langid  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FINNISH = "Koira juoksi pitkin rantaa ja haukkui lokeille, jotka nousivat siivilleen ja katosivat usvaan. Vanha kalastaja hymyili. "


def plain_buckets(text):
    """Bigram and trigram buckets, one at a time."""
    c = [32 if x < 128 and not 97 <= x <= 122 else x for x in map(ord, f" {text.lower()} ")]
    out, mask = Counter(), 0xFFFFFFFF
    for i in range(len(c) - 1):
        two = (c[i] * 0x9E3779B1 + c[i + 1] * 0x85EBCA77) & mask
        for h in [two] + ([(two * 0xC2B2AE3D + c[i + 2]) & mask] if i + 2 < len(c) else []):
            h ^= h >> 15
            out[(h * 0x27D4EB2F & mask) >> (32 - langid.BUCKET_BITS)] += 1
    return out


def plain_predict(rows, text):
    """Textbook naive Bayes over (text, lang) rows."""
    counts, docs = {}, Counter()
    for t, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_buckets(t))
        docs[lang] += 1
    found = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.1 * (1 << langid.BUCKET_BITS)
        found[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((own[b] + 0.1) / total) for b, n in plain_buckets(text).items())
    best = max(sorted(found), key=found.get)
    return best, 1 / sum(math.exp(x - found[best]) for x in found.values())


def test_query_against_plain_naive_bayes(spark):
    import zlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = [(r.text, r.lang) for r in docs if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    got = {r.doc_id: r for r in langid.op4_language(spark, SMALL).collect()}
    assert len(got) == len(docs)
    counts = [(t, lang) for t, lang in rows]
    for r in random.Random(1).sample(docs, 25):
        lang, score = plain_predict(counts, r.text or "")
        if any(ch.isalpha() for ch in r.text or ""):
            assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_blocks_count_like_the_whole(monkeypatch):
    r = random.Random(4)
    for n in (0, 1, 2, 5, 6, 7, 8, 40, 333):
        text = "".join(r.choice("abcé Σß1日.") for _ in range(n))
        for size in (3, 7, 64, 1 << 18):
            monkeypatch.setattr(langid, "BLOCK", size)
            counts = langid.ngram_counts(text)
            assert {int(b): int(counts[b]) for b in counts.nonzero()[0]} == dict(plain_buckets(text)), (n, size)


def test_a_hundred_megabytes_within_a_gigabyte():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert langid.ngram_counts("some words " * ((100 << 20) // 11)).sum() > 150_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_language_stage_rejects_by_its_prediction(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    first = docs.where("lang = 'en' AND length(text) > 200").orderBy("doc_id").first()
    german = docs.where("lang = 'de' AND length(text) > 200").orderBy("doc_id").first()
    extra = [(900001, FINNISH, None), (900002, FINNISH * 3, "en"), (900003, german.text, "en"), (900004, german.text, None), (900005, german.text, "xx"), (900006, "1234", "en"), (900007, None, "de"), (None, first.text, "en"), (None, first.text, "en"), (900008, first.text * 50, "en")]
    more = docs.unionByName(spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in extra], docs.schema))
    kept = langid.accept_language(spark, more, MIDDLE)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns
    assert not {900001, 900002, 900003, 900006, 900007} & set(ids) and {900004, 900005, 900008} <= set(ids) and ids.count(None) == 2
    # Clean documents of the table stay: of 1000, only those that claim another language than their text's may go.
    gone = docs.join(kept.select("doc_id"), "doc_id", "left_anti").collect()
    model = langid.train_on(more)
    assert len(gone) <= 5 and all(model.predict(r.text)[0] != r.lang for r in gone)


def test_language_stage_keeps_all_where_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "1234", None), (4, "eins", None)], "doc_id long, text string, lang string")
    assert langid.accept_language(spark, docs, "").count() == 3
    assert langid.accept_language(spark, docs.limit(0), "").count() == 0
    assert langid.predict(docs.limit(0), langid.train(docs)).count() == 0
