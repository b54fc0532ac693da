"""Resampling against a plain version, the selection at any size, awkward rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("contactforge.llm")
from contactforge.llm import resample, words  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plain(docs, target, longest=1):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000)))) for k in range(10000)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query_equals_plain_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = resample.op13_resample(spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert rows(got) == plain(docs, target)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert sorted(map(repr, c.execute(resample.OP13_SQL).fetchall())) == rows(got)


@pytest.mark.parametrize("longest", [1, 3])
def test_awkward_rows(spark, longest):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abZé日5") for _ in range(r.randrange(1, 5)))
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "!!! ..."), (None, "w " * 40), (None, None), (503, "long " * 400_000), (504, "x" * 3_000_000), *docs[:30]]
    target = [docs[3][1], docs[9][1] * 3, None]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, a string, rank long").repartition(7)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, finish=3)
    assert rows(got) == plain(docs, target, longest)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "one two"), (2, "b " * 30)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert rows(resample.resample(some, none)) == plain([(1, "one two"), (2, "b " * 30)], [])


def test_cutoff_is_exact(spark):
    r = random.Random(8)
    keys = [(r.randrange(-40, 40), r.choice([5, r.randrange(10**6)])) for _ in range(3000)] + [(0, 7)] * 900
    df = spark.createDataFrame(keys, "a long, b long").repartition(6, F.col("b") % 3)
    for wanted in (1, 2, 1000, 1999, len(keys)):
        assert resample.cutoff(df, wanted, len(keys), 10) == sorted(keys)[wanted - 1]
    assert resample.cutoff(df, 0, len(keys)) is None
    same = spark.createDataFrame([(1, 1)] * 500, "a long, b long")
    assert resample.cutoff(same, 77, 500, 1) == (1, 1)


def test_words_in_blocks():
    table = words.splitter(bytes([*range(0x21)]))
    for text in (b"", b" ", b"ab", b"a\tbc\x0bd  e", b"A" * 50 + b" b " * 9 + b"c" * 40):
        whole = [w for b in words.word_blocks(text, table) for w in b]
        for size in (1, 2, 7):
            assert [w for b in words.word_blocks(text, table, size) for w in b] == whole == text.lower().split()
