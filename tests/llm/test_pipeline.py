"""The pipeline's stages: each works on what the one before kept."""
from collections import Counter

import pytest

pytest.importorskip("contactforge.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from contactforge.llm import langid, mixing, quality, wordcopies  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    a = stages["language"](spark, docs, SMALL).cache()
    model = langid.train_on(docs)
    assert sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in docs.collect() if langid.accepted(model, r.text, r.lang))
    assert 0.98 * docs.count() < a.count()
    b = stages["quality"](spark, a, SMALL).cache()
    net = quality.train(a, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert sorted(r.doc_id for r in b.collect()) == sorted(r.doc_id for r in a.collect() if net.score(r.text.encode()) >= quality.THRESHOLD)
    c = stages["near_copies"](spark, b, SMALL).cache()
    assert sorted(r.doc_id for r in c.collect()) == sorted({r.component_id for r in wordcopies.group(b).collect()})
    d = stages["mixing"](spark, c, SMALL).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(c).collect()}
    assert Counter(r.doc_id for r in d.collect()) == Counter({k: v for k, v in copies.items() if v})
    for df in (a, b, c, d):
        assert df.columns == columns
    e = stages["encoding"](spark, d, SMALL).collect()
    assert len(e) == d.count() and all(r.round_trip for r in e)


def test_awkward_rows(spark):
    """Nulls, repeated rows, an empty table, and further columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, its string, whole long, target double, component_id long, fp string"
    texts = ["plain words of a text that is not short at all number %d" % i for i in range(30)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 5, 0.1, "x", 1, 2.0, 3, "y") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], None, None, None, None, None, None, None, None, None), (99, None, "en", "s", 0, None, None, None, None, None, None), (98, "", "en", "s", 0, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, SMALL)
    assert kept.count() == len(rows) - 2 and kept.columns == docs.columns
    assert stages["quality"](spark, docs, SMALL).columns == docs.columns
    one = stages["near_copies"](spark, docs, SMALL)
    ids = [r.doc_id for r in one.collect()]
    groups = {r.component_id for r in wordcopies.group(docs).collect() if r.doc_id is not None}
    assert one.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(groups) and ids.count(None) == 1
    mixed = stages["mixing"](spark, docs, SMALL)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert all(r.round_trip for r in stages["encoding"](spark, docs, SMALL).collect())
    for name in ("language", "quality", "near_copies", "mixing", "encoding"):
        assert stages[name](spark, docs.limit(0), SMALL).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
    assert spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).count() == 0
