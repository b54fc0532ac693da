"""The pipeline's near copies get candidates from SimHash and vantage-point trees too."""
import pytest
from pyspark.sql import functions as F

wordcopies = pytest.importorskip("contactforge.llm.wordcopies")
from contactforge.llm import neardup  # noqa: E402


def test_trees_give_candidates(spark, monkeypatch):
    """Without any bucket in common, texts whose fingerprints lie within the radius are still found and counted; of two texts
    with one fingerprint but few shingles in common none is a copy."""
    long = [f"{t}w{k % 97}x{k}" for t in "ab" for k in range(3000)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), "one two three four five six", "six seven eight nine ten eleven", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [neardup.fingerprint((t or "").encode()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= neardup.BITS_APART
    monkeypatch.setattr(wordcopies, "neighbours", lambda rows, *order: rows.select(F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b")).limit(0))
    got = {r.doc_id: r.component_id for r in wordcopies.group(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
