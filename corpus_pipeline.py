"""From raw documents to tokens: language, quality, near copies, mixing, token ids. Each stage is a written table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactforge.llm import bpe, langid, mixing, neardup, quality
from contactforge.llm.common import discard, settled, table


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: token ids of every document left, with the digests and whether decoding gives the text back. Null texts
    are empty and have no ids; equal texts and repeated rows have equal ids; texts of any length are encoded whole, in
    blocks of pieces; columns beside id and text aren't read; an empty table gives an empty table."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("language", langid.accept_language),
    ("quality", quality.accept_quality),
    ("near_copies", neardup.keep_one),
    ("mixing", mixing.mix_stage),
    ("encoding", encode),
]

#: Trained models and tokenisation have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is deleted after it, and its own result after the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = settled(lambda s=stage, d=before: s(spark, d, sf_dir), spark)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
