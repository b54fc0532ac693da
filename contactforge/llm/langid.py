"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, hashed bigram or trigram) are gathered over all training rows by partial sums in each
partition; their size is languages x buckets whatever the input's size. The log-probability matrix is broadcast and
whole texts are scored in numpy from their sparse n-gram counts.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, released, slices, table

BUCKET_BITS = 14
#: The broadcast matrix has this many columns at most; more languages raise ValueError.
MAX_LANGUAGES = 128
_letter = regex.compile(r"\p{L}").search


#: Characters whose n-grams are counted at once.
BLOCK = 1 << 18


def ngram_buckets(text: str) -> np.ndarray:
    """Hashed character bigrams and trigrams that begin in a lower-cased text; its last two characters begin none of
    their own if they were put there to complete the others (see ``ngram_counts``)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Runs of other ASCII characters tell nothing about the language.
    c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:]
    out = np.concatenate([two, three])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x27D4EB2F)
    return out >> np.uint32(32 - BUCKET_BITS)


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the text with a blank at each end; long texts are walked through in blocks."""
    text = f" {text.lower()} "
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for start in range(0, len(text), BLOCK):
        part = text[start : start + BLOCK + 2]
        if len(part) < 2:
            break
        found = ngram_buckets(part)
        if len(part) == BLOCK + 2:
            # The bigram of the two added characters begins in the next block.
            found = np.delete(found, BLOCK)
        counts += np.bincount(found, minlength=1 << BUCKET_BITS)
    return counts


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, its posterior probability, and how much better it explains an n-gram than chance does (mean of
        the log ratio to even buckets; -inf for ``und``)."""
        if text is None or not self.languages or not _letter(text):
            return "und", 0.0, -np.inf
        counts = ngram_counts(text)
        used = np.flatnonzero(counts)
        total = self.prior + counts[used] @ self.log_prob[used]
        best = int(total.argmax())  # ties: the first language in code point order
        gain = float((total[best] - self.prior[best]) / counts[used].sum() + np.log(1 << BUCKET_BITS))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum()), gain

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    size = 1 << BUCKET_BITS
    for whole in batches:
        for b in slices(whole, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = sums.setdefault(lang, np.zeros(size + 1, np.int64))
                held[:size] += ngram_counts(text)
                held[size] += 1
    for lang, held in sums.items():
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(held[used], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from all rows whose text and language are not null (texts without letters count for the prior only by
    their blanks). No such row: a model without languages, which answers ``und``."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    found = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counted = map_arrow(rows, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, size = sorted(set(counted["lang"].to_pylist())), 1 << BUCKET_BITS
    counts = np.zeros((size + 1, len(names)))
    at = {x: i for i, x in enumerate(names)}
    counts[counted["bucket"].to_numpy(), [at[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    if not names:
        return Model([], np.zeros((size, 0)), np.zeros(0))
    smooth = counts[:size] + 0.1
    return Model(names, np.log(smooth / smooth.sum(0)), np.log(counts[size] / counts[size].sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (posterior probability) of each whole text, then the columns named in ``keep``.

    Null texts and texts without a letter: ``und`` with score 0. Ties: the smaller language. Texts of any length are
    counted in blocks. Repeated rows: repeated results. Columns that aren't named are not read; an empty table gives
    an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                lang, score = zip(*map(shared.value.predict, b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *b.columns[2:]], ["doc_id", "lang_pred", "score", *(f"k{i}" for i in range(len(keep)))])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    schema = "doc_id long, lang_pred string, score double" + "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return map_arrow(kept, run, schema)


def train_on(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id"), 3, 1)))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train_on(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


#: The stage's rule: least mean gain over chance, and how sure a contradiction of the document's own ``lang`` must be.
LEAST_GAIN = 0.0
CONTRADICTS = 0.99


def accepted(model: Model, text: str | None, lang: str | None) -> bool:
    """Whether a document stays: its text has a language, that language explains the text better than chance does
    (texts in a language that was never learned, and random letters, are explained worse), and the classifier isn't
    sure of another language than the one that the document claims, if that is one it knows."""
    found, score, gain = model.judge(text)
    if found == "und" or not gain > LEAST_GAIN:
        return False
    return not (lang in model.languages and lang != found and score >= CONTRADICTS)


def accept_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language the classifier rejects go (see ``accepted``); all others stay, with all
    columns. Where no row has a language to learn from, every document stays. Null and empty texts go; repeated rows
    are judged alike; texts of any length are counted whole; an empty table gives an empty table."""
    model = train_on(docs)
    if not model.languages:
        return docs
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at, claimed = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()  # of a pipeline's run before this one
        for whole in batches:
            for b in slices(whole, at):
                keep = [accepted(shared.value, x, y) for x, y in zip(b.column(at).to_pylist(), b.column(claimed).to_pylist(), strict=True)]
                yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
