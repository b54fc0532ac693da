"""Document quality: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters look at six bytes at a time, at every place, and each filter's largest answer in
every chunk of 245 bytes (chunks overlap by the filters' width, and together they cover the whole document) is kept.
The chunks' maxima are averaged and combined into one probability by a small hidden layer and a logistic unit.

Embedding and filters are multiplied out before scoring: three tables, one for each pair of bytes in the window. A
document is walked through in blocks of chunks with a running sum, so its length doesn't matter to memory.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, held_out, map_arrow, slices, table

WIDTH = 6
CHUNK_STEPS = 240
#: Chunks that are scored, or trained on, at once.
BLOCK = 256
#: Bound of the training sample, in labelled documents; every chunk of a chosen document is trained on.
TRAIN_DOCS = 4000
#: Logarithm of the smallest and largest size of a passage, in bytes.
PASSAGE = (2.0, 4.5)
PASSAGE_WEIGHT = 0.05
THRESHOLD = 0.7


def pairs(data: bytes) -> np.ndarray:
    """Each byte with the one after it, as one number; zero bytes fill up to one window."""
    b = np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8)
    return b[:-1] | b[1:].astype(np.uint16) << np.uint16(8)


def blocks(data: bytes, chunks: int = BLOCK) -> Iterator[np.ndarray]:
    """The byte pairs of ``chunks`` chunks after each other; the last chunk may have fewer windows."""
    step = chunks * CHUNK_STEPS
    for start in range(0, max(len(data) - WIDTH, 0) + 1, step):
        yield pairs(data[start : start + step + WIDTH - 1])


def answers(tables: list[np.ndarray], pair: np.ndarray) -> np.ndarray:
    """Every filter's answer at every window."""
    n = len(pair) - WIDTH + 2
    got = tables[0].take(pair[:n], 0)
    got += tables[1].take(pair[2 : n + 2], 0)
    got += tables[2].take(pair[4 : n + 4], 0)
    return got


def pair_tables(single: np.ndarray) -> list[np.ndarray]:
    """From one table a byte (place, byte, filter) to one a pair of bytes."""
    return [(single[k + 1][:, None] + single[k][None]).reshape(1 << 16, -1) for k in range(0, WIDTH, 2)]


@dataclass
class Network:
    tables: list[np.ndarray]  # for each pair of the window: 65536 x filters
    bias: np.ndarray
    hidden: np.ndarray  # filters x units
    hidden_bias: np.ndarray
    weight: np.ndarray
    offset: float

    def score(self, data: bytes) -> float:
        total, count = np.zeros(len(self.bias)), 0
        for pair in blocks(data):
            got = answers(self.tables, pair)
            top = np.maximum.reduceat(got, np.arange(0, len(got), CHUNK_STEPS), 0).astype(np.float64) + self.bias
            total += np.maximum(top, 0).sum(0)
            count += len(top)
        z = float(np.maximum(total / count @ self.hidden + self.hidden_bias, 0) @ self.weight + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[bytes], labels: list[float], filters: int = 32, width: int = 8, units: int = 24, steps: int = 500, seed: int = 7) -> Network:
    """Fit by Adam on whole documents, and on a short passage of each beside it (few documents are short, and the
    largest answers of few windows are smaller ones). Without both labels, a network that says their mean."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    par = {
        "e": rng.normal(0, 0.5, (256, width)).astype(np.float32),
        "k": rng.normal(0, 0.35, (WIDTH, width, filters)).astype(np.float32),
        "b": np.zeros(filters, np.float32),
        "u": rng.normal(0, 0.3, (filters, units)).astype(np.float32),
        "v": np.zeros(units, np.float32),
        "w": rng.normal(0, 0.2, units).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    par["c"][0] = np.log(mean / (1 - mean))
    if len(set(labels)) < 2:
        par["w"][:] = 0
        steps = 0
    m1, m2, t = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}, 0
    # As many steps for few documents as for many: small samples are seen more often.
    epochs = -(-steps * 64 // max(len(y), 1))
    lane = np.arange(filters)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            docs = order[i : i + 64]
            single = np.einsum("be,pef->pbf", par["e"], par["k"])
            tables = pair_tables(single)
            # Of each chunk: its filters' largest answers, and the six bytes behind each of them.
            tops, behind, count = [], [], []
            drawn = [(len(texts[d]), int(np.exp(rng.uniform(*PASSAGE))), rng.random()) for d in docs]
            cut = [texts[d][int(u * max(n - m, 0)) :][:m] for d, (n, m, u) in zip(docs, drawn, strict=True)]
            for text in [*(texts[d] for d in docs), *cut]:
                n = 0
                for pair in blocks(text):
                    got = answers(tables, pair)
                    for s in range(0, len(got), CHUNK_STEPS):
                        at = got[s : s + CHUNK_STEPS].argmax(0) + s
                        tops.append(got[at, lane])
                        behind.append(pair[at[:, None] + np.arange(0, WIDTH, 2)])
                        n += 1
                count.append(n)
            count = np.array(count)
            top = np.array(tops) + par["b"]
            seen = np.array(behind).view(np.uint8).reshape(len(tops), filters, WIDTH)
            h = np.add.reduceat(np.maximum(top, 0), np.cumsum(count) - count, 0) / count[:, None]
            g = h @ par["u"] + par["v"]
            on = np.maximum(g, 0)
            p = 1 / (1 + np.exp(-(on @ par["w"] + par["c"])))
            dz = (p - np.tile(y[docs], 2)) * np.repeat((1.0, PASSAGE_WEIGHT), len(docs)) / len(docs)
            dg = dz[:, None] * par["w"] * (g > 0)
            grad = {"w": on.T @ dz + 1e-4 * par["w"], "c": dz.sum(keepdims=True), "u": h.T @ dg + 1e-4 * par["u"], "v": dg.sum(0)}
            dtop = np.repeat((dg @ par["u"].T) / count[:, None], count, 0) * (top > 0)
            grad["b"] = dtop.sum(0)
            dtab = np.stack([np.bincount((seen[:, :, q].astype(np.int64) * filters + lane).ravel(), dtop.ravel(), 256 * filters).reshape(256, filters) for q in range(WIDTH)])
            grad["k"] = np.einsum("be,pbf->pef", par["e"], dtab) + 1e-5 * par["k"]
            grad["e"] = np.einsum("pef,pbf->be", par["k"], dtab) + 1e-5 * par["e"]
            t += 1
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                par[k] = (par[k] - 0.015 * 0.05 ** (t / steps) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return Network(pair_tables(np.einsum("be,pef->pbf", par["e"], par["k"])), *(par[k].astype(np.float64) for k in "buvw"), float(par["c"][0]))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Network:
    """Network from labelled documents that aren't held out: the ``max_docs`` whose hashed ids come first, whole.

    Null ids and labels are left out; several labels of one id are averaged and an even split leaves it out; of
    several rows of one id the one with the least text counts. No labels, no documents, or one label only: a network
    that says the labels' mean, or one half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).dropna()
    known = known.where(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.avg("label").alias("label")).where("label != 0.5")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most max_docs rows of two numbers.
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return fit(as_bytes(rows["text"].combine_chunks()), [float(x > 0.5) for x in rows["label"].to_pylist()])


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each whole text; null is empty, and an empty text is one window of zero bytes.

    Texts of any length are read in blocks; repeated rows give repeated results; equal texts have equal scores (ties);
    other columns are not read; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(shared.value.score, as_bytes(b.column(1))), pa.float64())], ["doc_id", "score"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(kept, run, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and whether it reaches the threshold; learned from labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score at least the threshold stay, with all columns, whatever their names. Null texts
    are scored as empty; equal texts (ties, repeated rows) are judged alike; texts of any length are scored whole, in
    blocks; without labels of both kinds every score is the labels' mean; an empty table gives an empty table."""
    shared = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                yield b.filter(pa.array([shared.value.score(x) >= THRESHOLD for x in as_bytes(b.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
