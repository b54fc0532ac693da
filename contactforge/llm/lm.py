"""Scores of texts under a log-bilinear language model that is trained by noise-contrastive estimation.

Word counts of the whole training corpus are gathered by shuffle. The model predicts *units*: the most frequent words, the
end of a text, and classes of all other words by their last two bytes; within a class a word has the share of its count, and
what was never counted has half a count of its class. A unit is predicted from the two units before it by the product of
their transformed vectors with its own, plus its bias.

Training runs in rounds of Spark tasks: each task follows its own part of the corpus in batches that share their noise
words, and the rounds' parameters are averaged by tokens. As the score is linear in each of the two units before, the
normalisers of all pairs of them are one matrix product, so each token's log-probability is exact and three lookups.
"""
from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, held_out, map_arrow, slices, stash, table
from .words import splitter, word_blocks

#: Units of frequent words (with the end of a text), of classes, and the width of vectors.
FREQUENT, CLASSES, WIDTH = 512, 256, 16
UNITS = FREQUENT + CLASSES
END, START = 0, UNITS
#: Words whose counts are shared with every task; the others' counts are joined by shuffle.
LISTED = 1 << 16
#: Examples of a batch (a thousandth of the corpus, within these), its noise words, and the step size.
LEAST_BATCH, BATCH, NOISE, STEP = 256, 2048, 32, 0.15
#: Rounds, and the tokens that they see in all where the corpus is small (so many rounds at most).
ROUNDS, MOST_ROUNDS, ROUND_TOKENS = 4, 16, 2_000_000
SPLIT = splitter(bytes(range(9, 14)))
_LONG, _HELD = 64, 200_000


def key(word: bytes) -> bytes:
    """A word as it is counted: long ones by their digest behind a blank, which no word has."""
    return word if len(word) <= _LONG else b" " + hashlib.sha256(word).digest()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


# --- counts ---------------------------------------------------------------------------------------------------------------

def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        words = list(held)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    for whole in batches:
        for b in slices(whole, 0):
            for text in as_bytes(b.column(0)):
                for words in word_blocks(text, SPLIT):
                    held.update(words if max(map(len, words), default=0) <= _LONG else map(key, words))
                    if len(held) >= _HELD:
                        yield out()
                        held.clear()
    if held:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of the texts, as a written table."""
    return stash(map_arrow(texts.select(F.col("text").cast("string").alias("text")), _words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))


@dataclass
class Lexicon:
    """What every task knows of the corpus: listed words with unit and logarithms, sums of the classes, totals."""

    words: dict[bytes, int]
    unit: np.ndarray  # of each listed word
    own: np.ndarray  # log10 of count + 1/2 of each listed word
    inside: np.ndarray  # log10 of a listed word's share in its class; 0 for a frequent one
    classes: np.ndarray  # log10 of each class's sum
    units: np.ndarray  # tokens of each unit
    tokens: int
    ends: int
    norm: float  # log10 of the base's denominator
    least: int  # words that are counted so often are listed


def lexicon(counts: DataFrame, texts: int, listed: int = LISTED) -> Lexicon:
    """``texts`` training texts had these word counts. Counts come to the driver as a histogram by eighths of powers of two,
    sums of classes, and at most ``listed`` words with the highest counts."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    tokens, types = texts + sum(r["c"] for r in levels), (texts > 0) + sum(r["types"] for r in levels)
    room, least = listed, 1 << 62
    for r in levels:
        room -= r["types"]
        if room < 0:
            break
        least = r["least"]
    got = counts.where(F.col("c") >= least).toArrow()
    ranked = sorted(zip(got["c"].to_pylist(), got["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    c = np.array([x[0] for x in ranked], np.int64)
    last = F.substring("word", F.greatest(F.length("word") - 1, F.lit(1)), F.lit(2))
    sums = np.full(CLASSES, 0.5)  # what was never counted
    whole = np.zeros(CLASSES, np.int64)
    for r in counts.groupBy((F.crc32(last) % CLASSES).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect():
        whole[r["k"]] = r["c"]
        sums[r["k"]] += r["c"] + 0.5 * r["types"]
    frequent = min(FREQUENT - 1, len(ranked))
    own_class = np.array([class_of(w) for _, w in ranked], np.int64)
    np.subtract.at(whole, own_class[:frequent], c[:frequent])
    np.subtract.at(sums, own_class[:frequent], c[:frequent] + 0.5)
    unit = np.where(np.arange(len(c)) < frequent, np.arange(len(c)) + 1, FREQUENT + own_class).astype(np.uint16)
    own = np.log10(c + 0.5)
    inside = np.where(np.arange(len(c)) < frequent, 0.0, own - np.log10(sums)[own_class])
    units = np.concatenate([[texts], c[:frequent], np.zeros(FREQUENT - 1 - frequent, np.int64), whole])
    return Lexicon({w: i for i, (_, w) in enumerate(ranked)}, unit, own, inside, np.log10(sums), units, tokens, texts, float(np.log10(tokens + 0.5 * (types + 1))), least)


class _Index(dict):
    """Place in the list; of other words, -1 - class."""

    def __missing__(self, word: bytes) -> int:
        counted = key(word)
        return self.get(counted, -1 - class_of(counted))


BLOCK_SCHEMA = "k long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, ids binary, rare array<struct<word:binary,n:long>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def encoded(docs: DataFrame, held, lex: Lexicon) -> DataFrame:
    """Texts as blocks of unit ids (16 bits), each with the two ids before it, what its listed words add to the base
    and to the shares within classes, and its other words with how often they stand there; as a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, index = shared.value, _Index(shared.value.words)
        end = float(np.log10(lex.ends + 0.5))
        for whole in batches:
            for b in slices(whole, 3, 1 << 20):
                out = []
                for k, doc_id, held, text in zip(*(b.column(i).to_pylist() for i in range(3)), as_bytes(b.column(3)), strict=True):
                    before, blocks = np.array([START, START], np.uint16), 0
                    for words in word_blocks(text, SPLIT):
                        if blocks:  # a long text: what is complete goes
                            yield rows(out)
                            out = []
                        out.append([k, doc_id, held, *block(lex, index, words, before)])
                        before, blocks = np.concatenate([before, out[-1][-1][0]])[-2:], blocks + 1
                    if not blocks:
                        out.append([k, doc_id, held, 0, 0, 0.0, 0.0, {}, (np.zeros(0, np.uint16), before)])
                    # The end belongs to the last block.
                    last = out[-1]
                    last[3], last[4], last[5] = last[3] + 1, last[4] + (lex.ends > 0), last[5] + end - lex.norm
                    last[8] = (np.append(last[8][0], np.uint16(END)), last[8][1])
                if out:
                    yield rows(out)

    def block(lex: Lexicon, index: _Index, words: list[bytes], before: np.ndarray) -> list:
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        listed = at >= 0
        there, other = at[listed], -1 - at[~listed]
        ids = np.empty(len(at), np.uint16)
        ids[listed], ids[~listed] = lex.unit[there], FREQUENT + other
        rare = Counter(key(words[i]) for i in np.flatnonzero(~listed))
        return [len(at), len(there), float(lex.own[there].sum()) - len(at) * lex.norm, float(lex.inside[there].sum() - lex.classes[other].sum()), rare, (ids, before)]

    def rows(out: list) -> pa.RecordBatch:
        plain = list(zip(*(x[:7] for x in out), strict=True))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        ids = pa.array([np.concatenate([before, ids]).tobytes() for *_, (ids, before) in out], pa.binary())
        rare = pa.array([[{"word": w, "n": n} for w, n in x[7].items()] for x in out], _RARE)
        names = ["k", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids", "rare"]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, kinds, strict=True)), ids, rare], names)

    # Where the rows of one text meet again; the numbers stand in the written table.
    numbers = docs.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return stash(map_arrow(numbers, run, BLOCK_SCHEMA))


# --- model ----------------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """Vectors of the units before (with one for the start), a map for either place, vectors and biases of the unit
    to come, and the sums of squared steps that go with each row of them."""

    before: np.ndarray  # UNITS + 1 x WIDTH
    maps: np.ndarray  # 2 WIDTH x WIDTH
    after: np.ndarray  # UNITS x WIDTH
    bias: np.ndarray
    squares: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.before, self.maps, self.after, self.bias, self.squares)])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        sizes = [(UNITS + 1, WIDTH), (2 * WIDTH, WIDTH), (UNITS, WIDTH), (UNITS,), (UNITS + 1 + 2 * WIDTH + 2 * UNITS,)]
        ends = np.cumsum([int(np.prod(s)) for s in sizes])
        return Model(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), sizes, strict=True)))

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms: what either unit before adds to each unit to come, less the normaliser of both: the score of
        (u, v, w) is first[u, w] + second[v, w] - norm[u, v], given as (first and second in one, norm)."""
        first = self.before.astype(np.float64) @ self.maps[:WIDTH] @ self.after.T + self.bias
        second = self.before.astype(np.float64) @ self.maps[WIDTH:] @ self.after.T
        tops = first.max(1, keepdims=True), second.max(1, keepdims=True)
        norm = np.log(np.exp(first - tops[0]) @ np.exp(second - tops[1]).T) + tops[0] + tops[1].T
        return np.stack([first, second]), norm


def noise_shares(units: np.ndarray) -> np.ndarray:
    return (units + 1) / (units + 1).sum()


def beginning(units: np.ndarray, seed: int = 12) -> Model:
    """Biases that give each unit its share, and vectors that say nothing yet."""
    rng = np.random.default_rng(seed)
    return Model(
        rng.normal(0, 0.3, (UNITS + 1, WIDTH)).astype(np.float32), rng.normal(0, 0.3 / WIDTH**0.5, (2 * WIDTH, WIDTH)).astype(np.float32),
        rng.normal(0, 0.01, (UNITS, WIDTH)).astype(np.float32), np.log(noise_shares(units)).astype(np.float32), np.full(UNITS + 1 + 2 * WIDTH + 2 * UNITS, 0.01, np.float32),
    )


def _stepped(rows: np.ndarray, squares: np.ndarray, at: np.ndarray, slope: np.ndarray) -> None:
    """One step up the slopes of the rows named in ``at``, scaled by all squared steps of each row so far."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    total, at = np.add.reduceat(slope[order], starts, 0), at[starts]
    squares[at] += (total * total).reshape(len(at), -1).mean(1)
    scale = STEP / np.sqrt(squares[at])
    rows[at] += total * (scale if total.ndim == 1 else scale[:, None])


def learn(m: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray, shares: np.ndarray, rng: np.random.Generator, batch: int = BATCH) -> None:
    """Noise-contrastive steps over the examples (u, v before w): each tells its own word from all noise words of
    the batch, which are drawn by ``shares``."""
    log_noise, upto = (np.log(shares) + np.log(NOISE)).astype(np.float32), np.cumsum(shares)
    parts = np.split(m.squares, np.cumsum([UNITS + 1, 2 * WIDTH, UNITS]))
    steps = -(-len(w) // batch)
    for s in range(steps):
        x, y = np.concatenate([u[s::steps], v[s::steps]]), w[s::steps]
        drawn = np.minimum(np.searchsorted(upto, rng.random(NOISE)), UNITS - 1).astype(np.uint16)
        near = np.hstack(np.split(m.before[x], 2))
        h, own, other = near @ m.maps, m.after[y], m.after[drawn]
        right = np.einsum("ij,ij->i", h, own) + m.bias[y] - log_noise[y]
        wrong = h @ other.T + (m.bias[drawn] - log_noise[drawn])
        g = 1 / (1 + np.exp(np.clip(right, -30, 30)))
        n = -1 / (1 + np.exp(np.clip(-wrong, -30, 30)))
        dh = g[:, None] * own + n @ other
        back = dh @ m.maps.T
        slope = near.T @ dh
        _stepped(m.after, parts[2], np.concatenate([y, drawn]), np.concatenate([g[:, None] * h, n.T @ h]))
        _stepped(m.bias, parts[3], np.concatenate([y, drawn]), np.concatenate([g, n.sum(0)]))
        _stepped(m.before, parts[0], x, np.concatenate([back[:, :WIDTH], back[:, WIDTH:]]))
        parts[1] += (slope * slope).mean(1)
        m.maps += slope * (STEP / np.sqrt(parts[1]))[:, None]


def examples(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units two before, one before, and to come, of the blocks of a batch."""
    ids = [np.frombuffer(x, np.uint16) for x in cells.to_pylist()]
    return np.concatenate([x[:-2] for x in ids]), np.concatenate([x[1:-1] for x in ids]), np.concatenate([x[2:] for x in ids])


def train(blocks: DataFrame, lex: Lexicon) -> Model:
    """Rounds of steps over all blocks that aren't held out: small corpora are read in every round, of large ones each
    round reads another part, so that all is read. A task's parameters are a bounded array, and averages are weighted by
    tokens."""
    spark, shares = blocks.sparkSession, noise_shares(lex.units)
    model = beginning(lex.units)
    if not lex.tokens:
        return model
    parts = min(ROUNDS, max(1, lex.tokens // ROUND_TOKENS))
    rounds = min(MOST_ROUNDS, max(ROUNDS, ROUNDS * ROUND_TOKENS // lex.tokens))
    batch = min(BATCH, max(LEAST_BATCH, lex.tokens // 1000))
    kept = blocks.where("NOT held_out")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, shares))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            (start, shares), seen, rng = shared.value, 0, np.random.default_rng(r)
            own = Model.of(start.flat())
            for b in batches:
                if b.num_rows:
                    u, v, w = examples(b.column(0))
                    learn(own, u, v, w, shares, rng, batch)
                    seen += len(w)
            if seen:
                flat = np.append(own.flat().astype(np.float64), 1.0) * seen
                yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "x"])

        mine = kept.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == r % parts).select("ids")
        got = map_arrow(mine, run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow().sort_by("i")["x"].to_numpy()
        if len(got):
            model = Model.of(got[:-1] / got[-1])
        shared.destroy()
    return model


def scored(blocks: DataFrame, model: Model) -> DataFrame:
    """Adds units: log10 of the model's probability of a block's units."""
    shared = blocks.sparkSession.sparkContext.broadcast(model.log_probabilities())
    names = [c for c in blocks.columns if c not in ("ids", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second), norm = shared.value
        for b in batches:
            if b.num_rows:
                u, v, w = examples(b.column(0))
                each = first[u, w] + second[v, w] - norm[u, v]
                sizes = [len(x) // 2 - 2 for x in b.column(0).to_pylist()]
                units = [float(x.sum()) / np.log(10) for x in np.split(each, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(units, pa.float64())], [*names, "units"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return map_arrow(blocks.select("ids", *names), run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", units double")


def score_texts(docs: DataFrame, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``held`` says which rows (doc_id, text) take no part in the counts and in training. Null and empty texts have one
    token, their end. Repeated rows, and rows with one id or a null one, are texts of their own; equal texts have equal
    scores. Words and texts of any length are read whole, in blocks. Words that were never counted have count 0; where
    nothing is learned from, each token's base is 1 and units are even. Ties of counts go to the smaller word (digest of a long one). Other
    columns are not read; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    learned = docs.where(~held)
    counts = word_counts(learned)
    lex = lexicon(counts, learned.select("doc_id").count())
    blocks = encoded(docs, held, lex)
    done = scored(blocks, train(blocks, lex))
    rare = blocks.select("k", F.explode("rare").alias("r")).select("k", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    met = rare.join(counts.where(F.col("c") < lex.least), "word", "left")
    # What the list left open: the logarithm of the count itself, in the base and within the class alike.
    more = met.groupBy("k").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("open"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"))
    parts = done.select("k", "doc_id", "held_out", "n_tokens", "n_known", "base", (F.col("inside") + F.col("units")).alias("score")).unionByName(more.select("k", "n_known", F.col("open").alias("base"), F.col("open").alias("score")), allowMissingColumns=True)
    whole = parts.groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the model of those that aren't held out, beside its words' own."""
    return score_texts(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1))
