"""Byte-level BPE by a lazily determinised transducer; streaming decode by an incremental UTF-8 machine.

Encoding. Let a *valid pair* be two tokens whose joined bytes are merged into just these two tokens. A token sequence
is the result of rank-ordered merging if and only if all its neighbours are valid pairs (the first merge across a
boundary would show up in that pair alone), so each prefix of a piece has exactly one last token. The transducer
reads bytes and holds every open hypothesis (token before, place in the token trie, tokens not yet written). What
all hypotheses agree upon is written at once, so the delay is bounded by the longest token's lookahead. Sets of
hypotheses become states, and moves between states are kept when first met. Time is linear in the piece's length.
"""
from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, kept_between_tasks, map_arrow, slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Pieces to token ids. ``max_states`` bounds the kept states; beyond it they are dropped and found again."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks, self.bytes_of, self.max_states = ranks, {v: k for k, v in ranks.items()}, max_states
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, rank in ranks.items():
            at = 0
            for b in token:
                nxt = self.trie.get(at << 8 | b)
                if nxt is None:
                    nxt = self.trie[at << 8 | b] = nodes
                    nodes += 1
                at = nxt
            self.token_at[at] = rank
        self.inner = {key >> 8 for key in self.trie}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list | None] = {}
        self._reset()

    def _reset(self):
        start = (((), -1, 0),)
        self.states, self.ids, self.moves, self.ends = [start], {start: 0}, {}, [()]

    def merges(self, data: bytes) -> list[tuple[float, bytes, bytes]]:
        """Rank-ordered merging of one token's bytes: the next rank, the first and the last part, before each merge
        and at the end."""
        parts, seen = [data[i : i + 1] for i in range(len(data))], []
        while True:
            at, best = -1, float("inf")
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], best)
                if r < best:
                    at, best = i, r
            seen.append((best, parts[0], parts[-1]))
            if at < 0:
                return seen
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def history(self, token: int) -> list[tuple[float, bytes, bytes]] | None:
        """The token's merges, or None where merging its bytes doesn't end in the token."""
        if token not in self.histories:
            data = self.bytes_of[token]
            seen = self.merges(data)
            self.histories[token] = seen if seen[-1][1] == data else None
        return self.histories[token]

    def valid(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: can be first). Both tokens' merges run in the order in which
        merging would take them, and none of them may be preceded by a merge across the boundary."""
        got = self.pairs.get(before << 20 | token)
        if got is not None:
            return got
        right = self.history(token)
        if right is None:
            ok = False
        elif before < 0:
            ok = True
        else:
            left, i, j, ok = self.history(before), 0, 0, True
            while ok:
                a, b = left[i], right[j]
                across = self.ranks.get(a[2] + b[1])
                if across is not None and across < a[0] and across <= b[0]:
                    ok = False
                elif a[0] <= b[0]:
                    if i + 1 == len(left):
                        break
                    i += 1
                else:
                    j += 1
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[before << 20 | token] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        kept, done = [], None
        for pending, before, node in self.states[state]:
            nxt = self.trie.get(node << 8 | byte)
            if nxt is None:
                continue
            if nxt in self.inner:
                kept.append((pending, before, nxt))
            token = self.token_at.get(nxt, -1)
            if token >= 0 and done is None and self.valid(before, token):
                done = ((*pending, token), token, 0)
        kept.append(done)
        agreed = kept[0][0]
        for x, _, _ in kept:
            if not agreed:
                break
            n = 0
            while n < min(len(agreed), len(x)) and x[n] == agreed[n]:
                n += 1
            agreed = agreed[:n]
        shorter = tuple((x[len(agreed) :], before, node) for x, before, node in kept) if agreed else tuple(kept)
        to = self.ids.get(shorter)
        if to is None:
            to = self.ids[shorter] = len(self.states)
            self.states.append(shorter)
            self.ends.append(shorter[-1][0])
        self.moves[state << 8 | byte] = found = (to, agreed)
        return found

    def encode(self, piece: bytes) -> array:
        """Ids of one piece, 32 bits each. A piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return array("I", (whole,))
        if len(self.states) > self.max_states:
            self._reset()
        out, state, moves = array("I"), 0, self.moves
        for b in piece:
            found = moves.get(state << 8 | b) or self._move(state, b)
            state = found[0]
            if found[1]:
                out.extend(found[1])
        out.extend(self.ends[state])
        return out


class PieceCache(dict):
    """Piece -> its ids as little-endian 32-bit integers; emptied when it holds ``most`` pieces."""

    def __init__(self, transducer: Transducer, most: int = 800_000):
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        got = np.asarray(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) > 64:
            return got
        if len(self) >= self.most:
            self.clear()
        self[piece] = got
        return got


#: State 0: between characters. Others: (lowest, highest) for the next byte, then the state after it.
def _utf8_machine() -> list[dict[int, int]]:
    states: list[dict[int, int]] = [{} for _ in range(8)]
    tail = range(0x80, 0xC0)
    for b in range(0x80):
        states[0][b] = 0
    for b in range(0xC2, 0xE0):
        states[0][b] = 1
    for b in range(0xE0, 0xF0):
        states[0][b] = {0xE0: 4, 0xED: 5}.get(b, 2)
    for b in range(0xF0, 0xF5):
        states[0][b] = {0xF0: 6, 0xF4: 7}.get(b, 3)
    for state, to, allowed in ((1, 0, tail), (2, 1, tail), (3, 2, tail), (4, 1, range(0xA0, 0xC0)), (5, 1, range(0x80, 0xA0)), (6, 2, range(0x90, 0xC0)), (7, 2, range(0x80, 0x90))):
        for b in allowed:
            states[state][b] = to
    return states


class StreamDecoder:
    """Ids in, text out as soon as characters are whole. Bytes that are not UTF-8 become U+FFFD, one for each
    longest run that could have begun a character."""

    MACHINE = _utf8_machine()

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.known: dict[tuple[int, bytes, int], tuple[str, int, bytes]] = {}
        self.whole: dict[int, str] = {}
        for token, data in bytes_of.items():
            text, state, _ = self._run(0, b"", data)
            if state == 0 and text.encode() == data:
                self.whole[token] = text
        self.restart()

    def restart(self):
        self.state, self.held = 0, b""

    def _run(self, state: int, held: bytes, data: bytes) -> tuple[str, int, bytes]:
        out = []
        for b in data:
            to = self.MACHINE[state].get(b)
            if to is None and state:
                out.append("�")
                state, held = 0, b""
                to = self.MACHINE[0].get(b)
            if to is None:
                out.append("�")
                continue
            held += bytes([b])
            state = to
            if not state:
                out.append(held.decode())
                held = b""
        return "".join(out), state, held

    def feed(self, token: int) -> str:
        key = (self.state, self.held, token)
        found = self.known.get(key)
        if found is None:
            found = self._run(self.state, self.held, self.bytes_of[token])
            if len(self.known) < 500_000:
                self.known[key] = found
        self.state, self.held = found[1], found[2]
        return found[0]

    def finish(self) -> str:
        rest = "�" if self.state else ""
        self.restart()
        return rest

    def more(self, ids) -> str:
        """Text of the next ids; tokens of whole characters between characters need no state."""
        parts = list(map(self.whole.get, ids)) if not self.state else [None]
        if None in parts:
            parts = map(self.feed, ids)
        return "".join(parts)

    def decode(self, ids) -> str:
        """All ids at once."""
        self.restart()
        return self.more(ids) + self.finish()


_coders: dict[str, tuple] = kept_between_tasks()


def coder(data: bytes, pattern: str) -> tuple:
    """(splitter, piece cache, decoder) of a vocabulary file, built once in each Python process."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        # In rank files' own library \s is the Unicode property; here it would also take U+001C to U+001F.
        split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        machine = Transducer(read_ranks(data))
        _coders[key] = (split, PieceCache(machine), StreamDecoder(machine.bytes_of))
    return _coders[key]


#: Characters above which a text is split, encoded and decoded in blocks of pieces, and pieces in a block.
LONG, PIECES = 1 << 18, 1 << 15


def blocks(split, text: str) -> Iterator[list[str]]:
    """The text's pieces, in one list or, for long texts, in bounded ones (the splitter sees the whole text)."""
    if len(text) <= LONG:
        yield split.findall(text)
        return
    found = (m[0] for m in split.finditer(text))
    while held := list(islice(found, PIECES)):
        yield held


def code(split, pieces: PieceCache, decoder: StreamDecoder, raw: bytes, sink=None) -> tuple[int, str, str, bool]:
    """(tokens, SHA-256 of the ids, SHA-256 of the decoded bytes, whether these are ``raw``) of one text. Ids and decoded
    bytes are hashed as they come; ``sink`` gets the ids' bytes."""
    n, at, same = 0, 0, True
    ids, back = hashlib.sha256(), hashlib.sha256()
    decoder.restart()
    for held in blocks(split, raw.decode()):
        coded = b"".join(map(pieces.__getitem__, held))
        for start in range(0, len(coded), 1 << 20):
            part = coded[start : start + (1 << 20)]
            text = decoder.more(np.frombuffer(part, "<u4").tolist()).encode()
            back.update(text)
            same = same and raw.startswith(text, at)
            at += len(text)
        ids.update(coded)
        n += len(coded) // 4
        if sink is not None:
            sink.append(coded)
    rest = decoder.finish().encode()
    back.update(rest)
    return n, ids.hexdigest(), back.hexdigest(), same and raw.startswith(rest, at) and at + len(rest) == len(raw)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip of each text; with ``ids`` also the ids themselves.

    ``vocabulary`` is a rank file's path on the driver; its bytes (a size fixed by the vocabulary) are broadcast.
    Null and empty texts have no ids; repeated rows give repeated rows; long texts go through in blocks of pieces, so
    that memory is a few times the text (and its ids, where they are asked for); ties can't occur (ranks are
    distinct); other columns are not read; an empty table gives an empty table.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, decoder = coder(data.value, pattern)
        for whole in batches:
            for b in slices(whole, 1):
                texts = as_bytes(b.column(1))
                kept = [[] if ids else None for _ in texts]
                n, a, d, same = zip(*(code(split, pieces, decoder, raw, k) for raw, k in zip(texts, kept, strict=True)), strict=True)
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if ids:
                    flat = np.frombuffer(b"".join(x for k in kept for x in k), "<u4").astype(np.int32, copy=False)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(kept, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def decode_ids(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: token ids back to text by the streaming decoder; null ids give null text, no ids empty text."""
    with open(vocabulary, "rb") as f:
        data = coded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(data.value, "")[2]
        for b in batches:
            texts = [None if x is None else decoder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and decoded bytes, as digests."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
