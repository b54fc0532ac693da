"""Media columns: payloads kept as baseline JPEG files and read back as DC-only luminance thumbnails.

Storage. A payload is cut into rows of 64 samples. Each sample becomes one 8x8 block whose only coefficient is
the DC term, quantised by 8, so that its value is ``sample - 128`` and the DC-only thumbnail (one pixel a block)
is the payload itself, without loss. A restart marker ends each row; rows can therefore be decoded side by side.
A JPEG holds 8191 rows at most, so longer payloads become several files one after another in the same cell.

Reading. ``decode_thumbnails`` parses the markers of any baseline (SOF0) file, Huffman-decodes its scans in numpy
with one lane for each restart interval, skips the AC terms and rebuilds the luminance DC plane.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_bytes, map_arrow, slices, stash, table

ROW = 64
MAX_ROWS = 8191
# The luminance tables K.3 and K.5 of the JPEG standard; the AC table is cut to the end-of-block code.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
AC_COUNTS = [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
AC_SYMBOLS = [0]


def canonical(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of a canonical Huffman table."""
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@cache
def _head() -> tuple[bytes, bytes]:
    """What stands before and after the height in our files."""
    quant = _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63)
    before = b"\xff\xd8" + quant + b"\xff\xc0\x00\x0b\x08"
    after = (ROW * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    after += _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
    after += _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    return before, after


@cache
def _bit_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each DC difference -255..255 with its end-of-block code, then 0 to 7 filling ones; which of the
    places are used; how many."""
    dc, (eob, eob_len) = canonical(DC_COUNTS, DC_SYMBOLS), canonical(AC_COUNTS, AC_SYMBOLS)[0]
    texts = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        extra = format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else ""
        texts.append(format(code, f"0{length}b") + extra + format(eob, f"0{eob_len}b"))
    texts += ["1" * n for n in range(8)]
    width = max(map(len, texts))
    bits = np.array([[int(c) for c in t.ljust(width, "0")] for t in texts], np.uint8)
    lengths = np.array([len(t) for t in texts], np.int32)
    return bits, np.arange(width) < lengths[:, None], lengths


def _entropy_rows(rows: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of sample rows, each ended by its restart or end marker, and the end offset of each row."""
    bits, used, lengths = _bit_table()
    values = rows.astype(np.int16) - 128
    step = np.empty((len(rows), ROW + 1), np.int32)
    step[:, 0] = values[:, 0]
    step[:, 1:ROW] = values[:, 1:] - values[:, :-1]
    step[:, :ROW] += 255
    total = lengths[step[:, :ROW]].sum(1)
    step[:, ROW] = 511 + (-total) % 8
    packed = np.packbits(bits.take(step, 0)[used.take(step, 0)])
    size = (total + 7) // 8
    stuffed = packed == 0xFF
    row_of = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(packed)) + np.cumsum(stuffed) - stuffed + 2 * row_of
    out = np.zeros(len(packed) + int(stuffed.sum()) + 2 * len(rows), np.uint8)
    out[place] = packed
    ends = np.cumsum(size + np.bincount(row_of, stuffed, len(rows)).astype(np.int64) + 2)
    out[ends - 2] = 0xFF
    out[ends - 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return out, ends


def encode_payloads(payloads: list[bytes], rows_at_once: int = 16384) -> list[bytes]:
    """One media cell for each payload; payload lengths are positive multiples of 64."""
    before, after = _head()
    counts = [len(p) // ROW for p in payloads]
    if any(not p or len(p) % ROW for p in payloads):
        raise ValueError("payload lengths must be positive multiples of 64")
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    number = np.concatenate([np.arange(n) % MAX_ROWS for n in counts]) if counts else np.zeros(0, np.int64)
    last = np.concatenate([(np.arange(1, n + 1) % MAX_ROWS == 0) | (np.arange(1, n + 1) == n) for n in counts]) if counts else np.zeros(0, bool)
    pieces, ends, base = [], [], 0
    for i in range(0, len(rows), rows_at_once):
        got, e = _entropy_rows(rows[i : i + rows_at_once], last[i : i + rows_at_once], number[i : i + rows_at_once])
        pieces.append(got.tobytes())
        ends.append(e + base)
        base += len(got)
    stream, ends = b"".join(pieces), np.concatenate(ends) if ends else np.zeros(0, np.int64)
    media, row, at = [], 0, 0
    for n in counts:
        files = []
        for first in range(0, n, MAX_ROWS):
            height = min(MAX_ROWS, n - first)
            row += height
            files.append(before + (height * 8).to_bytes(2, "big") + after + stream[at : ends[row - 1]])
            at = int(ends[row - 1])
        media.append(b"".join(files))
    return media


class Frame:
    """One parsed baseline file: dimensions, components, tables and the restart intervals of its scans."""

    def __init__(self):
        self.quant, self.huff, self.restart, self.scans = {}, {}, 0, []
        self.width = self.height = 0
        self.components: dict[int, tuple[int, int, int]] = {}


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def parse_frames(data: bytes) -> list[Frame]:
    """Markers of one or more baseline files standing one after another; ValueError for anything else."""
    try:
        return _parse_frames(data)
    except IndexError as e:
        raise ValueError("a segment ends too early") from e


def _parse_frames(data: bytes) -> list[Frame]:
    frames, at, frame = [], 0, None
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        at += 2
        if marker == 0xD8:
            frame = Frame()
            continue
        if frame is None:
            raise ValueError("no start of image")
        if marker == 0xD9:
            frames.append(frame)
            frame = None
            continue
        if marker == 0xFF:
            at -= 1
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            raise ValueError("a segment ends too early")
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                n = 64 << wide
                frame.quant[key] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for c in range(body[5]):
                key, sampling, quant = body[6 + 3 * c], body[7 + 3 * c], body[8 + 3 * c]
                if not 1 <= sampling >> 4 <= 4 or not 1 <= sampling & 15 <= 4:
                    raise ValueError("sampling factors must be from 1 to 4")
                frame.components[key] = (sampling >> 4, sampling & 15, quant)
            if not frame.height or not frame.width:
                raise ValueError("an image needs a width and a height")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                frame.huff[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            parts = [(body[1 + 2 * c], body[2 + 2 * c] >> 4, body[2 + 2 * c] & 15) for c in range(body[0])]
            found = _SCAN_END.search(data, at)
            end = found.start() if found else len(data)
            lanes = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:end])]
            frame.scans.append((parts, lanes, frame.restart, dict(frame.huff)))
            at = end
    if frame is not None:
        frames.append(frame)
    return frames


@cache
def _dc_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: bits of the code and its difference << 16 | difference + 32768; 0 where they don't
    fit or no code matches."""
    entry = _lookup(counts, symbols).astype(np.int64)
    size, length, window = entry & 255, entry >> 8, np.arange(1 << 16)
    extra = (window >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
    diff = np.where((extra >> np.maximum(size - 1, 0)) != 0, extra, extra - (1 << size) + 1)
    diff[size == 0] = 0
    return np.where((entry > 0) & (length + size <= 16), (length + size) << 16 | (diff + 32768), 0).astype(np.int32)


@cache
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: length of the code in front << 8 | its symbol; 0 where no code matches."""
    found = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in canonical(counts, symbols).items():
        found[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return found


def _decode_lanes(lanes: list[bytes], blocks: np.ndarray, slots: list[int], tables: list[tuple]) -> np.ndarray:
    """DC terms [lane, block] of restart intervals decoded in step. slots: component index of each block of an
    MCU; tables: the DC and AC lookup of each slot; blocks: how many blocks each lane holds."""
    sizes = np.fromiter(map(len, lanes), np.int64, len(lanes))
    flat = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in lanes), np.uint8)
    begin = (np.cumsum(sizes + 4) - sizes - 4) * 8
    limit = begin + sizes * 8
    pos = begin.copy()
    # One 24-bit window a byte keeps a peek to a single gather.
    window = np.zeros(len(flat) + 1, np.int32)
    window[:-3] = (flat[:-2].astype(np.int32) << 16) | (flat[1:-1].astype(np.int32) << 8) | flat[2:]

    def peek(p):
        return (window.take(p >> 3, mode="clip") >> (8 - (p & 7))) & 0xFFFF

    most = int(blocks.max()) if len(blocks) else 0
    out = np.zeros((most, len(lanes)), np.int32)
    pred = np.zeros((max(slots) + 1, len(lanes)), np.int32)
    fewest = int(blocks.min()) if len(blocks) else 0
    for b in range(most):
        slot = b % len(slots)
        dc, quick, ac = tables[slot]
        live = slice(None) if b < fewest else np.flatnonzero(blocks > b)
        p = pos[live]
        entry = quick.take(peek(p))
        diff = (entry & 0xFFFF) - 32768
        p = p + (entry >> 16)
        if not entry.all():
            odd = np.flatnonzero(entry == 0)
            q = pos[live][odd]
            entry = dc[peek(q)].astype(np.int64)
            if not entry.all():
                raise ValueError("damaged scan")
            size = entry & 255
            q += entry >> 8
            extra = peek(q) >> (16 - size)
            diff[odd] = np.where((extra >> np.maximum(size - 1, 0)) != 0, extra, extra - (1 << size) + 1)
            p[odd] = q + size
        who = slots[slot]
        pred[who, live] += diff
        out[b, live] = pred[who, live]
        entry = ac.take(peek(p))
        p += entry >> 8
        symbol = entry & 255
        if symbol.any() or not entry.all():
            k, open_ = np.ones(len(p), np.int64), np.arange(len(p))
            while True:
                if not entry.all():
                    raise ValueError("damaged scan")
                p[open_] += symbol & 15
                k[open_] = np.where(symbol == 0, 64, k[open_] + (symbol >> 4) + 1)
                open_ = open_[k[open_] < 64]
                if not len(open_):
                    break
                entry = ac.take(peek(p[open_]))
                p[open_] += entry >> 8
                symbol = entry & 255
        pos[live] = p
    if (pos > limit).any():
        raise ValueError("a scan ends too early")
    return np.ascontiguousarray(out.T)


def luma_blocks(f: Frame) -> tuple[int, int]:
    """Rows and columns of 8x8 blocks that the image's luminance has."""
    h, v, _ = next(iter(f.components.values()))
    most_h, most_v = max(h for h, _, _ in f.components.values()), max(v for _, v, _ in f.components.values())
    return -(-(-(-f.height * v // most_v)) // 8), -(-(-(-f.width * h // most_h)) // 8)


def thumbnails(cells: list[bytes]) -> list[list[np.ndarray]]:
    """For each cell, the DC-only luminance plane of each of its files, one pixel for each 8x8 block."""
    return planes_of([parse_frames(c) for c in cells])


def planes_of(frames: list[list[Frame]]) -> list[list[np.ndarray]]:
    """The same from parsed cells."""
    groups = defaultdict(list)
    for i, fs in enumerate(frames):
        for j, f in enumerate(fs):
            luma = next(iter(f.components), None)
            for parts, lanes, restart, huff in f.scans:
                if luma is None or luma not in [c for c, _, _ in parts]:
                    continue
                if any(c not in f.components for c, _, _ in parts):
                    raise ValueError("a scan names a component that isn't there")
                shape = tuple((f.components[c][0], f.components[c][1]) if len(parts) > 1 else (1, 1) for c, _, _ in parts)
                hv = max(h for h, _, _ in f.components.values()), max(v for _, v, _ in f.components.values())
                if len(parts) > 1:
                    across, down = -(-f.width // (8 * hv[0])), -(-f.height // (8 * hv[1]))
                else:
                    h, v, _ = f.components[luma]
                    across, down = -(-(-(-f.width * h // hv[0])) // 8), -(-(-(-f.height * v // hv[1])) // 8)
                if any(x not in huff for _, d, a in parts for x in (d, 16 + a)) or f.components[luma][2] not in f.quant:
                    raise ValueError("a scan names a table that isn't there")
                key = (shape, tuple((huff[d], huff[16 + a]) for _, d, a in parts), [c for c, _, _ in parts].index(luma))
                groups[key].append((i, j, f, lanes, restart, across, down))
    planes: dict[tuple[int, int], np.ndarray] = {}
    for (shape, tabs, luma_at), found in groups.items():
        slots = [c for c, (h, v) in enumerate(shape) for _ in range(h * v)]
        tables = [(_lookup(*tabs[c][0]), _dc_lookup(*tabs[c][0]), _lookup(*tabs[c][1]).astype(np.int32)) for c in slots]
        lanes, blocks, owner = [], [], []
        for n, (_, _, _, ls, restart, across, down) in enumerate(found):
            left = across * down
            for x in ls:
                take = min(restart or left, left)
                lanes.append(x)
                blocks.append(take * len(slots))
                owner.append(n)
                left -= take
            if left:
                raise ValueError("a scan ends too early")
        decoded, blocks, owner = _decode_lanes(lanes, np.array(blocks), slots, tables), np.array(blocks), np.array(owner)
        first = np.searchsorted(owner, np.arange(len(found) + 1))
        for n, (i, j, f, _, _, across, down) in enumerate(found):
            own, width = decoded[first[n] : first[n + 1]], blocks[first[n] : first[n + 1]]
            flat = own.reshape(-1) if (width == own.shape[1]).all() else np.concatenate([r[:w] for r, w in zip(own, width, strict=True)])
            h, v = shape[luma_at]
            skip = sum(a * b for a, b in shape[:luma_at])
            grid = flat.reshape(down, across, len(slots))[:, :, skip : skip + h * v].reshape(down, across, v, h)
            grid = grid.transpose(0, 2, 1, 3).reshape(down * v, across * h)
            luma = next(iter(f.components))
            quant = f.quant[f.components[luma][2]]
            # Blocks that only fill up the last units of several components aren't part of the image.
            high, wide = luma_blocks(f)
            grid = grid[:high, :wide]
            planes[i, j] = np.clip((grid * quant + 4 + 8 * 128) // 8, 0, 255).astype(np.uint8)
    return [[planes[i, j] for j in range(len(fs)) if (i, j) in planes] for i, fs in enumerate(frames)]


def thumbnail_hash(plane: np.ndarray) -> str:
    """Average hash and difference hash of the plane's 8x8 and 8x9 cell means, as hexadecimal text."""
    h, w = plane.shape

    def cells(n):
        ys, xs = np.arange(8) * h // 8, np.arange(n) * w // n
        sums = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), ys, 0), xs, 1)
        rows, cols = np.maximum(np.diff(np.append(ys, h)), 1), np.maximum(np.diff(np.append(xs, w)), 1)
        return sums * 1000 // (rows[:, None] * cols)

    a, d = cells(8), cells(9)
    bits = lambda x: np.packbits(x.ravel()).tobytes().hex()
    return bits(a * 64 > a.sum()) + bits(d[:, 1:] > d[:, :-1])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 1):
            texts = as_bytes(b.column(1))
            padded = [t + b"\0" * (-len(t) % ROW if t else ROW) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(encode_payloads(padded), pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, filled with zero bytes to a positive multiple of 64, as JPEG.

    A null text is empty; an empty text is one row of zero samples; repeated rows give repeated rows; other columns
    are not read, so their names can't clash; an empty table gives an empty table.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(kept, _encode, "doc_id long, n_bytes long, media binary")


def _decoded(cells: list[bytes]) -> list[tuple[list[Frame], list[np.ndarray]] | str]:
    """Frames and planes of each cell, or what is wrong with it. All cells are decoded in step; one by one only where
    some cell is broken."""
    try:
        frames = [parse_frames(c) for c in cells]
        return list(zip(frames, planes_of(frames), strict=True))
    except ValueError as e:
        if len(cells) == 1:
            return [str(e)]
        return [x for c in cells for x in _decoded([c])]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 2, SLICE_BYTES):
            media = b.column(2).to_pylist()
            rows = [[] for _ in range(9)]
            known = [i for i, m in enumerate(media) if m is not None]
            seen = dict(zip(known, _decoded([media[i] for i in known]), strict=True))
            for i, m in enumerate(media):
                found = seen.get(i)
                if not isinstance(found, tuple) or not found[1]:
                    for r in rows[:8]:
                        r.append(None)
                    rows[8].append(found if isinstance(found, str) else None if m is None else "no image")
                    continue
                frames, planes = found
                payload = b"".join(p.tobytes() for p in planes)
                plane = planes[0] if len(planes) == 1 else np.concatenate(planes) if len({p.shape[1] for p in planes}) == 1 else planes[0]
                # As the frames' headers say; files in one cell stand below each other.
                dims = [max(f.width for f in frames), sum(f.height for f in frames)]
                values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), *dims]
                for r, v in zip(rows, [*values, f"{dims[0]}x{dims[1]}:{thumbnail_hash(plane)}", None], strict=True):
                    r.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "error"],
            )


def read_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Dimensions, thumbnail hashes and digests, all computed from the stored bytes.

    Null media gives null features; a cell that isn't baseline JPEG, or is damaged, gives null features and says why in
    ``error``, which is null otherwise. Repeated rows give repeated rows; cells of any size are decoded whole; other
    columns are not read; an empty table gives an empty table.
    """
    kept = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).cast("long").alias("n_bytes"), F.col(media_col).alias("media"))
    return map_arrow(
        kept,
        _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, width int, height int, feature string, error string",
    )


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media cell of a written table, and what is computed from the cells' bytes, read back from there.
    The table lies in the shared folder until the session's tables are deleted; Huffman codes of one table for all texts
    leave some redundancy, which zstd takes away (1.4 x the documents' own files instead of 1.8). Awkward rows as in
    ``store_texts`` and ``read_features``."""
    return read_features(stash(store_texts(table(spark, sf_dir, "documents")), compression="zstd"))
