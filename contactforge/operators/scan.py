"""Many recognition sites in one scan of tiles.

Bases become two-bit codes, and the codes of all windows of up to eight bases are rolled along whole batches of tiles at once.
For each window length one table says which sites a window may begin; its cost doesn't depend on how many sites there are.
Longer sites are found by their most telling window and compared in full where it occurs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Bases of each symbol, as a sum of A 1, C 2, G 4, T 8.
BASES = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
_WINDOW = 8


@dataclass(frozen=True)
class Pattern:
    """A site on the upper strand, and where the upper strand is cut, counted from the site's first base."""

    enz: int
    site: str
    cut: int


class Scanner:
    """Tables of windows: for each length, code -> number of a list of patterns (0: none) whose telling window it is."""

    def __init__(self, found: list[Pattern]):
        self.patterns, lists = found, {}
        for k, p in enumerate(found):
            size = min(_WINDOW, len(p.site))
            bits = [BASES[c] for c in p.site]
            # The window that fewest sequences fit, the first of them.
            at = min(range(len(bits) - size + 1), key=lambda s: (np.prod([b.bit_count() for b in bits[s : s + size]]), s))
            for word in product(*([c for c in range(4) if b >> c & 1] for b in bits[at : at + size])):
                lists.setdefault(size, {}).setdefault(sum(c << 2 * (size - 1 - i) for i, c in enumerate(word)), []).append((k, at))
        self.tables, self.lists = {}, {}
        for size, words in lists.items():
            table, each = np.zeros(4**size, np.int32), [[]]
            for code, who in words.items():
                table[code] = len(each)
                each.append(who)
            self.tables[size], self.lists[size] = table, each

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the pattern) of every occurrence, from codes 0 to 3 (more: fits nothing)."""
        n, places, who = len(text), [], []
        code, ok = np.zeros(n, np.int32), np.ones(n, bool)
        known = text < 4
        for size in range(1, max(self.tables, default=0) + 1):
            if size > n:
                break
            # Windows of one base more, by where they begin.
            code, ok = code[: n - size + 1] << 2, ok[: n - size + 1]
            code |= text[size - 1 :] & 3
            ok = ok & known[size - 1 :]
            if size not in self.tables:
                continue
            listed = np.where(ok, self.tables[size][code], 0)
            at = np.flatnonzero(listed)
            listed = listed[at]
            for number in np.unique(listed):
                begin = at[listed == number]
                for k, shift in self.lists[size][number]:
                    start = begin - shift
                    site = self.patterns[k].site
                    start = start[(start >= 0) & (start + len(site) <= n)]
                    for i, c in enumerate(site):
                        if not shift <= i < shift + size:
                            own = text[start + i]
                            start = start[(own < 4) & ((BASES[c] >> np.minimum(own, 3)) & 1).astype(bool)]
                    places.append(start)
                    who.append(np.full(len(start), k))
        return (np.concatenate(places), np.concatenate(who)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_CODES = np.full(256, 4, np.uint8)
_CODES[[65, 67, 71, 84]] = range(4)
#: Bases that are scanned at once: a step on them takes some 20 bytes a base, whatever the size of Spark's batches.
CHUNK = 1 << 20


def _scan(scanner: Scanner, tile: int):
    # A pattern whose successor is the same enzyme's, on the other strand.
    twin = np.array([p.enz == q.enz for p, q in zip(scanner.patterns, scanner.patterns[1:], strict=False)] + [False], bool)
    turned = np.r_[False, twin[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.array([p.cut for p in scanner.patterns])
        enz = np.array([p.enz for p in scanner.patterns])
        step = max(1, CHUNK // (tile + 1))
        for b in (whole.slice(k, step) for whole in batches for k in range(0, whole.num_rows, step)):
            # These tiles in one text, a symbol that fits nothing between them.
            parts = b.column(4).cast(pa.binary()).to_pylist()
            starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            at, who = scanner.find(_CODES[np.frombuffer(b"-".join(parts), np.uint8)])
            row = np.searchsorted(starts, at, "right") - 1
            length, linear = b.column(2).to_numpy().astype(np.int64)[row], b.column(1).to_numpy(zero_copy_only=False)[row]
            inside = at - starts[row]
            begin = b.column(3).to_numpy().astype(np.int64)[row] * tile + inside
            pos = begin + cut[who]
            there = ~linear.astype(bool) | ((pos >= 0) & (pos < length))
            keep = there & (inside < tile) & (begin < length)
            pos = pos % np.maximum(length, 1)
            if twin.any():
                # Both strands cut at one place: the upper one's site yields, wherever the other's begins.
                place = (row * (int(enz.max()) + 1) + enz[who]) << 32 | pos
                keep &= ~(twin[who] & np.isin(place, place[turned[who] & there]))
            row, pos = row[keep], pos[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(enz[who[keep]].astype(np.int32))], ["seg_id", "pos", "enz"])

    return run


def occurrences(cut: DataFrame, found: list[Pattern], tile: int) -> DataFrame:
    """(seg_id, pos, enz) of every cut, from tiles that overlap by the longest site. A site counts in the tile where it
    begins, so that none is found twice; cuts outside a linear sequence are none, those of a circular one wrap. Where two
    neighbouring patterns of one enzyme cut at one place, one is listed if both can be seen from the first one's tile."""
    return cut.select("seg_id", "linear", "length", "tile", "part").mapInArrow(_scan(Scanner(found), tile), "seg_id string, pos int, enz int")
