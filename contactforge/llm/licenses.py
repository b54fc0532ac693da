"""Licence scans: Dice coefficient over word bigrams between passages and licence templates.

A text becomes lower-case words. Passages are all runs of words of the text; a passage matches a template if the Dice
coefficient of its bigrams and the template's, both with repetitions, reaches the threshold. Of one template's matches
that overlap the best stays, then the longest, the first in the text. Of several templates' matches that overlap the
one with the most shared bigrams stays, then the best, the longest, the template listed first: a licence whose text
holds another's whole text is told from it.

Bounds. Dice is at most 2 min(a, b) / (a + b) for a and b bigrams, so a passage has 2/3 to 3/2 of the template's bigrams
at a threshold of 0.8. Words at either end whose bigram isn't the template's only lower Dice, so passages start and end
at such bigrams (hits). The count of hits bounds the common bigrams from above; only starts that pass are counted exactly.

Versions. One number changes few bigrams of a notice, so versions must agree besides: where a template states a version or
an SPDX identifier, a passage matches only if what it states first is the same (``statements``).
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table
from .license_texts import IDENTIFIERS, TEMPLATES

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
WORDS = WORD.findall
#: Characters above which a text's words are read in blocks, and words in a block.
LONG, BLOCK = 1 << 18, 1 << 16
#: What may stand between a word and its version: blanks, a few marks, and one line's end with a comment's margin.
_GAP = r"(?=[\W_])[ \t,(_/-]*\n?[ \t*#/;]*"
_NAMED = "version|license|licence|attribution|sharealike|noncommercial|noderivatives|noderivs|by|sa|nc|nd|bsd|[al]?gpl|mpl|epl|apache"
STATED = re.compile(
    rf"(?<![^\W_])(?:spdx-license-identifier:[ \t]*(?P<id>[a-z0-9.+-]*[a-z0-9+])|(?:(?:{_NAMED}){_GAP}|v\.?{_GAP})(?P<number>\d{{1,2}}(?:[. ]\d)?)(?![^\W_])"
    r"|(?:[al]?gpl)?v(?P<glued>\d{1,2}(?:[. ]\d)?)(?![^\W_]))"
)


def statements(text: str) -> tuple[list[int], list[str]]:
    """Where a lower-case text states versions (as "2.1"; "3" for "3.0") and SPDX identifiers: numbers of words, values."""
    places, values, words, last = [], [], 0, 0
    for m in STATED.finditer(text):
        at = m.start() if m["glued"] else m.start("id" if m["id"] else "number")
        words, last = words + sum(1 for _ in WORD.finditer(text, last, at)), at
        places.append(words)
        values.append(f"id {m['id']}" if m["id"] else (m["number"] or m["glued"]).replace(" ", ".").removesuffix(".0"))
    return places, values


class Templates:
    """Word and bigram numbers of the templates. Templates have two words at least."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.word, self.items = threshold, {}, []
        #: The version or identifier that each template states first, if any.
        self.says: list[str | None] = []
        for name, text in templates:
            words = WORDS(text.lower())
            if len(words) < 2:
                raise ValueError(f"template of {name} has fewer than two words")
            ids = np.array([self.word.setdefault(w, len(self.word) + 1) for w in words])
            self.items.append((name, len(words), ids))
            self.says.append(next(iter(statements(text.lower())[1]), None))
        size = len(self.word) + 1
        self.items = [(name, m, ids[:-1] * size + ids[1:]) for name, m, ids in self.items]
        self.known = np.unique(np.concatenate([g for *_, g in self.items]))
        self.size = size
        #: Which template holds which known bigram, and the fewest and most bigrams of its passages.
        self.holds = np.array([np.isin(self.known, g) for *_, g in self.items])
        self.least = np.array([ceil(len(g) * threshold / (2 - threshold) - 1e-9) for *_, g in self.items])
        self.most = np.array([floor(len(g) * (2 - threshold) / threshold + 1e-9) for *_, g in self.items])

    def word_ids(self, text: str) -> np.ndarray:
        """Number of each word, 0 for words of no template."""
        text, get = text.lower(), self.word.get
        if len(text) <= LONG:
            return np.array([get(w, 0) for w in WORDS(text)], np.int32)
        found, parts = (get(m[0], 0) for m in WORD.finditer(text)), []
        while not parts or len(parts[-1]) == BLOCK:
            parts.append(np.fromiter(islice(found, BLOCK), np.int32))
        return np.concatenate(parts)

    def scan(self, text: str) -> list[tuple[int, int, int, float]]:
        """(template, first word, words, Dice) of the matches, by template and place."""
        ids = self.word_ids(text)
        if len(ids) < 2:
            return []
        places = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        grams = ids[places].astype(np.int64) * self.size + ids[places + 1]
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        real = self.known[at] == grams
        places, grams, at = places[real], grams[real], at[real]
        # Templates with too few hits in the whole text can't match.
        seen_at = np.bincount(at, minlength=len(self.known))
        found, stated = [], None
        for t in np.flatnonzero(self.holds @ seen_at >= self.least).tolist():
            own = self.items[t][2]
            a, want = len(own), Counter(own.tolist())
            mine = self.holds[t][at]
            hits, codes = places[mine], grams[mine]
            least, most = int(self.least[t]), int(self.most[t])
            # The best passages start and end at hits; only starts with enough hits within the longest passage can match.
            starts = np.flatnonzero(hits[least - 1 :] - hits[: len(hits) - least + 1] < most)
            ends = np.searchsorted(hits, hits[starts] + most)
            own_found = []
            for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                b = hits[i:j] - hits[i] + 1
                reach = np.flatnonzero(np.arange(1, j - i + 1) >= self.threshold * (a + b) / 2)
                if not len(reach):
                    continue
                seen, common, first, says = Counter(), 0, -1, self.says[t]
                if says is not None:
                    stated = stated or statements(text.lower())
                    k = bisect_left(stated[0], hits[i])
                    if k == len(stated[0]) or stated[1][k] != says:
                        continue
                    first = stated[0][k] - int(hits[i])
                for size, g in zip(b[: reach[-1] + 1].tolist(), codes[i : i + reach[-1] + 1].tolist(), strict=True):
                    seen[g] += 1
                    common += seen[g] <= want[g]
                    if size >= first and common >= self.threshold * (a + size) / 2:
                        own_found.append((-2 * common / (a + size), -size - 1, int(hits[i]), common))
            free = np.ones(len(ids) if own_found else 0, bool)
            found += [(-common, d, n, t, s) for d, n, s, common in _apart(sorted(own_found), free, 1, 2)]
        if not found:
            return []
        return sorted((t, s, -n, -d) for _, d, n, t, s in _apart(sorted(found), np.ones(len(ids), bool), 2, 4))


def _apart(matches: list[tuple], free: np.ndarray, length: int, start: int) -> Iterator[tuple]:
    """The matches, in their order, that overlap none before them; lengths are negative."""
    for m in matches:
        own = free[m[start] : m[start] - m[length]]
        if own.all():
            own[:] = False
            yield m


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + IDENTIFIERS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a match: doc_id, license, template (its number), first_word, n_words, dice.

    Null and empty texts and texts of one word have no matches; null ids stay null; repeated rows give repeated
    matches; ties between passages as above; texts of any length are scanned whole, their words read in blocks; other columns are not read; an empty
    table gives an empty table.
    """
    held = Templates(templates, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for b in slices(whole, 1):
                rows = [(i, own.items[t][0], t, s, n, d) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text for t, s, n, d in own.scan(text)]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "template", "first_word", "n_words", "dice"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(kept, run, "doc_id long, license string, template int, first_word long, n_words long, dice double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence passage of every document."""
    return scan(table(spark, sf_dir, "documents"))
