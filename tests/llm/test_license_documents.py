"""Licence scans of whole documents against all passages of all templates; kin; altered texts; long texts."""
import random
import re
import resource
from collections import Counter

import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import licenses  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def apart(found):
    out, used = [], set()
    for x in sorted(found):
        *_, n, t, s = x
        own = set(range(s, s - n))
        if not own & used:
            used |= own
            out.append(x)
    return out


NAMED = "version v license licence attribution sharealike noncommercial noderivatives noderivs by sa nc nd bsd gpl lgpl agpl mpl epl apache".split()


def versions(text):
    """Version stated at each word's place: a number of one or two digits after one of the words, or glued to a v."""
    words = list(licenses.WORD.finditer(text.lower()))
    between = [text[a.end() : b.start()] for a, b in zip(words, words[1:], strict=False)] + [""]
    out = {}
    for i, w in enumerate(words):
        glued = re.fullmatch("([al]?gpl)?v([0-9]{1,2})", w[0])
        after = i and words[i - 1][0] in NAMED and re.fullmatch(("[.]?" if words[i - 1][0] == "v" else "") + r"[ \t,(_/-]*\n?[ \t*#/;]*", between[i - 1])
        if glued or after and re.fullmatch("[0-9]{1,2}", w[0]):
            minor = words[i + 1][0] if between[i] in (".", " ") and re.fullmatch("[0-9]", words[i + 1][0]) else "0"
            out[i] = (glued[2] if glued else w[0]) + ("" if minor == "0" else "." + minor)
    return out


def first(found, start, end):
    return next((found[i] for i in range(start, end) if i in found), None)


def plain(text):
    """Every passage of every template that states its version: each template's best ones, then those that share most."""
    words, found, stated = licenses.WORDS((text or "").lower()), [], versions(text or "")
    grams = list(zip(words, words[1:], strict=False))
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        w = licenses.WORDS(template.lower())
        own, says = Counter(zip(w, w[1:], strict=False)), first(versions(template), 0, len(w))
        a, mine = len(w) - 1, []
        if sum((Counter(grams) & own).values()) < 0.6 * a:  # no passage shares more than the whole text does
            continue
        for s in range(len(grams)):
            seen, common = Counter(), 0
            for e in range(s, min(len(grams), s + int(1.5 * a) + 2)):
                seen[grams[e]] += 1
                common += seen[grams[e]] <= own[grams[e]]
                b = e - s + 1
                if 2 * common >= 0.8 * (a + b) and says in (None, first(stated, s, e + 2)):
                    mine.append((-2 * common / (a + b), -b - 1, t, s))
        for d, n, _, s in apart(mine):
            found.append((-round(-d * (a - n - 1) / 2), d, n, t, s))
    return sorted((t, s, -n, -d) for _, d, n, t, s in apart(found))


@pytest.fixture(scope="module")
def held():
    return licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_query_against_all_passages(spark, folder):
    got = {}
    for r in licenses.op8_licenses(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.template, r.first_word, r.n_words, r.dice))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got and {i: sorted(x) for i, x in got.items()} == {i: p for i, t in docs if (p := plain(t))}


def test_altered_sentences_of_documents(spark, held):
    """Words of the documents' own licence lines are replaced, dropped and doubled, so that the threshold decides."""
    r, kept, lost = random.Random(5), 0, 0
    for row in licenses.op8_licenses(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet"), "doc_id").collect():
        words = licenses.WORDS(row.text.lower())
        line = words[row.first_word : row.first_word + row.n_words]
        for edits in (1, 2, 3):
            other = list(line)
            for _ in range(edits):
                k = r.randrange(len(other))
                other[k : k + 1] = r.choice([[], ["zzz"], [other[k]] * 2])
            text = " ".join(words[max(0, row.first_word - 30) : row.first_word] + other + words[row.first_word + row.n_words :][:30])
            want = plain(text)
            assert held.scan(text) == want
            kept, lost = kept + bool(want), lost + (not want)
    assert kept > 5 and lost > 5


@pytest.mark.parametrize("drop", [0, 2, 5])
def test_kin_are_told_apart(held, drop):
    """Each template inside prose, some words changed: its own licence is named, not a relative's."""
    r = random.Random(drop)
    for name, template in licenses.TEMPLATES:
        words = licenses.WORDS(template.lower())
        if len(words) < 20 * drop:
            continue
        for _ in range(drop):
            words[r.randrange(len(words))] = "changed"
        got = held.scan(" ".join(["before", "it"] * 20 + words + ["after", "it"] * 20))
        assert {held.items[x[0]][0] for x in got} == {name}, (name, got)


def test_long_texts(held, monkeypatch):
    text = ("plain prose of the one who wrote it, and more of the same\n" * 400 + "Licensed under the MIT License.\n") * 12
    want = held.scan(text)
    assert len(want) == 12 and len(text) > licenses.LONG
    monkeypatch.setattr(licenses, "LONG", 1 << 40)
    assert held.scan(text) == want
    monkeypatch.undo()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(held.scan("plain prose of the one who wrote it, all night\n" * 2_200_000 + "Released under the MIT License.")) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_ties_repeats_and_nulls(spark):
    line = "Licensed under the MIT License."
    df = spark.createDataFrame([(1, f"{line} x {line}", "a"), (1, f"{line} x {line}", "a"), (None, line, "b"), (2, None, "c"), (3, "", "d")], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert Counter(r.doc_id for r in got) == {1: 4, None: 1} and {r.license for r in got} == {"MIT"}


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This work is licensed under the GNU General Public License, version 1.", "GPL-1.0-only"),
        ("This work is licensed under the GNU General Public License, version 3 or later.", "GPL-3.0-or-later"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        ("This work is licensed under the GNU LGPL, version 3.", "LGPL-3.0-only"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivs 2.5 Generic License.", "CC-BY-ND-2.5"),
        ("Licensed under CC BY 3.0", "CC-BY-3.0"),
        ("Licensed under CC BY 3.5", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License, Version 2.0. 1. Parts", "Apache-2.0"),
        ("Licensed under the BSD License.", "LicenseRef-BSD"),
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("# SPDX-License-Identifier: MIT-0", None),
        ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0-only"),
        ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later"),
        ("<!-- SPDX-License-Identifier: LGPL-2.1-or-later -->", "LGPL-2.1-or-later"),
        ("SPDX-License-Identifier: GPL-4.0-only", None),
        (
            "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by the\n"
            " * Free Software Foundation, either version\n * 2 of the License, or\n * (at your option) any later version.",
            "GPL-2.0-or-later",
        ),
    ],
)
def test_versions_and_identifiers(text, name):
    own = licenses.Templates(licenses.TEMPLATES + licenses.IDENTIFIERS, licenses.THRESHOLD)
    for around in (text, f"version 9 of prose.\n{text}\nand version 8 of it"):
        assert [own.items[t][0] for t, *_ in own.scan(around)] == ([name] if name else [])
    if "SPDX" not in text:
        assert licenses.Templates(licenses.TEMPLATES, 0.8).scan(text) == plain(text)


@pytest.mark.parametrize("t", range(len(licenses.IDENTIFIERS)))
def test_each_identifier(t):
    own = licenses.Templates(licenses.TEMPLATES + licenses.IDENTIFIERS, licenses.THRESHOLD)
    name, line = licenses.IDENTIFIERS[t]
    assert [own.items[k][0] for k, *_ in own.scan(f"#!/bin/sh\n# {line}\n# more")] == [name]
