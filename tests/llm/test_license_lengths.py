"""Licence passages of other lengths than the template's, against brute force."""
import random
from collections import Counter

import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import licenses  # noqa: E402

grams = lambda w: Counter(zip(w, w[1:], strict=False))


def brute(words, template):
    own, best = grams(template), None
    for s in range(len(words) - 1):
        for e in range(s + 2, len(words) + 1):
            here = grams(words[s:e])
            d = 2 * sum((here & own).values()) / (e - s - 1 + len(template) - 1)
            if d >= 0.8:
                best = min(best or (0,), (-d, s - e, 0, s))
    return best and (0, best[3], -best[1], -best[0])


@pytest.mark.parametrize("edit", ["inserted", "truncated", "changed", "twice"])
def test_edited_licences(edit):
    template = [f"t{i % 90}" for i in range(100)]
    inside = {"inserted": template[:50] + ["x"] * 20 + template[50:], "truncated": template[:72], "changed": [w if random.Random(i).random() < 0.95 else "y" for i, w in enumerate(template)], "twice": template[:60] + template[40:]}[edit]
    words = [f"a{i}" for i in range(40)] + inside + [f"b{i}" for i in range(40)]
    held = licenses.Templates([("L", " ".join(template))], 0.8)
    want = brute(words, template)
    assert want and held.scan(" ".join(words))[0] == want
    assert edit == "changed" or want[2] != 100


def test_nothing_below_the_threshold():
    template = [f"t{i}" for i in range(100)]
    words = ["a"] * 30 + template[:60] + ["b"] * 30
    assert brute(words, template) is None and licenses.Templates([("L", " ".join(template))], 0.8).scan(" ".join(words)) == []
