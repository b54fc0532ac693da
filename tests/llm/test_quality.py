"""The quality network against a plain version; long and empty texts, empty tables."""
import resource

import numpy as np
import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import quality  # noqa: E402


@pytest.fixture(scope="module")
def net():
    return quality.fit([b"abc def " * 30, b"$$$ %%% " * 30] * 20, [1.0, 0.0] * 20, steps=60)


def plain_score(net, data):
    """Window by window, chunk by chunk."""
    data = data.ljust(quality.WIDTH, b"\0")
    seen = []
    for start in range(0, len(data) - quality.WIDTH + 1, quality.CHUNK_STEPS):
        chunk = data[start : start + quality.CHUNK_STEPS + quality.WIDTH - 1]
        best = None
        for i in range(len(chunk) - quality.WIDTH + 1):
            w = chunk[i : i + quality.WIDTH]
            got = sum(t[w[2 * k] + 256 * w[2 * k + 1]] for k, t in enumerate(net.tables))
            best = got if best is None else np.maximum(best, got)
        seen.append(np.maximum(best + net.bias, 0))
    hidden = np.maximum(np.mean(seen, 0) @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-(hidden @ net.weight + net.offset)))


def test_scores_are_the_plain_network_s(net):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 6, 7, 239, 244, 245, 246, 484, 485, 486, 3000):
        data = rng.integers(32, 127, n, dtype=np.uint8).tobytes()
        assert net.score(data) == pytest.approx(plain_score(net, data), abs=1e-6), n
    long = b"abc def " * 9000  # more than one block
    assert net.score(long) == pytest.approx(plain_score(net, long), abs=1e-6) and net.score(long) > 0.5 > net.score(long.replace(b"abc", b"$$$"))


def test_the_end_of_a_long_text_counts(net):
    head = b"abc def " * 4000
    assert net.score(head + b"$$$ %%% " * 40_000) < net.score(head)


def test_a_hundred_megabytes_within_a_gigabyte(net):
    data = b"abc def " * (100 * 2**17)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert net.score(data) > 0.5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_training_on_awkward_tables(spark, net):
    schema, known = "doc_id long, text string, label string, score double", "doc_id long, quality int, text string"
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(["abc def " * 30, "$$$ " * 40, None, ""] * 10)] + [(None, "x", None, None), (0, "abc", "x", 1.0)], schema)
    labels = spark.createDataFrame([(i, 1 - i % 2 if i % 4 < 2 else 0, "t") for i in range(40)] + [(0, None, "t"), (None, 1, "t"), (1, 1, "t"), (77, 1, "t")], known)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect() if r.doc_id}
    assert len(got) == 39 and got[4] == got[8] and got[2] == got[3] and all(0 <= x <= 1 for x in got.values())
    for d, k in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs.limit(0), labels.limit(0))):
        assert quality.train(d, k).score(b"abc") == pytest.approx(0.5)
    assert quality.score(docs.limit(0), net).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert one.score(b"$$$") == one.score(b"abc") > 0.9
