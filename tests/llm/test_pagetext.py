"""Main text by differencing: whole extractions against a plain version, marks, copies, long pages."""
import random
import time
from collections import defaultdict

import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import pagetext  # noqa: E402


def plain_shared(a, b):
    """Lines of ``a`` on the path that a full table gives."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def site_page(r, host, i):
    """A page without any container or telling names: template lines of the host around lines of its own."""
    own = [f"own {host} {i} {k} {r.random():.9f}" for k in range(r.randrange(0, 6))]
    if r.random() < 0.3:
        own.insert(r.randrange(len(own) + 1), f"often quoted {r.randrange(3)}")
    top = [f"{host} top {k}" for k in range(4) if r.random() < 0.9]
    low = [f"{host} low {k}" for k in range(3) if r.random() < 0.9]
    return [*top, *own, *low], own


def html(lines):
    return "<html><body>" + "".join(f"<div><p>{x}</p></div>" for x in lines) + "</body></html>"


def test_whole_extraction_against_a_plain_version(spark):
    r, rows, lines = random.Random(8), [], {}
    for h in ("a.com", "b.com", "c.com"):
        for i in range(60):
            at = f"/{r.choice(['x', 'y', 'news'])}/{r.randrange(10**6)}"
            lines[len(rows)], _ = site_page(r, h, i)
            rows.append((len(rows), f"http://{h}{at}", html(lines[len(rows)])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text.split("\n") if x.text else [] for x in pagetext.extract(df).collect()}
    hosts = defaultdict(list)
    for i, url, _ in rows:
        host, path = pagetext.split_url(url)
        hosts[host].append((path, i))
    changed = 0
    for pages in hosts.values():
        pages.sort()
        for k, (path, i) in enumerate(pages):
            alike = lambda n: next((m for m, (x, y) in enumerate(zip(path, pages[n][0], strict=False)) if x != y), min(len(path), len(pages[n][0])))  # noqa: B023,E731
            near = [n for n in (k - 1, k + 1) if 0 <= n < len(pages)]
            best = max(near, key=lambda n: (alike(n), -n))
            other = lines[pages[best][1]]
            # Which of several longest alignments is taken is free; how much it deletes isn't.
            assert len(got[i]) == len(lines[i]) - plain_shared(lines[i], other), (i, got[i])
            assert set(lines[i]) - set(other) <= set(got[i])
            changed += len(got[i]) != len(lines[i])
    assert changed > 150
    # Another neighbour, another result.
    moved = spark.createDataFrame([(i, f"http://{i}.org/x", h) for i, _, h in rows], df.schema)
    alone = {x.page_id: x.text.split("\n") if x.text else [] for x in pagetext.extract(moved).collect()}
    assert alone == lines and sum(alone[i] != got[i] for i in got) == changed


def test_short_article_on_a_template(spark):
    page = lambda i: html(["Home and more", "Our services", "Terms of this site", f"One line {i}.", "Call us today"])
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page(i)) for i in range(9)], "page_id long, url string, html string")
    assert sorted(x.text for x in pagetext.extract(df).collect()) == [f"One line {i}." for i in range(9)]


def test_copies_are_passed_over(spark):
    page = lambda i: html(["Top", f"Text {i}", "Low"])
    rows = [(i, f"http://h.com/a/{i:02d}", page(i // 4)) for i in range(16)] + [(90 + i, f"http://copies.com/{i}", page(1)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in pagetext.extract(df.coalesce(1)).collect()}
    assert [got[i] for i in range(16)] == [f"Text {i // 4}" for i in range(16)]
    assert all(got[90 + i] == "Top\nText 1\nLow" for i in range(5))


def test_marks():
    def kept(body, others=None):
        lines, fate = pagetext.candidates(body)
        hashes = [hash(x) for x in lines]
        return pagetext.main_text(lines, fate, hashes, None if others is None else [hash(x) for x in others])

    article = '<article><p>One</p><section class="related-work"><p>Two</p></section><div id="search-algorithms">Three</div><p class="legal">Four</p><div class="ad-slot">Buy</div><ul class="comment-list"><li>Me</li></ul></article><div>Out</div>'
    assert kept(article) == "One\nTwo\nThree\nFour"
    assert kept(article, ["Four", "Two", "Out"]) == "One\nTwo\nThree"  # a doubtful part that the neighbour has too
    assert kept("<p>Out</p><p>In</p><nav>N</nav><footer>F</footer>", ["Out"]) == "In"
    assert kept("<p>Out</p><p>In</p>") == "Out\nIn"
    assert pagetext._marked("adBanner") == pagetext._marked("top-ads") == pagetext._marked("comments") == pagetext.NEVER_LINE
    assert pagetext._marked("related") == pagetext.DOUBTFUL_LINE
    assert not any(map(pagetext._marked, ("address", "related-work", "search-engines", "has-sidebar", "main-content", "legal-history", "")))


def test_long_pages_in_seconds(spark):
    r = random.Random(2)
    rows = [(1, "http://h.com/1", html(["same"] * 50_000)), (2, "http://h.com/2", html(["same"] * 40_000 + ["other"])), (3, "http://h.com/3", html([f"row {r.randrange(3)}" for _ in range(50_000)]))]
    began = time.time()
    got = {x.page_id: x.n_chars for x in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == 10_000 * 5 - 1 and time.time() - began < 60


def test_alignment_in_linear_space(monkeypatch):
    r = random.Random(1)
    for n in range(600):
        monkeypatch.setattr(pagetext, "TABLE_BITS", r.choice([1, 10, 40, 1 << 20]))
        a, b = [[r.randrange(r.choice([2, 5])) for _ in range(r.randrange(18))] for _ in range(2)]
        got = pagetext.common_subsequence(a, b)
        assert len(got) == plain_shared(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
