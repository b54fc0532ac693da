"""The method's verdicts against plain rule mining over all token combinations."""
import re
from collections import Counter
from itertools import combinations

import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import urlrules  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return host.lower(), re.match("[^?#]*", rest[len(host) :])[0]


def plain_tokens(host, path):
    labels = host.split(".")
    parts = [p for p in path.split("/") if p]
    out = {"d:"} if not host else {"d:" + ".".join(labels[-i:]) for i in range(1, len(labels) + 1)}
    out |= {f"p{i}:{p}" for i, p in enumerate(parts)}
    return out | {f"n:{len(parts)}", "e:" + re.search(r"(\.[a-z0-9]{1,5}|/)?\Z", path)[0]}


def plain_verdicts(urls):
    """(host, path, rule, verdict) of each URL; rules are mined from every subset of the frequent tokens."""
    known, rows = [], []
    for u in urls:
        host, path = split(u)
        fits = [(len(r), r, v) for v, r in urlrules.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        rows.append((host, path, rule, verdict))
        if rule:
            known.append((plain_tokens(host, path), verdict))
    least = urlrules.MIN_SUPPORT * len(known)
    seen = Counter(t for ts, _ in known for t in ts)
    often = {t for t, n in seen.items() if n >= least}
    level = {frozenset([t]) for t in often}
    rules = {}
    while level:
        count, says = Counter(), Counter()
        for ts, v in known:
            for s in level:
                if s <= ts:
                    count[s] += 1
                    says[s, v] += 1
        level = {s for s in level if count[s] >= least}
        for s in level:
            for v in ("allow", "block"):
                if says[s, v] >= max(least, 1) and says[s, v] / count[s] >= urlrules.MIN_CONFIDENCE:
                    rules[s, v] = (says[s, v] / count[s], says[s, v] / len(known))
        level = {a | b for a, b in combinations(level, 2) if len(a | b) == len(a) + 1}
    usual = "block" if sum(v == "block" for _, v in known) > sum(v == "allow" for _, v in known) else "allow"
    return rows, rules, usual


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_query_against_plain_mining(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    rows, rules, usual = plain_verdicts([r.url for r in pages])
    got = {r.page_id: r for r in urlrules.op10_urls(spark, folder).collect()}
    assert len(got) == len(pages)
    learned = 0
    for r, (host, path, rule, verdict) in zip(pages, rows, strict=True):
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        if rule is None:
            ts = plain_tokens(host, path)
            fits = [(c, s, v) for (tokens, v), (c, s) in rules.items() if tokens <= ts]
            learned += bool(fits)
            best = {v for c, s, v in fits if (c, s) == max(x[:2] for x in fits)} if fits else {usual}
            assert g.verdict in best, (host, path, g.verdict, best)
        else:
            assert g.verdict == verdict
    assert learned > 0


def test_deep_urls_and_rules_of_many_tokens(spark):
    """The eighth domain label and the ninth path part decide; four tokens together are one rule; one long common
    beginning of all paths doesn't multiply the rules."""
    deep = "/".join(f"d{i}" for i in range(40))
    rules = (("block", "bad.example/"), ("allow", "good.example/"))
    urls = []
    for i in range(120):
        last = "x" if i % 2 else "y"
        urls.append(f"http://{'bad' if i % 2 else 'good'}.example/{deep}/{last}/{i % 3}")
    urls += [f"http://q{i}.z.y.x.w.v.u.{'bad' if i % 2 else 'good'}.example/{deep}/{'x' if i % 2 else 'y'}" for i in range(40)]
    asked = [f"http://new.example/{deep}/x/7", f"http://new.example/{deep}/y/7", "http://new.example/", None, "//nothing"]
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls + asked)], "page_id long, url string, path string")
    got = {r.page_id: r.verdict for r in urlrules.judge(df, rules).collect()}
    n = len(urls)
    assert [got[n], got[n + 1]] == ["block", "allow"] and set(got.values()) == {"allow", "block"}


def test_repeated_rows_null_ids_and_no_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")] * 3 + [(None, "http://a.com/de/1"), (None, None), (2, "")], "page_id long, url string")
    got = urlrules.judge(df).collect()
    assert len(got) == 6 and [r.verdict for r in got if r.page_id == 1] == ["block"] * 3  # the only label says block
    assert all(r.verdict == "allow" for r in urlrules.judge(df.where("page_id = 1")).collect())
    assert all(r.verdict == "allow" and r.rule is None for r in urlrules.judge(df, rules=()).collect())
    assert urlrules.judge(df.limit(0)).count() == 0


def test_counts_beyond_any_array(spark):
    """Baskets of 5 * 10^9 URLs, and rules that don't depend on how many rows stand for them."""
    baskets = [("allow", ["a", "b"], 5_000_000_000), ("block", ["a", "c"], 2_500_000_000), ("block", ["c"], 40_000_000), ("allow", ["c", "d"], 1), ("block", ["d"], 3)]
    df = spark.createDataFrame(baskets, "verdict string, tokens array<string>, n long")
    common = urlrules.common_tokens(df, 0.001)
    order = lambda x: sorted((*r.rule_tokens, r.verdict, round(r.confidence, 12), round(r.support, 12)) for r in x.collect())
    total = sum(n for *_, n in baskets)
    got = order(urlrules.mine(df, common, 0.001, 0.5, 2000))
    # b stands for itself alone, and c is block's but for one URL.
    assert ("b", "allow", 1.0, round(5_000_000_000 / total, 12)) in got
    assert ("c", "block", round(2_540_000_000 / 2_540_000_001, 12), round(2_540_000_000 / total, 12)) in got
    assert ("a", "allow", round(2 / 3, 12), round(5_000_000_000 / total, 12)) in got
    small = spark.createDataFrame([(v, t, max(1, n // 2_500_000)) for v, t, n in baskets if n > 5], df.schema)
    one = [order(urlrules.mine(small, urlrules.common_tokens(small, 0.001), 0.001, 0.5, rows)) for rows in (10**6, 700, 3)]
    assert one[0] == one[1] == one[2] and len(one[0]) >= 3
