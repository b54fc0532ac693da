"""Corpus operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("contactforge.llm")
from contactforge.llm import bpe, langid, licenses, media, mixing, neardup, pagetext, quality, topk, urlrules  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "a", "A b", "\x00\x01", "é" * 3000, "word " * 30000, "Hello, wörld! 日本 🙂", "x" * 63, "x" * 64, "x" * 65, "same text here", "same text here", "123 456", "$$$ %%%"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names that operators use."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2"][i % 3], len(t or ""), 0.5, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[12], (None, "no id", "en", "s1", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, whole long")


def docs(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- media -----------------------------------------------------------------------------------------------------------

def test_media_round_trip_of_any_bytes():
    r = random.Random(1)
    payloads = [bytes(64), bytes([255] * 128), r.randbytes(64 * 700), r.randbytes(64 * (media.MAX_ROWS + 5))]
    cells = media.encode_payloads(payloads)
    assert [b"".join(p.tobytes() for p in ps) for ps in media.thumbnails(cells)] == payloads
    assert len(media.parse_frames(cells[3])) == 2 and media.parse_frames(cells[0])[0].width == 512
    with pytest.raises(ValueError, match="multiples"):
        media.encode_payloads([b"abc"])
    for bad in (b"nonsense", cells[2][:-40] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            media.thumbnails([bad])


def _other_jpeg(rows, cols, seed):
    """A three-component 4:2:0 scan with AC terms and no restarts, coded bit by bit."""
    r = random.Random(seed)
    dc = media.canonical(media.DC_COUNTS, media.DC_SYMBOLS)
    ac_counts, ac_symbols = [0, 2, 2] + [0] * 13, [0x00, 0x01, 0x12, 0xF0]
    ac = media.canonical(ac_counts, ac_symbols)
    bits, pred, luma = [], [0, 0, 0], np.zeros((2 * rows, 2 * cols), int)

    def put(code):
        bits.append(format(code[0], f"0{code[1]}b"))

    def value(v, size):
        if size:
            bits.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    for y in range(rows):
        for x in range(cols):
            for b, comp in enumerate((0, 0, 0, 0, 1, 2)):
                v = r.randrange(-60, 60)
                d, pred[comp] = v - pred[comp], v
                put(dc[abs(d).bit_length()])
                value(d, abs(d).bit_length())
                if r.random() < 0.5:
                    put(ac[0x01])
                    value(r.choice([-1, 1]), 1)
                if r.random() < 0.3:
                    put(ac[0xF0])
                    put(ac[0x12])
                    value(r.choice([-3, -2, 2, 3]), 2)
                put(ac[0x00])
                if comp == 0:
                    luma[2 * y + b // 2, 2 * x + b % 2] = v
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    frame = b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, frame)
    out += seg(0xC4, bytes([0, *media.DC_COUNTS, *media.DC_SYMBOLS, 16, *ac_counts, *ac_symbols])) + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    return out + data + b"\xff\xd9", np.clip(128 + luma * 2, 0, 255)


def test_media_reads_other_baseline_files():
    made = [_other_jpeg(2, 3, 1), _other_jpeg(4, 1, 2)]
    for planes, (_, want) in zip(media.thumbnails([m for m, _ in made]), made, strict=True):
        assert (planes[0] == want).all()


def test_media_query(spark, awkward):
    got = media.read_features(media.store_texts(awkward)).collect()
    assert len(got) == awkward.count()
    want = {i: (t or "").encode() for i, t in enumerate(TEXTS)} | {None: b"no id"}
    for r in got:
        raw = want[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.read_features(media.store_texts(awkward.limit(0))).count() == 0


# --- quality, language ------------------------------------------------------------------------------------------------

def test_quality(spark, awkward):
    got = quality.op2_quality(spark, MIDDLE)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.select("doc_id", "held_out").collect())
    rows = quality.score(awkward, quality.fit([b"abc def", b"$$$"], [1.0, 0.0], steps=5)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit([], []).score(b"") == pytest.approx(0.5)


def test_language(spark, awkward):
    got = langid.op4_language(spark, MIDDLE).join(docs(spark, MIDDLE), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    model = langid.train(docs(spark))
    rows = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    assert all(rows[i].lang_pred == "und" for i in (0, 1, 2, 5, 14, 15)) and rows[8].lang_pred in model.languages
    assert langid.train(awkward.limit(0)).predict("abc") == ("und", 0.0)
    counts = Counter()
    for r in docs(spark).where("lang = 'de'").collect():
        counts.update(langid.ngram_buckets(f" {r.text.lower()} ").tolist())
    column = model.languages.index("de")
    total = sum(counts.values()) + 0.1 * (1 << langid.BUCKET_BITS)
    for b, n in counts.most_common(50):
        assert model.log_prob[b, column] == pytest.approx(np.log((n + 0.1) / total))


# --- tokens ------------------------------------------------------------------------------------------------------------

def test_bpe(spark, awkward):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (awkward, docs(spark)):
        rows = bpe.encode_texts(df, P.path(bpe.VOCABULARY), P.PATTERN, ids=True)
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in rows.collect():
            want = theirs.encode_ordinary(texts[r.doc_id])
            assert r.ids == want and r.n_tokens == len(want) and r.round_trip
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        back = bpe.decode_ids(rows, P.path(bpe.VOCABULARY))
        assert all(r.text == texts[r.doc_id] for r in back.collect())
    machine, r = bpe.Transducer(ranks, max_states=500), random.Random(3)
    for _ in range(3000):
        piece = "".join(r.choice("aeiouthnsré ñ.!1") for _ in range(r.randrange(1, 40))).encode()
        parts = theirs._encode_single_piece(piece)
        assert machine.encode(piece).tolist() == parts


def test_streaming_decode():
    tokens = {0: b"\xe6\x97", 1: b"\xa5a", 2: b"\xff", 3: b"b"}
    d = bpe.StreamDecoder(tokens)
    assert [d.feed(0), d.feed(1), d.feed(3)] == ["", "日a", "b"]
    for ids in ([2, 3], [0, 3], [0], [1], [0, 0, 1]):
        assert d.decode(ids) == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


# --- near copies -----------------------------------------------------------------------------------------------------------

def plain_components(rows):
    fps = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        import xxhash

        hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps[doc_id] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_simhash(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"long shared text of many words number {i // 40} " * 30 + str(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.group(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == plain_components(rows)
    small = [(r.doc_id, r.text) for r in docs(spark).collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in neardup.op6_simhash(spark, SMALL).collect()} == plain_components(small)
    assert neardup.group(df.limit(0)).count() == 0


def test_trees_find_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = [base[:800] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)) for _ in range(2)]
    clump = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    points = np.unique(np.concatenate([base, *near, clump]))
    found = {(min(a, b), max(a, b)) for x, y in neardup.close_pairs(points, leaf=20) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    apart = np.bitwise_count(points[:, None] ^ points)
    assert found == {(a, b) for a, b in zip(*np.nonzero(apart <= 2), strict=True) if a < b}
    tree = neardup.UpperTree(points[:500], len(points) / 500, 100, 2)
    assert tree.shards > 20
    index, shard = tree.route(points)
    together = {}
    for i, s in zip(index.tolist(), shard.tolist(), strict=True):
        together.setdefault(i, set()).add(s)
    assert all(together[a] & together[b] for a, b in found)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 150)] + [(900, 800), (800, 700)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 200 for i in range(1, 150)}, 900: 700, 800: 700}


# --- search, licences, mixing, URLs, pages ------------------------------------------------------------------------------------

def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = np.round(r.normal(size=(1500, 37)), 1)
    vectors[::3] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9100, [1.0] * 36 + [None]), (9200, [float("nan")] * 37), (None, [0.0] * 37), (9300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, candidate_bytes=100 * 37 * 8, query_bytes=7 * 37 * 8).orderBy("query_id", "rank").collect()
    whole = np.floor(vectors * 1024).astype(np.int64)
    want = []
    for q in range(0, 1500, 100):
        s = whole @ whole[q]
        best = sorted((-s[i], i) for i in range(1500) if i != q)[:10]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(best)]
    assert [tuple(x) for x in got] == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_licenses(spark, awkward):
    assert licenses.scan(awkward).count() == 0
    held = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    for t, (name, text) in enumerate(licenses.TEMPLATES):
        got = held.scan(f"Some words before. {text} Some words after it.")
        assert [held.items[x[0]][0] for x in got] == [name] and got[0][3] == 1.0, (t, got)
    assert held.scan("Released under the") == [] and held.scan("Released under the MIT")[0][2:] == (4, 2 * 3 / 7) and held.scan("") == []
    assert licenses.scan(awkward.limit(0)).count() == 0


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark, awkward):
    for df in (awkward, docs(spark), docs(spark).withColumn("source", F.when(F.col("doc_id") % 5 == 0, "a").when(F.col("doc_id") == 1, None).otherwise("b"))):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken, largest = {}, Counter(), Counter()
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        target = plain_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
        for s in sizes:
            assert abs(taken[s] - target[s]) <= largest[s]
    assert mixing.mix(awkward.limit(0)).count() == 0
    again = mixing.mix(docs(spark).repartition(7)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs(spark)).collect())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x#y", "http://example.org", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/es/1", "http://x.net/de/1", "a://b://c.org/d", "http://e.org?q=/a", "http://e.org#/a"] + [f"http://h{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(40)]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urlrules.judge(df).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(rule), rule, v) for v, rule in urlrules.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[len(rule.split("/")[0]) :])]
        assert (got[i].host, got[i].path) == (host, path), u
        if fits:
            assert (got[i].rule, got[i].verdict) == max(fits)[1:], u
        else:
            assert got[i].rule is None and got[i].verdict in ("allow", "block")
    assert got[11].verdict == "block"  # learned: de goes with block
    assert urlrules.judge(df.limit(0)).count() == 0


def test_page_structure():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">Cookies</div><main><article><h1>Head&amp;line</h1><p>One <b>two</b>
    three&nbsp;&lt;four&gt;<br>five<p>Six</p><aside>Side</aside><form>Form</form><p class="ad">Buy</p><div style="display:none">No</div></article></main>
    <section id="comments"><p>Reader</p></section><footer>&copy; F</footer></body></html>"""
    kept = [x for x, said, inside in pagetext.page_lines(page) if inside and said == pagetext.PLAIN_LINE]
    assert kept == ["Head&line", "One two three <four> five", "Six"]
    assert pagetext.page_lines("") == [] and pagetext.page_lines("<p>a<div") == [("a", pagetext.PLAIN_LINE, False)]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = [[r.randrange(5) for _ in range(r.randrange(15))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pagetext.common_subsequence(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and got == sorted(got)


def test_page_differences(spark):
    def page(i):
        return f"<body><div>Top line of the site</div><div><p>Own text number {i} with several words of its own.</p><p>More {i * 7} words that nobody shares.</p></div><div>Bottom line</div></body>"

    rows = [(i, f"http://h.com/a/{i:03d}", page(i), "x") for i in range(300)] + [(900, "http://solo.com/x", page(900), "x"), (901, None, None, "x"), (902, "http://h.com/b", "", "x"), (None, "http://z.com/1", "<p>z</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pagetext.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(300):
        assert got[i].text == f"Own text number {i} with several words of its own.\nMore {i * 7} words that nobody shares.", i
        assert got[i].n_chars == len(got[i].text)
    assert got[900].text.startswith("Top line") and got[901].text == "" and got[902].text == "" and got[None].text == "z"
    copies = spark.createDataFrame([(i, f"http://c.com/{i}", page(1)) for i in range(4)], "page_id long, url string, html string")
    assert all("Own text" in r.text for r in pagetext.extract(copies).collect())
    assert pagetext.extract(df.limit(0)).count() == 0
