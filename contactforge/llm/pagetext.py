"""Main text of web pages: differences between pages with neighbouring URLs, and page structure.

Each page becomes a list of text lines, one for each block. Pages of a host are put in the order of their URL path; a
page is paired with the neighbour in that order whose path shares the longer beginning and whose lines aren't all the
same (a copy shows nothing about the template). The two pages' lines, in whatever part of the page they stand, are
aligned by longest common subsequence. What is aligned is deleted as template, with these exceptions by mark-up:

- A page's own article container (``<article>``, ``<main>`` and the like) breaks the tie about lines inside it: shared
  lines there are the author's text (articles repeat passages, and pages are copied), and stay. In a part whose class
  or id *may* name something else (``related``, ``legal``, ``search`` ...) the neighbour decides even there.
- Elements that are never article text (scripts, navigation, forms, asides, footers), and parts whose class or id says
  plainly what they are (``ads``, ``comments``, ``cookie-banner``), go without a neighbour, as does what stands outside the
  container of a page that has one: adverts and reader comments differ from page to page.

The order over all pages is cut into parts at sampled keys. A first, light pass finds each part's first and last key,
so that these rows can also be sent to the part before and after, and a host of any size is spread over many tasks.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shuffle_partitions, slices, table

RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "datalist", "dialog", "menu", "noscript", "template", "svg", "math", "canvas", "audio", "video", "object", "map", "applet", "fieldset"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class names and ids that say what isn't article, and those that may be part of an article all the same.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promoted", "promotion",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "login",
    "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer", "masthead", "topbar", "toolbar",
    "comment", "comments", "commentlist", "disqus", "share", "sharing", "social", "pagination", "pager",
}
DOUBTFUL = {
    "banner", "notice", "notices", "notification", "alert", "overlay", "widget", "widgets", "reply", "replies", "respond", "discussion", "related", "recommended",
    "recommendations", "search", "copyright", "legal", "disclaimer", "skip", "header",
}
#: Words that only say where or how a part stands.
PLACE = {
    "area", "bar", "bars", "block", "blocks", "body", "bottom", "box", "boxes", "btn", "button", "buttons", "col", "column", "container", "content", "desktop", "first", "form", "global", "group",
    "icon", "icons", "inner", "item", "items", "last", "layout", "left", "link", "links", "list", "main", "media", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "right",
    "row", "secondary", "section", "site", "slot", "sticky", "text", "title", "top", "unit", "user", "users", "wrap", "wrapper", "zone",
}
LAYOUT = {"has", "with", "no", "is", "show", "hide", "without"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PART = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none", re.I)
NEVER_LINE, DOUBTFUL_LINE, PLAIN_LINE = 2, 1, 0


def _marked(name: str) -> int:
    """What one class name or id says: every word of it must be a mark or tell only about place, and one be a mark."""
    parts = [p for p in NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())]
    if not parts or parts[0] in LAYOUT or not set(parts) <= MARKS | DOUBTFUL | PLACE:
        return PLAIN_LINE
    return NEVER_LINE if MARKS & set(parts) else DOUBTFUL_LINE if DOUBTFUL & set(parts) else PLAIN_LINE


def _kind(tag: str, attributes: str) -> str:
    """'never', 'header', 'doubt', 'article' or '' for an element."""
    if tag in NEVER:
        return "never"
    kind = "header" if tag == "header" else "article" if tag in ("article", "main") else ""
    if attributes and not attributes.isspace():
        found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        if role in ROLES or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(re.sub(r"""(class|id|name)\s*=\s*("[^"]*"|'[^']*'|\S+)""", "", attributes)):
            return "header" if role == "banner" and not kind else "never"
        if tag not in ("html", "body", "main"):
            said = max(map(_marked, [*found.get("class", "").split(), *found.get("id", "").split()]), default=PLAIN_LINE)
            if said == NEVER_LINE:
                return "never"
            if said == DOUBTFUL_LINE:
                kind = kind or "doubt"
        if not kind and (role == "main" or found.get("itemprop", "").lower() == "articlebody"):
            kind = "article"
    return kind


def page_lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, NEVER_LINE, DOUBTFUL_LINE or PLAIN_LINE, inside the article container) of every block with text."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, str]] = []  # open block elements, and inline ones of a kind
    held: list[str] = []
    open_of = dict.fromkeys(("never", "header", "doubt", "article", ""), 0)
    at = 0
    in_heading = False

    def flush():
        text = " ".join(unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            inside = bool(open_of["article"])
            never = open_of["never"] or open_of["header"] and not (inside and in_heading)
            lines.append((text, NEVER_LINE if never else DOUBTFUL_LINE if open_of["doubt"] else PLAIN_LINE, inside))

    def close_to(depth: int):
        while len(stack) > depth:
            open_of[stack.pop()[1]] -= 1

    while True:
        found = TOKEN.search(html, at)
        if found is None:
            held.append(html[at:])
            break
        held.append(html[at : found.start()])
        at = found.end()
        closing, tag, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
                if tag in HEADINGS:
                    in_heading = False
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag not in BLOCK:
                        flush()
                    close_to(depth)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            held.append(" ")
            continue
        if tag in EMPTY:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        kind = _kind(tag, rest)
        if tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                close_to(len(stack) - 1)
            if tag in HEADINGS:
                in_heading = True
            if tag == "body":  # closes an open head
                close_to(next((d for d, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        elif not kind:
            continue
        else:
            flush()
        if rest.endswith("/") and tag not in BLOCK:
            continue
        if tag == "p" and not kind:
            continue
        stack.append((tag, kind))
        open_of[kind] += 1
    flush()
    return lines


#: Cells of the alignment table (lines times lines) that are kept as bits at once; larger tables are halved.
TABLE_BITS = 1 << 23


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit-parallel table of the longest common subsequence, one integer for each line of ``a``: bit j is 0 where
    line j of ``b`` lengthens what the lines before it reach."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _reached(row: int, n: int) -> np.ndarray:
    """Length of the longest common subsequence with each beginning of ``b``, the empty one first."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Bit-parallel rows; large tables are cut by halving ``a`` and
    finding where the best path crosses (linear space), so tens of thousands of equal lines take seconds."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, k, j, m = open_.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if (k - i) * (m - j) > TABLE_BITS and k - i > 1:
            half, row = (i + k) // 2, 0
            for row in _rows(a[i:half], b[j:m]):
                pass
            ahead = _reached(row, m - j)
            for row in _rows(a[half:k][::-1], b[j:m][::-1]):
                pass
            cut = j + int((ahead + _reached(row, m - j)[::-1]).argmax())
            open_ += [(i, half, j, cut), (half, k, cut, m)]
            continue
        rows = list(_rows(a[i:k], b[j:m]))
        x, y = k - i, m - j
        while x and y:
            if rows[x - 1] >> (y - 1) & 1:
                y -= 1
                continue
            x -= 1
            if not x or rows[x - 1] >> (y - 1) & 1:
                y -= 1
                out.append((i + x, j + y))
    return sorted(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


LOWEST = -(1 << 63)


def _key(page_id: int | None, url: str | None) -> tuple[str, str, int]:
    return (*split_url(url), LOWEST if page_id is None else page_id)


def _shared(a: list[int], b: list[int]) -> set[int]:
    """Indexes of ``a`` that a longest common subsequence with ``b`` aligns."""
    both = set(a) & set(b)
    mine, theirs = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    return {mine[i] for i, _ in common_subsequence([a[i] for i in mine], theirs)} if both else set()


#: What the neighbour decides about a line: nothing (it stays), all, or nothing as it only takes part in the alignment.
STAYS, OPEN, OUTSIDE = 0, 1, 2


def candidates(html: str) -> tuple[list[str], list[int]]:
    """The lines that take part in the alignment, and what the neighbour decides about each."""
    lines = [x for x in page_lines(html) if x[1] != NEVER_LINE]
    held = any(inside for *_, inside in lines)
    return [x for x, *_ in lines], [OPEN if not held or inside and said == DOUBTFUL_LINE else STAYS if inside else OUTSIDE for _, said, inside in lines]


def main_text(lines: list[str], fate: list[int], own: list[int], others: list[int] | None) -> str:
    """The page's text: ``own`` are the hashes of its lines, ``others`` those of the nearest page, if there is one."""
    cut = _shared(own, others) if others and OPEN in fate else ()
    return "\n".join(x for i, (x, f) in enumerate(zip(lines, fate, strict=True)) if f == STAYS or f == OPEN and i not in cut)


def _nearest(path: str, before: tuple | None, after: tuple | None) -> tuple | None:
    def alike(other):
        n = 0
        for x, y in zip(path, other, strict=False):
            if x != y:
                break
            n += 1
        return n

    if before is None or after is None:
        return before or after
    return after if alike(after[0]) > alike(before[0]) else before


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            yield from b.slice(i, 500).to_pylist()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages have empty text. Null URLs and those without ``://`` form a host of their own; null ids come
    first among equal paths; equal paths are ties that the id breaks. Rows that repeat a page, and other pages with the
    same lines, are copies: neighbours in a row of copies are passed over on either side, as far as the row stands in
    one part of the order; where nothing else is left (a host of copies, or of one page), nothing is deleted. Pages of
    any length and any number of equal lines are compared whole; broken mark-up is read as far as it goes; other
    columns are not read; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parts = shuffle_partitions(spark)
    # Cuts: a bounded sample of keys, in a random but repeatable order of rows.
    light = kept.select("page_id", "url")
    sampled = light.orderBy(F.xxhash64("page_id", "url")).limit(parts * 50).toArrow().to_pylist()
    keys = sorted({_key(r["page_id"], r["url"]) for r in sampled})
    cuts = [keys[i * len(keys) // parts] for i in range(1, parts)] if len(keys) > parts else keys[1:]
    shared = spark.sparkContext.broadcast(cuts)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, tuple] = {}
        high: dict[int, tuple] = {}
        for b in batches:
            for page_id, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = _key(page_id, url)
                p = bisect_right(shared.value, k)
                low[p], high[p] = min(low.get(p, k), k), max(high.get(p, k), k)
        rows = [(p, *k) for held in (low, high) for p, k in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["part", "host", "path", "id"])

    found = map_arrow(light, edges, "part int, host string, path string, id long").groupBy("part").agg(F.min(F.struct("host", "path", "id")).alias("low"), F.max(F.struct("host", "path", "id")).alias("high"))
    ends = sorted((r["part"], tuple(r["low"]), tuple(r["high"])) for r in found.collect())  # one row for each part
    # Last key of a part -> the part after it; first key -> the part before it.
    after = {low: ends[i - 1][0] for i, (_, low, _) in enumerate(ends) if i}
    before = {high: ends[i + 1][0] for i, (_, _, high) in enumerate(ends) if i + 1 < len(ends)}
    halo = spark.sparkContext.broadcast((after, before))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "own", "host", "path", "id", "page_id", "url", "lines", "fate", "hashes"]
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64())]
        for whole in batches:
            for b in slices(whole, 2):
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k = _key(page_id, url)
                    lines, fate = candidates(html or "")
                    hashes = [xxhash.xxh64_intdigest(x.encode()) >> 1 for x in lines]
                    p = bisect_right(shared.value, k)
                    # Texts of lines that can't stay aren't needed any more.
                    rows.append((p, True, *k, page_id, url, [x if f != OUTSIDE else "" for x, f in zip(lines, fate, strict=True)], bytes(fate), hashes))
                    for to in {halo.value[0].get(k), halo.value[1].get(k)} - {None, p}:
                        rows.append((to, False, *k, page_id, None, [], b"", hashes))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            ids, urls, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        out, size = [], 0
        before = None  # the last page unlike the row of copies in hand
        run: list[tuple] = []  # (page_id, url, path) of copies; they differ in nothing else
        like = None
        for row in chain(_read(batches), [None]):
            same_host = row is not None and like is not None and (row["part"], row["host"]) == (like["part"], like["host"])
            if same_host and (row["hashes"], row["fate"] if row["own"] and like["own"] else b"") == (like["hashes"], like["fate"] if row["own"] and like["own"] else b""):
                if row["own"]:
                    if not like["own"]:
                        like = row
                    run.append((row["page_id"], row["url"], row["path"]))
                continue
            after = row if same_host and row["hashes"] != like["hashes"] else None
            done: dict[int, str] = {}
            for page_id, url, path in run:
                near = _nearest(path, (before["path"], before) if before else None, (after["path"], after) if after else None)
                at = -1 if near is None else id(near[1])
                if at not in done:
                    done[at] = main_text(like["lines"], like["fate"], like["hashes"], near[1]["hashes"] if near else None)
                out.append((page_id, url, done[at]))
                size += len(done[at])
                if size > 4_000_000 or len(out) > 5000:
                    yield batch(out)
                    out, size = [], 0
            before = (before if row["hashes"] == like["hashes"] else like) if same_host else None
            like, run = row, [(row["page_id"], row["url"], row["path"])] if row is not None and row["own"] else []
        if out:
            yield batch(out)

    parsed = map_arrow(kept, parse, "part int, own boolean, host string, path string, id long, page_id long, url string, lines array<string>, fate binary, hashes array<long>")
    order = parsed.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("part", "host", "path", "id")
    return map_arrow(order, compare, "page_id long, url string, text string, n_chars long")


def op3_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length; awkward rows as in ``extract``."""
    return extract(table(spark, sf_dir, "pages"))
