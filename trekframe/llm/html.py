"""Main text of web pages by templates deduced from equivalence classes of tokens.

Tokens of a page are its start tags, end tags and text runs, told apart by the
path of elements they stand in: name, class, id and role of each (digits do not
count), and for plain containers the place among equal siblings.  A token's
occurrence vector holds its count on each page of the host.

1. ``classes``: tokens of equal vectors form a class.  Vectors are compared by
   their number of pages, their sum and two 31-bit sums over hashes of (page,
   count), so they are never gathered, and a host with a third of all pages is
   summed map-side like any other.  Tokens on fewer than half of a host's pages
   are data, not template.  Tags and text runs form classes of their own kind.
2. ``templates``: a class is valid if on every page its tokens stand in one order
   that repeats as a whole, and if that unit lies each time in the same gap of
   the same surrounding class.  These gaps nest the classes into the template of
   the host.  An element is in the template if both its tags are tokens of one
   valid class that occurs once on a page.  The main slot is the deepest article
   or main element of the template with at least ``least`` of the host's text;
   without one, the deepest element with ``share`` of its text and headings.
3. ``extract``: a page's text is what remains in its main slot without the
   template's own text runs.  Those go only where at least ``support`` pages
   have them and they come to at most ``part`` of the slot's other text: pages
   that are copies of one another would make all their text look like template.

Menus, headers, footers, sidebars, forms, scripts and styles are told by element
names.  Words of class, id and role decide only between slots that the template
holds for data alike: such an element in the main slot is dropped (an advert,
reader comments), but never the main slot, the page's article or main element
with the most text, or what encloses them; on a page without any of these,
nothing that holds nearly all of the text.

The scanner reads a page once from left to right; a tag that never ends is text.

Defined results: a null or empty html has empty text; a page without its host's
main slot gives all its text outside boilerplate; null urls share the empty
host; unclosed elements end with their parent, a paragraph with the next block;
repeated rows count as pages; null page_ids are kept; bytes that are no UTF-8
become U+FFFD; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stored
from .urls import split_url

_TAG_END = re.compile(r"""[>"']""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"""<(/?[a-zA-Z][^\s/>"'<]*)([^<>"']*)>""")  # stops at the next <, > or quote
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "noscript", "template", "iframe", "title", "textarea", "svg")}
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text is no main text.
APART = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video"}
#: Words of class, id or role that mark boilerplate.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "signup", "login", "search", "comment", "comments", "disqus", "replies", "reply", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Containers whose place among equal siblings belongs to their path.
PLACED = {"div", "section", "table", "td"}
HEADINGS = {"h1", "h2", "h3"}
_WORD = re.compile(r"[a-z]+")

OPEN, CLOSE, TEXT, BREAK = 1, 2, 3, 4
_BY_WORD, _BY_NAME, _IS_NAMED, _IS_HEADING = 1, 2, 4, 8
_ROOT = 0x5BD1E9955BD1E995


def _hash(parent: int, what: str) -> int:
    d = hashlib.blake2b(what.encode("utf-8", "replace"), digest_size=8, key=parent.to_bytes(8, "little", signed=True)).digest()
    return int.from_bytes(d, "little", signed=True)


_path = lru_cache(maxsize=1 << 14)(_hash)


def _end(role: int) -> int:
    """The end tag's token of a start tag's."""
    return role ^ 0x2545F4914F6CDD1D


@lru_cache(maxsize=1 << 12)
def _signature(name: str, attrs: str) -> tuple[str, int]:
    """What tells a start tag from others of its name, and its flags."""
    flags = (_BY_NAME if name in APART else 0) | (_IS_NAMED if name in ("article", "main") else 0) | (_IS_HEADING if name in HEADINGS else 0)
    if not attrs.strip():
        return name, flags
    found: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(attrs):
        found.setdefault(k.lower(), (a or b or c).lower())
    if found.get("role") in ("article", "main"):
        flags |= _IS_NAMED
    if name not in ("html", "body", "main") and any(w in MARKS for v in found.values() for w in _WORD.findall(v)):
        flags |= _BY_WORD
    return name + "".join(f" {k}={re.sub(r'[0-9]+', '#', v)}" for k, v in sorted(found.items())), flags


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, name with / for an end tag; an empty name for comments and declarations.

    Each position is looked at a bounded number of times: a search that finds
    nothing up to the end of the page ends the scan or is not made again.
    """
    at, size = 0, len(page)
    none = {'"': False, "'": False}
    plain, find = _PLAIN.match, page.find
    while True:
        at = find("<", at)
        if at < 0 or at + 1 >= size:
            return
        m = plain(page, at)
        if m:
            name, attrs = m.groups()
            end = m.end()
        elif page[at + 1] in "!?":
            long = page.startswith("<!--", at)
            end = find("-->", at + 4) + 3 if long else find(">", at) + 1
            if end == 2 and long:
                end = size
            if not end:
                return
            name = attrs = ""
        else:
            m = _NAME.match(page, at + 1 + (page[at + 1] == "/"))
            if not m:
                at += 1
                continue
            end = m.end()
            while True:
                q = _TAG_END.search(page, end)
                if not q:
                    return  # no tag ends beyond this place
                end = q.end()
                mark = q[0]
                if mark == ">":
                    break
                if not none[mark] and _after_equals(page, q.start(), m.end()):
                    close = find(mark, end)
                    if close < 0:
                        none[mark] = True
                    else:
                        end = close + 1
            name, attrs = page[at + 1 : m.end()], page[m.end() : end - 1]
        name = name.lower()
        yield at, end, name, attrs
        raw = _RAW_END.get(name)
        if raw and page[end - 2] != "/":
            m = raw.search(page, end)
            end = m.start() if m else size
            yield end, end, "!", ""  # what lies between is no text
        at = end


def _after_equals(page: str, at: int, least: int) -> bool:
    """Whether a quote opens an attribute's value."""
    at -= 1
    while at > least and page[at] in " \t\n\r\f":
        at -= 1
    return page[at] == "="


def scan(page: str, runs: bool = True) -> list[tuple[int, int, str, int]]:
    """Events (kind, token, text or name, flags of a start tag), in page order; every start has its end.

    Text has a token only if runs are asked for.
    """
    out: list[tuple[int, int, str, int]] = []
    stack: list[tuple[str, int, dict]] = [("", _ROOT, {})]
    opened: dict[str, int] = {}

    def text(value: str):
        run = " ".join(value.split()) if runs else ""
        out.append((TEXT, _hash(stack[-1][1], "\n" + run) if run else 0, value, 0))

    def pop():
        name, role, _ = stack.pop()
        opened[name] -= 1
        out.append((CLOSE, _end(role), name, 0))

    at = 0
    for start, end, name, attrs in _tags(page):
        if start > at and name != "!":
            text(page[at:start])
        at = end
        if not name or name == "!":
            continue
        ends = name[0] == "/"
        if ends:
            name = name[1:]
        if name in BLOCKS:
            out.append((BREAK, 0, "", 0))
            if not ends and opened.get("p"):  # only inline elements can stand above an open p
                while stack[-1][0] != "p":
                    pop()
                pop()
        if name == "br":
            out.append((TEXT, 0, " ", 0))
        if ends:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID and not attrs.endswith("/"):
            sig, flags = _signature(name, attrs)
            if name in PLACED:
                places = stack[-1][2]
                places[sig] = places.get(sig, 0) + 1
                role = _path(stack[-1][1], f"{sig}\t{places[sig]}")
            else:
                role = _path(stack[-1][1], sig)
            out.append((OPEN, role, name, flags))
            stack.append((name, role, {}))
            opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        text(page[at:])
    while len(stack) > 1:
        pop()
    return out


def _size(text: str) -> int:
    return len(text) - sum(map(text.count, " \n\t\r"))


class _Inside:
    """Follows events and tells what each lies in; totals count text outside boilerplate told by names and without shared runs."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, int, int, int]] = []
        self.total = self.heads = self.closed = 0

    def step(self, i: int, event: tuple, shared=frozenset()) -> tuple[int, int, int, int] | None:
        """For an end: (place of its start, text inside, headings inside, 1 if in boilerplate by name)."""
        kind, token, value, flags = event
        if kind == TEXT:
            if not self.closed and token not in shared:
                self.total += _size(value)
                if token and self.stack and self.stack[-1][3] & _IS_HEADING:
                    self.heads += 1
        elif kind == OPEN:
            self.stack.append((i, self.total, self.heads, flags))
            self.closed += bool(flags & _BY_NAME)
        elif kind == CLOSE:
            start, total, heads, flags = self.stack.pop()
            self.closed -= bool(flags & _BY_NAME)
            return start, self.total - total, self.heads - heads, int(self.closed > 0 or bool(flags & _BY_NAME))
        return None


# --- pages to templates ---

def _page_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def _occurrences(raw: bytes) -> dict[tuple[int, int], int]:
    """(kind, token) -> count on the page, without what only scripts and styles hold."""
    out: dict[tuple[int, int], int] = {}
    for kind, token, *_ in scan(raw.decode("utf-8", "replace")):
        if kind != BREAK and token:
            out[kind, token] = out.get((kind, token), 0) + 1
    return out


def _lanes(page: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 31-bit hashes of (page, count) for each count."""
    x = np.uint64(page) ^ (counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(33)).astype(np.int64), (x & np.uint64(0x7FFFFFFF)).astype(np.int64)


def classes(pages: DataFrame) -> DataFrame:
    """(host, kind, token, class, pages, total, all_pages) of tokens on at least half of a host's pages, from pages(host, html).

    class is equal for tokens of one host and kind of token (tag or text) with
    equal occurrence vectors.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "html"):
            held: dict[tuple, list[int]] = {}
            for host, text in zip(batch.column(0).to_pylist(), raw):
                found = _occurrences(text or b"")
                found[0, 0] = 1
                counts = np.fromiter(found.values(), np.int64, len(found))
                for (kind, token), n, a, b in zip(found, counts.tolist(), *(x.tolist() for x in _lanes(_page_key(text or b""), counts))):
                    x = held.get((host, kind, token))
                    if x is None:
                        held[host, kind, token] = [1, n, a, b]
                    else:
                        x[0] += 1
                        x[1] += n
                        x[2] += a
                        x[3] += b
            cols = list(zip(*(k + tuple(v) for k, v in held.items()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["host", "kind", "token", "pages", "total", "v1", "v2"])

    each = pages.select("host", F.col("html").cast("binary")).mapInArrow(kernel, "host bigint, kind bigint, token bigint, pages bigint, total bigint, v1 bigint, v2 bigint")
    sums = each.groupBy("host", "kind", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2"))).where(f"kind <> {TEXT} OR pages >= 3")
    sums = stored(sums, "tokens")
    whole = sums.where("kind = 0").select("host", F.col("pages").alias("all_pages"))
    often = sums.where("kind > 0").join(whole, "host").where("2 * pages >= all_pages")
    return often.select("host", "kind", "token", F.xxhash64(F.col("kind") == TEXT, "pages", "total", "v1", "v2").alias("class"), "pages", "total", "all_pages")


def _with_tables(pages: DataFrame, rows: DataFrame, columns: list[str], few: int):
    """pages with their host's rows: by a broadcast table if rows has at most few rows, else by a join on host.

    Returns a frame whose columns ``columns`` are followed by ``own`` and a
    function from (host, own) to the host's rows as an integer array of three
    columns.  A host's rows are bounded by twice the mean number of tokens of
    its pages, since each of them is on at least half of these.
    """
    if rows.count() <= few:
        table = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 4)  # at most few rows
        table = table[np.argsort(table[:, 0], kind="stable")]
        share = pages.sparkSession.sparkContext.broadcast(table)

        def find(host: int, _) -> np.ndarray:
            t = share.value
            a, b = np.searchsorted(t[:, 0], [host, host + 1])
            return t[a:b, 1:]

        return pages.select(*columns, F.lit(None).cast("array<bigint>").alias("own")), find
    a, b, c = rows.columns[1:]
    lists = rows.groupBy("host").agg(F.flatten(F.collect_list(F.array(a, b, c))).alias("own"))
    return pages.join(lists, "host", "left").select(*columns, "own"), lambda host, own: np.array(own or [], np.int64).reshape(-1, 3)


class _Unit:
    """How one class occurs on a page: its tokens in turn, and what they lie in."""

    def __init__(self) -> None:
        self.seen: list[int] = []
        self.around: list[int] = []

    def verdict(self, size: int) -> tuple[int, int]:
        """A hash of the unit, or 0 if the occurrences do not repeat one; and one of what surrounds it, or 0."""
        unit = self.seen[:size]
        if len(set(unit)) < size or any(self.seen[i : i + size] != unit for i in range(size, len(self.seen), size)):
            return 0, 0
        h = _ROOT
        for t in unit:
            h = _hash(h, str(t))
        return h or 1, (self.around[0] or 1) if len(set(self.around)) == 1 else 0


def _structure(events: list, known: dict[int, int], sizes: dict[int, int], shared: set[int]) -> tuple[dict[int, _Unit], list[tuple], dict[int, int], _Inside]:
    """The page's classes, (token, chars, headings, depth, named, within a marked element) of its elements with a known token, its shared runs, and its totals."""
    units: dict[int, _Unit] = {}
    begun: list[int] = []  # classes of tags whose unit has begun and not ended
    place: dict[int, int] = {}
    inside, elements, words = _Inside(), [], 0
    runs: dict[int, int] = {}
    for i, event in enumerate(events):
        kind, token, value, flags = event
        done = inside.step(i, event, shared)
        if kind == OPEN:
            words += bool(flags & _BY_WORD)
        elif done:
            flags = events[done[0]][3]
            words -= bool(flags & _BY_WORD)
            if _end(token) in known and not done[3]:
                elements.append((_end(token), done[1], done[2], len(inside.stack), int(bool(flags & _IS_NAMED)), int(words > 0)))
        elif kind == TEXT and token in shared:
            runs[token] = _size(value)
        c = known.get(token) if token else None
        if c is None:
            continue
        u, k = units.setdefault(c, _Unit()), place.get(c, 0)
        u.seen.append(token)
        if k == 0:
            u.around.append(_hash(begun[-1], str(place[begun[-1]])) if begun else 1)
            if sizes[c] > 1 and kind != TEXT:
                begun.append(c)
        place[c] = (k + 1) % sizes[c]
        if place[c] == 0 and sizes[c] > 1 and kind != TEXT:
            begun.remove(c)
    return units, elements, runs, inside


def templates(pages: DataFrame, share: float = 0.9, least: float = 0.2, support: int = 8, part: float = 0.25, few: int = 200_000) -> DataFrame:
    """(host, main, drop): the main slot's token of each host's template and the template's text runs to drop, from pages(host, html)."""
    tokens = stored(classes(pages), "classes")
    parted, find = _with_tables(pages, tokens.select("host", "kind", "token", "class"), ["host", "html"], few)

    low_high, add = ("u0", "u1", "s0", "s1"), ("n", "chars", "heads", "depth", "named", "words")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lru_cache(maxsize=64)(lambda host: _tables(find(host, None)))
        for batch, raw in slices(batches, "html"):
            held: dict[tuple, list[int]] = {}
            own = batch.column(2)
            for k, (host, text) in enumerate(zip(batch.column(0).to_pylist(), raw)):
                known, sizes, shared = _tables(find(host, own[k].as_py())) if own[k].is_valid else lookup(host)
                units, elements, runs, inside = _structure(scan((text or b"").decode("utf-8", "replace")), known, sizes, shared)
                for c, u in units.items():
                    (a, b), none = u.verdict(sizes[c]), [0] * 6
                    x = held.setdefault((host, 0, c), [a, a, b, b, *none])
                    x[:4] = min(x[0], a), max(x[1], a), min(x[2], b), max(x[3], b)
                found = [(OPEN, *x) for x in elements] + [(TEXT, token, chars, 0, 0, 0, 0) for token, chars in runs.items()] + [(9, 0, inside.total, inside.heads, 0, 0, 0)]
                for kind, token, *values in found:
                    x = held.setdefault((host, kind, token), [0] * 10)
                    for i, v in enumerate((1, *values)):
                        x[4 + i] += v
            cols = list(zip(*(k + tuple(v) for k, v in held.items()))) or [()] * 13
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["host", "kind", "id", *low_high, *add])

    each = parted.withColumn("html", F.col("html").cast("binary")).mapInArrow(kernel, ", ".join(f"{c} bigint" for c in ("host", "kind", "id", *low_high, *add)))
    sums = each.groupBy("host", "kind", "id").agg(*(F.sum(c).alias(c) for c in add), *((F.max if c[1] == "1" else F.min)(c).alias(c) for c in low_high))
    sums = stored(sums, "structure")
    valid = sums.where("kind = 0 AND u0 = u1 AND u0 <> 0 AND s0 = s1 AND s0 <> 0").select("host", F.col("id").alias("class"))
    good = stored(tokens.join(valid, ["host", "class"]).where("pages = total"), "template")
    ends = good.where(F.col("kind") == CLOSE).select("host", "class", F.col("token").bitwiseXOR(F.lit(_end(0))).alias("token"))
    whole = sums.where("kind = 9").select("host", F.col("chars").alias("all_chars"), F.col("heads").alias("all_heads"))
    elements = sums.where(F.col("kind") == OPEN).select("host", F.col("id").alias("token"), "n", "chars", "heads", "depth", "named", "words")
    slots = good.where(F.col("kind") == OPEN).join(ends, ["host", "class", "token"]).join(elements, ["host", "token"]).join(whole, "host").where("chars > 0 AND (words = 0 OR 2 * chars >= all_chars)")
    named = F.col("named") > 0
    most = F.col("chars") >= F.when(named, least).otherwise(share) * F.col("all_chars")
    fits = most & (named | (F.col("heads") >= share * F.col("all_heads")))
    rank = F.struct(named.alias("named"), (F.col("depth") / F.col("n")).alias("depth"), "chars", "token")
    main = slots.where(fits).groupBy("host").agg(F.max(rank).alias("best")).select("host", F.col("best.token").alias("main"), F.col("best.chars").alias("main_chars"))
    text = good.where((F.col("kind") == TEXT) & (F.col("pages") >= support)).select("host", "token")
    text = text.join(sums.where(F.col("kind") == TEXT).select("host", F.col("id").alias("token"), "chars"), ["host", "token"])
    text = text.groupBy("host").agg(F.collect_list("token").alias("drop"), F.sum("chars").alias("drop_chars"))
    lesser = F.col("drop_chars") <= part * F.coalesce("main_chars", "all_chars")
    return whole.join(main, "host", "left").join(text, "host", "left").select("host", "main", F.when(lesser, F.col("drop")).alias("drop")).where("main IS NOT NULL OR drop IS NOT NULL")


def _tables(rows: np.ndarray) -> tuple[dict[int, int], dict[int, int], set[int]]:
    """token -> class, class -> number of tokens, and the text runs among the tokens."""
    known = {t: c for _, t, c in rows.tolist()}
    sizes: dict[int, int] = {}
    for c in known.values():
        sizes[c] = sizes.get(c, 0) + 1
    return known, sizes, {t for k, t, _ in rows.tolist() if k == TEXT}


# --- extraction ---


def _spared(events: list, main: int, share: float) -> set[int]:
    """Places in events of the elements that a word must not drop.

    They are the main slot, the article and the main element with the most text,
    the first of equals, and what encloses them; without any, what holds at
    least share of the text.  Text in what is boilerplate by its name does not
    count.
    """
    best: dict[object, tuple[int, int]] = {}
    marked: list[tuple[int, int]] = []
    parent: dict[int, int] = {}
    inside = _Inside()
    for i, event in enumerate(events):
        if event[0] == OPEN:
            parent[i] = inside.stack[-1][0] if inside.stack else -1
        done = inside.step(i, event)
        if not done:
            continue
        at, chars = done[:2]
        _, token, name, flags = events[at]
        if flags & _BY_WORD and not flags & _BY_NAME:
            marked.append((at, chars))
        for key in (*([name] if flags & _IS_NAMED else ()), *([0] if token == main else ())):
            if chars and (key not in best or (chars, -at) > best[key]):
                best[key] = (chars, -at)
    kept: set[int] = set()
    for _, at in best.values():
        at = -at
        while at >= 0 and at not in kept:
            kept.add(at)
            at = parent[at]
    if best:
        return kept
    return {at for at, chars in marked if chars and chars >= share * inside.total}


def main_text(page: str, main: int = 0, drop=frozenset(), share: float = 0.9) -> str:
    """The page's text in its main slot, or in the whole page without one."""
    events = scan(page, runs=bool(drop))
    spared = _spared(events, main, share) if any(e[3] & _BY_WORD for e in events) else set()
    met = any(e[1] == main and e[0] == OPEN for e in events)
    out: list[str] = []
    held: list[str] = []
    stack: list[tuple[bool, bool]] = []
    apart, inside = False, not met

    def end():
        block = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if block:
            out.append(block)

    for i, (kind, token, value, flags) in enumerate(events):
        if kind == TEXT:
            if inside and not apart and not (token and token in drop):
                held.append(value)
        elif kind == BREAK:
            end()
        elif kind == OPEN:
            stack.append((apart, inside))
            apart = apart or bool(flags & _BY_NAME) or bool(flags & _BY_WORD and i not in spared)
            if token == main:
                end()
                inside = True
        else:
            was = inside
            apart, inside = stack.pop()
            if was != inside:
                end()
    end()
    return "\n\n".join(out)


def extract(pages: DataFrame, few: int = 200_000) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.  Tables of tokens are broadcast only if they have at most few rows."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html").withColumn("host", F.xxhash64(split_url(F.col("url"))[0]))
    found = stored(templates(rows.select("host", "html"), few=few), "templates")
    flat = found.select("host", F.lit(0).alias("kind"), F.col("main").alias("token"), F.lit(0).alias("class")).where("token IS NOT NULL")
    flat = flat.union(found.where("drop IS NOT NULL").select("host", F.lit(TEXT), F.explode("drop"), F.lit(0)))
    joined, find = _with_tables(rows, flat.selectExpr("host", "bigint(kind)", "token", "bigint(class)"), ["page_id", "url", "html", "host"], few)
    page_id = pages.schema["page_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "html"):
            got = []
            for text, host, own in zip(raw, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                table = find(host, own)
                main = next((t for k, t, _ in table.tolist() if k == 0), 0)
                got.append(main_text((text or b"").decode("utf-8", "replace"), main, {t for k, t, _ in table.tolist() if k == TEXT}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(kernel, f"page_id {page_id}, url string, text string, n_chars bigint")
