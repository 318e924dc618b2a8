"""Substring dedup over suffix arrays, sorted deep-shallow.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Sorting every suffix of a corpus would move many times its size, so suffixes are
first grouped by anchors.  The anchor of a string is its stretch of ``gram``
bytes with the least hash, the first of several; equal strings have it at the same
place.  An anchor's window holds every string of which it is the anchor.

* Windows that are equal as a whole are found by their 128 bits of hashes: all but
  the first go.  Only the first ones of anchors with several different windows are
  sorted.
* Their suffixes from the anchor on, and their reversed prefixes before it, are
  sorted by multikey quicksort, eight bytes a key, to a shallow depth; groups that
  agree so far are ordered by blind tries, which branch on single bytes and compare
  a suffix once.  Neighbours tell how far a window agrees with any other to either
  side, and so which of its strings can repeat at all.
* The suffixes at these strings' starts are sorted likewise; runs with a common
  prefix of the whole length are equal strings, and all but the first go.

Anchors are dealt by hash.  Those that a sample (``sample`` of the rows) shows to
hold over ``heavy`` of its anchors are dealt by window and by string instead, and
their strings are reduced to the first in each slice of rows before they move; so a
passage that a third of all documents share never meets in one task.  The sample
decides on which way rows go, not on results.

Defined results: null and empty texts, and those under ``length`` bytes, lose
nothing; a null text stays null; rows with equal doc_id are one document, in which
a string starts earlier only by its place, so repeated rows are treated alike; rows
without an id are documents by their texts, before all others (ids lie above -2 **
62); matches never cross documents and may end within a character (the text that
stays is then read with U+FFFD); an empty table gives an empty result; other
columns stay, unless a result column has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, slices, small_batches, stored
from .spans import _doc

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: Starts that are looked at together; their places take the low bits of a hash.
_BLOCK = 1 << 22
#: Bytes on which suffixes are compared by quicksort before tries take over.
SHALLOW = 48


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    sample: float = 1 / 64
    heavy: float = 1 / 20_000

    @property
    def left(self) -> int:
        """Bytes of a window before its anchor."""
        return self.length - self.gram


# --- anchors ---


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the machine's order."""
    return np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))


def anchors(data: np.ndarray, inside: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings; inside: whether the string from a place on lies in one document."""
    word, places, hashes = _words(data), [], []
    span = s.left + 1
    for at in range(0, len(inside), _BLOCK):
        starts = min(_BLOCK, len(inside) - at)
        n = starts + span - 1
        h = word[at : at + n] * _MIX[0]
        for j in range(1, -(-s.gram // 8)):
            h ^= h >> np.uint64(29)
            off = at + min(8 * j, s.gram - 8)
            h += word[off : off + n]
            h *= _MIX[j % 4]
        h ^= h >> np.uint64(32)
        low = np.uint64(_BLOCK * 2 - 1)
        least, width = (h & ~low) | np.arange(n, dtype=np.uint64), 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :])
        found = (least & low).astype(np.int64)[inside[at : at + starts]]
        found = found[np.flatnonzero(np.diff(found, prepend=-1))]
        places.append(found + at)
        hashes.append(h[found])
    return np.concatenate(places), np.concatenate(hashes).view(np.int64)


class Slice:
    """Some documents' texts of at least a string's length, joined."""

    def __init__(self, texts: list[bytes | None], s: Settings):
        self.rows = [i for i, t in enumerate(texts) if t is not None and len(t) >= s.length]
        self.text = b"".join([texts[i] for i in self.rows])
        self.size = np.array([len(texts[i]) for i in self.rows], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def windows(self, s: Settings) -> tuple[np.ndarray, ...]:
        """(document, place in it, bytes before the anchor, bytes in all, anchor's hash, window's hash) of each anchor."""
        if not self.rows:
            return (np.zeros(0, np.int64),) * 6
        data = np.frombuffer(self.text + bytes(s.length + 8), np.uint8)
        inside = np.ones(len(self.text), bool)
        for end in (self.start + self.size).tolist():
            inside[end - s.length + 1 : end] = False
        at, g = anchors(data, inside, s)
        doc = np.searchsorted(self.start, at, "right") - 1
        left = np.minimum(at - self.start[doc], s.left)
        size = left + np.minimum(self.start[doc] + self.size[doc] - at, s.length)
        first, view = at - left, memoryview(self.text)
        w = np.array([xxhash.xxh3_64_intdigest(view[a:b], x) for a, b, x in zip(first.tolist(), (first + size).tolist(), left.tolist())], np.uint64).view(np.int64)
        return doc, first - self.start[doc], left, size, g, w


def pack(left, size):
    """One number for a stretch's bytes before its anchor and its bytes; the former also seed its hash."""
    return size * 128 + left


def digest(data: bytes, packed: int) -> int:
    h = xxhash.xxh3_64_intdigest(data, packed % 128)
    return h - (1 << 64) if h >> 63 else h


MARK = "kind int, part bigint, g bigint, w bigint, doc bigint, a bigint, b bigint"
WINDOW, GONE = 0, 1


def _batch(schema: str, *cols) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def marks(docs: DataFrame, heavy: list[int], s: Settings) -> DataFrame:
    """A WINDOW row for the first of each window's copies in a slice of rows, and GONE rows for what the others cover."""
    known = np.array(sorted(heavy), np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", max_rows=4096):
            part = Slice(texts, s)
            ids = np.array(batch.column(0).to_pylist(), np.int64)[part.rows]
            row, a, left, size, g, w = part.windows(s)
            if not len(row):
                continue
            doc = ids[row]
            order = np.lexsort((a, doc, w, g))
            again = np.zeros(len(order), bool)
            same = (np.diff(g[order]) == 0) & (np.diff(w[order]) == 0)
            head = np.flatnonzero(np.append(True, ~same))
            lead = order[np.repeat(head, np.diff(np.append(head, len(order))))]  # the first of each window's copies
            again[order] = (doc[lead] != doc[order]) | (a[lead] != a[order])
            keep = np.flatnonzero(~again)
            own = np.isin(g[keep], known)
            yield _batch(MARK, np.full(len(keep), WINDOW), np.where(own, w[keep] | 1, 0), g[keep], w[keep], doc[keep], a[keep], pack(left, size)[keep])
            gone: dict[int, list[tuple[int, int]]] = {}
            k = np.flatnonzero(again)
            for i, x, y in zip(row[k].tolist(), a[k].tolist(), (a + size)[k].tolist()):
                gone.setdefault(i, []).append((x, y))
            out = [(i, x, y) for i, spans in gone.items() for x, y in _merged(spans)]
            if out:
                i, x, y = (np.array(c, np.int64) for c in zip(*out))
                begin = part.start[i] + x
                hashes = [digest(part.text[p:q], 0) for p, q in zip(begin.tolist(), (begin + y - x).tolist())]
                yield _batch(MARK, np.full(len(i), GONE), ids[i], ids[i], hashes, ids[i], x, pack(0, y - x))

    return docs.mapInArrow(kernel, MARK)


# --- sorting ---


def blind_order(text: bytes, starts: list[int], base: int, depth: int) -> list[int]:
    """The order of the strings from these starts on, up to depth; they agree on the first base bytes.

    A node is [depth, a start below it, children by byte]; a leaf has depth
    ``depth`` and the list of its strings.  The way down looks at branching bytes
    only, then one comparison tells where the string leaves it.
    """
    root: list = [depth, starts[0], [0]]
    for k in range(1, len(starts)):
        at, node = starts[k], root
        while node[0] < depth and (below := node[2].get(text[at + node[0]])) is not None:
            node = below
        near = node[1]
        differ = int.from_bytes(text[at + base : at + depth]) ^ int.from_bytes(text[near + base : near + depth])
        if not differ:
            node[2].append(k)
            continue
        common = depth - (differ.bit_length() + 7) // 8
        above, node = None, root
        while node[0] < common:
            above, node = node, node[2][text[at + node[0]]]
        leaf = [depth, at, [k]]
        if node[0] == common:
            node[2][text[at + common]] = leaf
            continue
        split = [common, node[1], {text[node[1] + common]: node, text[at + common]: leaf}]
        if above is None:
            root = split
        else:
            above[2][text[at + above[0]]] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] == depth:
            out.extend(node[2])
        else:
            stack.extend([node[2][x] for x in sorted(node[2], reverse=True)])
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the strings of depth bytes from these starts on, each group (ascending) for itself.

    lcp: bytes in common with the one before in the order, 0 at a group's first.
    data is followed by zeros.  Multikey quicksort goes on for all groups at once:
    each splits by a pivot into less, equal and greater; only equal ones move on by
    eight bytes.
    """
    n = len(starts)
    word = _words(data)
    order, seg, deep = np.arange(n), group.copy(), np.zeros(n, np.int64)
    shallow = min(shallow, depth) // 8 * 8
    live = np.arange(n)
    while len(live):
        head = np.flatnonzero(np.diff(seg[live], prepend=-1))
        size = np.diff(np.append(head, len(live)))
        going = np.repeat((size > 1) & (deep[live[head]] < shallow), size)
        live = live[going]
        if not len(live):
            break
        key = word[starts[order[live]] + deep[live]].byteswap()
        head = np.flatnonzero(np.diff(seg[live], prepend=-1))
        size = np.diff(np.append(head, len(live)))
        three = np.sort(np.stack([key[head], key[head + size // 2], key[head + size - 1]]), axis=0)[1]
        pivot, which = np.repeat(three, size), np.repeat(np.arange(len(head)), size)
        side = which * 3 + (key >= pivot) + (key > pivot)
        turn = np.argsort(side, kind="stable")
        order[live], side = order[live[turn]], side[turn]
        deep[live] += 8 * (side % 3 == 1)
        # segments take the place of their first element as number, so they stay apart and ascend
        first = np.flatnonzero(np.diff(side, prepend=-1))
        seg[live] = n + np.repeat(live[first], np.diff(np.append(first, len(side))))
    # what agrees so far
    head = np.flatnonzero(np.diff(seg, prepend=-1)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    text = data.tobytes()
    for a, m in zip(head[size > 1].tolist(), size[size > 1].tolist()):
        own = order[a : a + m]
        order[a : a + m] = own[blind_order(text, starts[own].tolist(), shallow, depth)]
    lcp = np.zeros(n, np.int64)
    if n:
        a, b = starts[order[:-1]], starts[order[1:]]
        open_ = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        for at in range(0, depth, 8):
            x = (word[a[open_] + at] ^ word[b[open_] + at]).byteswap()
            same = x == 0
            bits = np.frexp((x >> np.uint64(11)).astype(np.float64))[1]  # places of the highest bit, by the upper 53 bits
            bits = np.where(x >> np.uint64(11) > 0, bits + 11, np.frexp(x.astype(np.float64))[1])
            lcp[open_ + 1] = at + np.where(same, 8, (64 - bits) // 8)
            open_ = open_[same]
        lcp = np.minimum(lcp, depth)
    return order, lcp


def _nearest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The most bytes each string shares with another of its group."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def repeated(windows: list[tuple[int, int, int, int, bytes]], s: Settings) -> Iterator[tuple[int, int, int, int]]:
    """(document, start, packed, hash) of the stretches that strings which start earlier cover.

    windows: (key, document, start, packed, bytes); keys ascend, and only windows of one key are compared.
    """
    keys, docs, begin, packed = (np.array(x, np.int64) for x in zip(*(w[:4] for w in windows)))
    n, left, size = len(keys), packed % 128, packed // 128
    width = s.left + s.length + 8
    data = np.zeros(n * width + 2 * s.length + 16, np.uint8)
    first = np.arange(n) * width + s.left - left
    data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.frombuffer(b"".join([w[4] for w in windows]), np.uint8)
    group = np.cumsum(np.diff(keys, prepend=keys[0]) != 0)
    after = _nearest(*deep_shallow(data, np.arange(n) * width + s.left, group, s.length))
    turned = np.zeros((n, s.left + 8), np.uint8)
    turned[:, : s.left] = data[: n * width].reshape(n, width)[:, s.left - 1 :: -1] if s.left else 0
    turned = np.append(turned.reshape(-1), np.zeros(s.left + 16, np.uint8))
    before = _nearest(*deep_shallow(turned, np.arange(n) * (s.left + 8), group, s.left, SHALLOW // 2))
    most, least = np.minimum(before, left), s.length - np.minimum(after, size - left)
    many = np.maximum(most - least + 1, 0)
    of = np.repeat(np.arange(n), many)
    if not len(of):
        return
    back = np.repeat(least - (np.cumsum(many) - many), many) + np.arange(len(of))  # bytes before the anchor
    order, lcp = deep_shallow(data, of * width + s.left - back, group[of], s.length)
    run = np.cumsum(lcp < s.length)
    doc, start = docs[of][order], (begin + left)[of][order] - back[order]
    by = np.lexsort((start, doc, run))
    lead = by[np.searchsorted(run[by], run)]
    gone = (doc[lead] != doc) | (start[lead] != start)
    of, back = of[order][gone], back[order][gone]
    by = np.lexsort((back, of))
    of, back = of[by], back[by]
    head = np.flatnonzero(np.diff(of, prepend=-1))
    for i, near, far in zip(of[head].tolist(), back[head].tolist(), back[np.append(head[1:], len(of)) - 1].tolist()):
        off, m = int(left[i]) - far, s.length + far - near
        yield int(docs[i]), int(begin[i]) + off, pack(0, m), digest(windows[i][4][off : off + m], 0)


# --- jobs ---


CASE = "key bigint, doc bigint, a bigint, b bigint, w bigint, data binary"
FOUND = "doc bigint, a bigint, b bigint, w bigint"


def cases(rows: DataFrame, mine: str, s: Settings) -> DataFrame:
    """The bytes of the windows to be sorted; those of heavy anchors as their strings, the first in each slice.  Rows without data are GONE already."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            docs, lists = batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index(mine)).to_pylist()
            out, strings = [], {}
            for doc, text, own in zip(docs, texts, lists):
                for x in own:
                    data = text[x["a"] : x["a"] + x["b"] // 128] if text else b""
                    if digest(data, x["b"]) != x["w"]:
                        continue  # of another row with this id
                    if not x["heavy"]:
                        out.append((x["g"], doc, x["a"], x["b"], x["w"], data))
                        continue
                    for k in range(len(data) - s.length + 1):
                        strings.setdefault(data[k : k + s.length], []).append((doc, x["a"] + k))
            packed = pack(0, s.length)
            for data, found in strings.items():
                found.sort()
                h = digest(data, 0)
                out.append((h, *found[0], packed, h, data))
                out.extend((None, *x, packed, h, None) for x in found[1:] if x != found[0])
            if out:
                yield _batch(CASE, *zip(*out))

    return rows.mapInArrow(kernel, CASE)


def sort_cases(found: DataFrame, s: Settings, most: int = 20_000) -> DataFrame:
    """What goes, of windows gathered by key; keys are sorted together, about ``most`` windows at a time."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            got = [*zip(*repeated(held, s))] if len(held) > 1 else []
            held.clear()
            return _batch(FOUND, *(got or [[]] * 4))

        held: list[tuple] = []
        for batch in batches:
            for key, doc, a, b, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))):
                if len(held) >= most and held[-1][0] != key:
                    yield told()
                held.append((key, doc, a, b, data))
        yield told()

    return found.where("data is not null").repartition("key").sortWithinPartitions("key", "doc", "a").mapInArrow(kernel, FOUND)


def dedup_strings(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with text cleaned, and n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that stay)."""
    s = settings
    if not 8 <= s.gram <= s.length or s.left >= 128:
        raise ValueError("an anchor has 8 bytes at least, and less than 128 fewer than a string")
    small_batches(docs.sparkSession)
    texts = docs.select(_doc().alias("doc"), F.col("text").cast("binary").alias("text"))
    sample = marks(texts.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(s.sample * (1 << 20))), [], s).where(f"kind = {WINDOW}").groupBy("g").count()
    sample = stored(sample, "sample")
    total = sample.agg(F.sum("count")).first()[0] or 0
    # of such anchors there are fewer than 1 / heavy
    heavy = [r.g for r in sample.where(F.col("count") > F.greatest(F.lit(8), F.lit(total * s.heavy))).select("g").collect()]
    by = Window.partitionBy("part", "kind", "g")
    copies = Window.partitionBy("part", "kind", "g", "w").orderBy("doc", "a")  # the same order as by's serves it
    lead = F.first(F.struct("doc", "a")).over(copies)
    known = marks(texts, heavy, s).withColumns({"low": F.min("w").over(by), "high": F.max("w").over(by), "again": lead != F.struct("doc", "a")})
    known = known.select("doc", "a", "b", "w", "g", (F.col("part") != 0).alias("heavy"), ((F.col("kind") == GONE) | F.col("again")).alias("gone"), (F.col("low") != F.col("high")).alias("several"))
    known = stored(known.where("gone or heavy or several"), "windows")
    mine, doc = free(docs.columns, "own"), free(docs.columns, "doc")
    lists = known.where("not gone").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "w", "g", "heavy")).alias(mine))
    found = stored(cases(texts.join(lists, "doc"), mine, s), "cases")
    parts = [known.where("gone"), found.where("data is null"), sort_cases(found, s)]
    spans = parts[0].select("doc", "a", "b", "w").unionByName(parts[1].select("doc", "a", "b", "w")).unionByName(parts[2])
    spans = spans.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("a", "b", "w")).alias(mine))
    rows = docs.withColumn(doc, _doc()).join(spans, doc, "left").drop(doc)
    new = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string())]
    keep = [f for f in docs.schema.fields if f.name not in {x[0] for x in new}]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            out, left = [], []
            for text, own in zip(texts, batch.column(batch.schema.get_field_index(mine)).to_pylist()):
                data = text or b""
                gone = _merged([(x["a"], x["a"] + x["b"] // 128) for x in own or () if digest(data[x["a"] : x["a"] + x["b"] // 128], x["b"]) == x["w"]])
                ends = [0, *(y for _, y in gone)]
                kept = b"".join([data[x:y] for x, y in zip(ends, [*(x for x, _ in gone), len(data)])]) if gone else data
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
                left.append(None if text is None else kept.decode("utf-8", "replace"))
            cols = [pa.array(left, pa.string()) if f.name == "text" else batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c, x[2]) for c, x in zip(zip(*out), new)], names=[f.name for f in keep] + [x[0] for x in new])

    return rows.mapInArrow(kernel, T.StructType(keep + [T.StructField(n, t) for n, t, _ in new]))
