"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Items are cut into windows of 13 consecutive words.  Patterns of one length m
form a class.  A class has a shift table keyed by the last block of two words
(how far the search may move when a block ends at this place of a pattern), a
bucket of patterns per block at their end, and a prefix check before the words
are compared one by one.  The search reads a document's words once per class and
skips up to m - 1 words at a time.

The benchmark is a stated query set.  Tables for at most ``block_words`` pattern
words are built on the driver and broadcast at a time; a larger benchmark is
searched in several such blocks, each over all rows, so what is held is bounded;
an item longer than a block goes on in the next.

Defined results: a null text, or one with no word, has n_words 0 and is not
contaminated; null or word-less items are never found; a repeated item text
counts once per item_id, repeated rows of an item once; items with a null id
are searched, and named by no id; rows tie nowhere; empty tables give empty
results or no hits; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, slices, small_batches, stored

WINDOW = 13
#: Maps bytes: A-Z to a-z, bytes between words to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    return (tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1) if item else 0))


class WuManber:
    """Search tables for patterns (tuples of words) with the item numbers they belong to."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.classes = []
        for m in sorted({len(p) for p in patterns}):
            block = min(2, m)
            shift: dict = {}
            bucket: dict = {}
            for p, items in patterns.items():
                if len(p) != m:
                    continue
                for end in range(block, m + 1):
                    key = p[end - 1] if block == 1 else (p[end - 2], p[end - 1])
                    shift[key] = min(shift.get(key, m), m - end)
                bucket.setdefault(p[-1] if block == 1 else p[-2:], []).append((p[0], p, sorted(items)))
            self.classes.append((m, block, shift, bucket))

    def search(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words inside an occurrence, not merged, and the items found."""
        spans, found, n = [], set(), len(doc)
        for m, block, shift, bucket in self.classes:
            at, most = m - 1, m - block + 1
            get = shift.get
            while at < n:
                key = doc[at] if block == 1 else (doc[at - 1], doc[at])
                step = get(key, most)
                if step:
                    at += step
                    continue
                start = at - m + 1
                for first, p, items in bucket.get(key, ()):
                    if doc[start] == first and tuple(doc[start : at + 1]) == p:
                        spans.append((start, at + 1))
                        found.update(items)
                at += 1
        return spans, found


def _covered(spans: list[tuple[int, int]]) -> int:
    n = end = 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = 0.05, block_words: int = 4_000_000, drop: bool = False) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (of words).

    drop=True: the rows of docs that are not contaminated, with docs' columns only.
    A document is contaminated if n_hit > 0 and n_hit >= min_share * n_words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    share = Fraction(str(min_share))  # as written: 0.3 is 3 / 10
    block, held = {}, 0
    names: dict = {}
    # the stated query set goes through the driver one row at a time; only a block is held
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).distinct().toLocalIterator()
    done = docs
    carry = free(docs.columns, "spans"), free(docs.columns, "items")
    for row in rows:
        for p in windows(words(None if row.t is None else bytes(row.t)), window):
            if held > block_words:  # looked at within an item too, so that a long one is cut
                done = stored(_pass(spark, done, block, names, share, carry, False, False, done is docs), "decontam")
                block, held, names = {}, 0, {}
            held += 0 if p in block else len(p)
            block.setdefault(p, set()).add(names.setdefault(row.i, len(names)))
    return _pass(spark, done, block, names, share, carry, drop, True, done is docs)


def _pass(spark, docs: DataFrame, patterns: dict, names: dict, share: Fraction, carried: tuple[str, str], drop: bool, last: bool, first: bool) -> DataFrame:
    """One block's search over all rows; what earlier blocks found is carried in two more columns."""
    spans_, items_ = carried
    tables = spark.sparkContext.broadcast((WuManber(patterns), {n: i for i, n in names.items()}))
    src = [c for c in docs.columns if c not in carried] if not first else docs.columns
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    names_new = {f.name for f in new}
    keep = [f for f in docs.schema.fields if f.name in src and (drop or not last or f.name not in names_new)]
    carry = [T.StructField(spans_, T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField(items_, T.ArrayType(T.StringType()))]
    schema = T.StructType(keep + ([] if drop else new) if last else keep + carry)
    keep_names = [f.name for f in keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = tables.value
        for batch, texts in slices(batches, "text"):
            held = [] if first else list(zip(batch.column(batch.schema.get_field_index(spans_)).to_pylist(), batch.column(batch.schema.get_field_index(items_)).to_pylist(), strict=True))
            out = []
            for k, text in enumerate(texts):
                doc = words(text)
                spans, found = table.search(doc)
                named = {ids[x] for x in found if ids[x] is not None}
                if not first:
                    spans += [tuple(x) for x in held[k][0]]
                    named |= set(held[k][1])
                if not last:
                    out.append((_merged(spans), sorted(named)))
                    continue
                hit = _covered(spans)
                bad = hit > 0 and share.denominator * hit >= share.numerator * len(doc)
                out.append((len(doc), hit, len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bad, [{"start": a, "end": b} for a, b in _merged(spans)]))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep_names]
            if last and drop:
                yield pa.RecordBatch.from_arrays(cols, names=keep_names).filter(pa.array([not x[4] for x in out], pa.bool_()))
            elif last:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=keep_names + [f.name for f in new])
            else:
                yield pa.RecordBatch.from_arrays(cols + [pa.array([[list(s) for s in x[0]] for x in out], pa.list_(pa.list_(pa.int32()))), pa.array([x[1] for x in out], pa.list_(pa.string()))], names=keep_names + [spans_, items_])

    return docs.mapInArrow(kernel, schema)
