"""Substring dedup: sliding runs of consecutive sentences, joined globally by hash.

A sentence ends after . ! ? before white space, or at a line break; one without
a word is none.  A sentence of more than ``longest`` words, as in text without
stops, is cut where the hash of two neighbouring words says so, and at the latest
after ``piece`` words, so that equal stretches are cut alike.  A run is several
consecutive sentences, at least two, with at least ``min_words`` words.

A run repeated elsewhere makes every run inside it repeated too.  So of all runs
only the shortest from each sentence and the shortest to each sentence need a
hash: they are runs, and they cover just what all repeated runs cover.  Each
document yields each of its 128-bit run hashes once.  The first document of a
hash is that of least id; in every other document, and at every later place in
the same one, the run's sentences are removed.  What stays keeps its white space.

Per hash the join carries only the first document, so a passage that a third of
all documents share costs a row per document and is dealt by Spark's skew join.

Defined results: a null text stays null with no sentence; empty texts and those
without a word stay as they are; rows with equal doc_id are one document and
are treated alike; rows without an id are documents by their texts, before all
others (ids lie above -2 ** 62); an empty table gives an empty result; other
columns, whatever their names, are kept by ``dedup_spans`` unless a result
column has their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, slices, small_batches, stored

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_BREAK = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*")


@dataclass(frozen=True)
class Settings:
    min_words: int = 24
    longest: int = 50
    piece: int = 32


def _doc() -> Column:
    """The document a row belongs to."""
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(-(1 << 63))
    return F.coalesce(F.col("doc_id").cast("bigint"), unnamed)


def _pieces(found: list[bytes], most: int) -> list[int]:
    """Where a long sentence is cut, the end included."""
    out, at = [], 0
    for i in range(1, len(found)):
        if i - at >= most or (i - at >= most // 4 and xxhash.xxh64_intdigest(found[i - 1] + b" " + found[i]) % 16 == 0):
            out.append(i)
            at = i
    return [*out, len(found)]


def sentences(text: bytes, s: Settings, hashed: bool = True) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """Byte spans of the sentences, each with the white space up to the next; their words; their hashes, if asked for."""
    spans, words, hashes, at = [], [], [], 0

    def add(start: int, after: int, found: list[bytes]):
        spans.append((start, after))
        words.append(len(found))
        if hashed:
            hashes.append(xxhash.xxh3_128_digest(b" ".join(found)))

    for m in [*_BREAK.finditer(text), None]:
        stop, after = (m.start(), m.end()) if m else (len(text), len(text))
        found = text[at:stop].split()
        if len(found) > s.longest:
            starts = [w.start() for w in _WORDS.finditer(text, at, stop)]
            i = 0
            for j in _pieces(found, s.piece):
                add(at if i == 0 else starts[i], starts[j] if j < len(found) else after, found[i:j])
                i = j
        elif found:
            add(at, after, found)
        elif spans:
            spans[-1] = (spans[-1][0], after)
        at = after
    return spans, words, hashes


def runs(words: list[int], hashes: list[bytes], s: Settings) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """First and end sentence of each run, and its hash."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + s.min_words), i + 2)
    back = np.minimum(np.searchsorted(total, total[1:] - s.min_words, "right") - 1, i - 1)
    fits, reaches = end <= n, back >= 0
    pairs = sorted({*zip(i[fits].tolist(), end[fits].tolist()), *zip(back[reaches].tolist(), (i[reaches] + 1).tolist())})
    data = b"".join(hashes)
    got = b"".join([xxhash.xxh3_128_digest(data[16 * a : 16 * b]) for a, b in pairs])
    return [a for a, _ in pairs], [b for _, b in pairs], list(map(tuple, np.frombuffer(got, "<i8").reshape(-1, 2).tolist()))


#: Stands for a document that repeats a run of its own.
OWN = (0, 0)


def run_hashes(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc, h, g): each document's run hashes, once, and OWN if it has one twice."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            ids, out_id, out_h = batch.column(0).to_pylist(), [], []
            for doc, text in zip(ids, texts):
                _, words, hashes = sentences(text or b"", s)
                every = runs(words, hashes, s)[2]
                h = set(every)
                if len(h) < len(every):
                    h.add(OWN)
                out_h.extend(h)
                out_id.extend([doc] * len(h))
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), *(pa.array(x, pa.int64()) for x in (zip(*out_h) if out_h else ((), ())))], names=["doc", "h", "g"])

    return docs.select(_doc().alias("doc"), F.col("text").cast("binary")).mapInArrow(kernel, "doc bigint, h bigint, g bigint")


def remove(text: bytes, repeated: set[tuple], s: Settings) -> tuple[bytes, int, int]:
    """The text without the sentences of repeated runs, or of runs seen before in it; sentences, and how many went."""
    if not repeated:  # nothing to hash for
        return text, len(sentences(text, s, hashed=False)[0]), 0
    spans, words, hashes = sentences(text, s)
    gone = np.zeros(len(spans), bool)
    seen: set[tuple] = set()
    for a, b, h in zip(*runs(words, hashes, s)):
        if h in repeated or h in seen:
            gone[a:b] = True
        seen.add(h)
    if not gone.any():
        return text, len(spans), 0
    head = text[: spans[0][0]]
    return head + b"".join(text[a:b] for (a, b), x in zip(spans, gone) if not x), len(spans), int(gone.sum())


def dedup_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with text cleaned, and n_sentences and n_removed."""
    s = settings
    small_batches(docs.sparkSession)
    found = stored(run_hashes(docs, s), "runs")
    own = (F.col("h") == OWN[0]) & (F.col("g") == OWN[1])
    first = found.where(~own).groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("h", "g", "first")
    doc, mine = free(docs.columns, "doc"), free(docs.columns, "repeated")
    later = found.join(first, ["h", "g"]).where("doc <> first").select("doc", "h", "g")
    repeated = later.unionByName(found.where(own)).groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.array("h", "g")).alias(mine))
    rows = docs.withColumn(doc, _doc()).join(repeated, doc, "left").drop(doc)
    keep = [f for f in docs.schema.fields if f.name not in ("n_sentences", "n_removed")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            lists = batch.column(batch.schema.get_field_index(mine)).to_pylist()
            got = [(None, 0, 0) if t is None else remove(t, set(map(tuple, r or ())), s) for t, r in zip(texts, lists)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            cols[names.index("text")] = pa.array([x[0] for x in got], pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=[*names, "n_sentences", "n_removed"])

    return rows.mapInArrow(kernel, schema)
