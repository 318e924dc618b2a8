"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document is a whole number.  Documents are indexed in blocks
of ``block_docs`` rows in the order of their ids: each term of a block has one
bitmap for each bit of its impacts.  The scores of an item are the sum of its
terms' numbers, added for all rows of a block at once: from the least significant
slice on, bits are added by exclusive or, and carried by and/or.  The best k are
found from the most significant slice down: rows with the bit set go first while
they fit, and where they are too many, only they stay candidates.  What is left at
the last slice has equal scores, and goes by the order of the ids.

Every row is indexed; the items are a stated query set.  They come through the
driver one at a time, in blocks of ``block_terms`` different terms, each over all
rows, so what is broadcast and held is bounded.  Each task keeps the best k of an
item over its blocks; Spark merges those.

Defined results: null texts and those without a term have no score and are not
counted; a term that stands in an item twice counts once; rows of one item_id are
one item; items without a term, or without a document that holds one, return no
row; equal scores go by ascending doc_id, rows without an id last; repeated rows
are documents of their own; empty tables give an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, stored
from .decontam import words

#: The formula's scale, saturation and share of the length.
SCALE, SATURATION, LENGTH_SHARE = 1000, 20, 50


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impacts of terms that occur tf times in documents of n terms."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms
    return weights * (SCALE**3 * tf // (SCALE * tf + SATURATION * m))


def sliced(rows: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (bits, width words) of the values at these rows, in ascending order."""
    bits = int(values.max()).bit_length()
    word, bit = rows >> 6, np.left_shift(np.uint64(1), (rows & 63).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((bits, width), np.uint64)
    for b in range(bits):
        out[b, word[first]] = np.bitwise_or.reduceat(np.where((values >> b) & 1, bit, np.uint64(0)), first)
    return out


def add(total: np.ndarray, number: np.ndarray) -> None:
    """total += number, row by row, with carries from slice to slice."""
    carry = None
    for b in range(len(total)):
        if b < len(number):
            x, held = number[b], total[b]
            either = x ^ held
            if carry is None:
                total[b], carry = either, x & held
            else:
                total[b], carry = either ^ carry, (x & held) | (carry & either)
        elif carry is None or not carry.any():
            return
        else:
            total[b], carry = total[b] ^ carry, total[b] & carry


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k rows with the highest scores above 0, equal scores by ascending row; rows ascend."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, maybe = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    n_sure = 0
    if count(maybe) > k:
        for b in range(len(total) - 1, -1, -1):
            both = maybe & total[b]
            n = n_sure + count(both)
            if n > k:
                maybe = both
            else:
                sure, maybe, n_sure = sure | both, maybe & ~total[b], n
                if n == k:
                    maybe = np.zeros_like(sure)
                    break
    rows = np.sort(np.concatenate([members(sure), members(maybe)[: k - n_sure]]))
    scores = np.zeros(len(rows), np.int64)
    for b in range(len(total)):
        scores |= ((total[b, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
    return rows, scores


def postings(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, n, terms, tf): each row's number of terms, and how often it holds which of the items' terms."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch, texts in slices(batches, "text"):
            n, of, tf = [], [], []
            for text in texts:
                found = words(text)
                counts = Counter(filter(known.__contains__, found))
                n.append(len(found))
                of.append([known[t] for t in counts])
                tf.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(kernel, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def best_of_tasks(index: DataFrame, query, k: int, block_docs: int) -> DataFrame:
    """(item, doc_id, score): each task's k best rows for each item."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = query.value
        best = [(np.zeros(0, np.int64),) * 3 for _ in items]  # scores, rows without an id, ids

        def search(table: pa.Table) -> None:
            ids = table.column("doc_id").combine_chunks()
            missing = np.asarray(ids.is_null()).astype(np.int64)
            table = table.append_column("missing", pa.array(missing)).sort_by([("missing", "ascending"), ("doc_id", "ascending")]).combine_chunks()
            missing, ids = table.column("missing").to_numpy(), table.column("doc_id").fill_null(0).to_numpy()
            of = table.column("terms").combine_chunks()
            row, term, tf = np.repeat(np.arange(len(ids)), of.value_lengths().to_numpy()), of.flatten().to_numpy(), table.column("tf").combine_chunks().flatten().to_numpy()
            value = impacts(weights[term], tf, table.column("n").to_numpy()[row], n_docs, n_terms)
            order = np.argsort(term, kind="stable")
            order = order[value[order] > 0]
            cut = np.flatnonzero(np.diff(term[order], prepend=-1))
            width = -(-len(ids) // 64)
            index = {int(term[part[0]]): sliced(row[part], value[part], width) for part in np.split(order, cut[1:]) if len(part)}
            for i, own in enumerate(items):
                found = [index[t] for t in own if t in index]
                if not found:
                    continue
                # as many slices as the sum of the highest numbers can need
                total = np.zeros((sum((1 << len(x)) - 1 for x in found).bit_length(), width), np.uint64)
                for number in found:
                    add(total, number)
                rows, scores = top(total, k)
                scores, none, names = (np.concatenate(x) for x in zip(best[i], (scores, missing[rows], ids[rows])))
                first = np.lexsort((names, none, -scores))[:k]
                best[i] = scores[first], none[first], names[first]

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                part = batch.slice(at, block_docs)
                held.append(part)
                size += part.num_rows
                if size >= block_docs:
                    search(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            search(pa.Table.from_batches(held))
        for i, (scores, none, names) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), i, np.int32)), pa.array(names, mask=none == 1), pa.array(scores)], names=["item", "doc_id", "score"])

    return index.mapInArrow(kernel, "item int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 6000, block_docs: int = 8192) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs for each of items."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema["item_id"].dataType
    rows = items.select("item_id", F.col("text").cast("binary").alias("t")).distinct().orderBy("item_id").toLocalIterator()
    out, totals = None, None
    own: list[tuple] = []  # the block's items, with their terms
    terms: dict[bytes, int] = {}

    def search() -> None:
        nonlocal out, totals
        index = stored(postings(docs, spark.sparkContext.broadcast(dict(terms))), "postings")
        if totals is None:
            got = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
            totals = got[0], got[1] or 1
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most block_terms rows and an item's
        weights = np.array([weight(totals[0], df.get(i, 0)) for i in range(len(terms))], np.int64)
        found = best_of_tasks(index, spark.sparkContext.broadcast(([sorted(x) for _, x in own], weights, *totals)), k, block_docs)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
        own.clear()
        terms.clear()

    for row in rows:
        found = set(words(None if row.t is None else bytes(row.t)))
        again = bool(own) and own[-1][0] == row.item_id
        if len(terms) >= block_terms and not again:
            search()
        if not again:
            own.append((row.item_id, set()))
        own[-1][1].update(terms.setdefault(t, len(terms)) for t in found)
    search()
    return out
