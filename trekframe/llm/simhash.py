"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

A fingerprint is cut into ``blocks`` runs of bits.  Two that differ in at most
``max_diff`` bits agree on at least ``blocks - max_diff`` runs, so both carry the
key of one such choice of runs.  Distinct fingerprints, each once, are grouped by
key; a group is verified by XOR and bit count and yields a spanning forest of its
links, never its pairs.  A key held by more than ``group`` fingerprints is cut
into chunks, and each pair of chunks is a group of its own, so no task gathers
more than two chunks and no link is lost.  Components over the links give the
least doc_id reachable.

Defined results: a null, empty or blank text has no word and fingerprint zero,
which links like any other; fewer words than a shingle are one shingle; a word of
any length is whole; rows with equal doc_id are the same document; a null doc_id
is fingerprinted, and its component is the least id that is not null, or null;
an empty table gives an empty result; other columns are ignored, or kept by
``near_dedup``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free, slices, small_batches, stored


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and \\x20 \\x09-\\x0D
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    n, total = len(hashes), np.zeros(64, np.int64)
    data = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    for i in range(0, n, 8192):
        total += np.unpackbits(data[i : i + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp: the bits as a signed bigint) of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fp)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(kernel, "doc_id bigint, fp bigint")


def block_masks(max_diff: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - max_diff of the runs, as signed 64-bit integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(runs, blocks - max_diff)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(left: np.ndarray, right: np.ndarray | None, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside left, or between left and right and inside both.

    Breadth first with numpy rows: a vector leaves the search once it is reached.
    """
    rest = np.unique(left if right is None else np.concatenate([left, right])).view(np.uint64)
    a, b = [], []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                left_out = np.flatnonzero(~near)
                if not len(left_out):
                    break
                near[left_out] = (np.bitwise_count(front[i : i + 64, None] ^ rest[None, left_out]) <= max_diff).any(axis=0)
            front, rest = rest[near], rest[~near]
            if len(front):
                a.append(np.full(len(front), root))
                b.append(front)
    none = np.empty(0, np.uint64)
    return np.concatenate(a or [none]).view(np.int64), np.concatenate(b or [none]).view(np.int64)


def block_count(n: int, max_diff: int, mean: int = 256) -> int:
    """The number of runs: max_diff + 2, or more where a key would hold over mean of n spread fingerprints."""
    blocks = max_diff + 2
    while blocks < 4 * max_diff and n > mean << (64 * (blocks - max_diff) // blocks):
        blocks += 1
    return blocks


def links(fps: DataFrame, max_diff: int = 4, blocks: int | None = None, group: int = 8192) -> DataFrame:
    """(a, b): links between distinct fingerprints fps(fp) that connect all that differ in at most max_diff bits.

    Any number of runs beyond max_diff finds all of them: it only sets the size of the keys.
    """
    blocks = blocks or block_count(fps.count(), max_diff)
    keyed = fps.select("fp", F.inline(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(block_masks(max_diff, blocks))))))
    large = stored(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > group), "large-keys")
    some = not large.isEmpty()
    small = keyed.join(large, ["c", "k"], "left_anti") if some else keyed
    groups = small.groupBy("c", "k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    if some:
        cut = F.ceil(F.col("n") / group).cast("int")
        parts = keyed.join(large, ["c", "k"]).withColumns({"cut": cut, "own": F.pmod(F.xxhash64("fp"), cut).cast("int")})
        pairs = parts.select("c", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
        pairs = pairs.groupBy("c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        groups = groups.union(pairs.agg(F.collect_list("fp").alias("fps")).select("fps"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(offsets)
            two = offsets[:-1][size == 2]
            x, y = flat[two], flat[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= max_diff
            a, b = [x[near]], [y[near]]
            for i in np.flatnonzero(size > 2):
                p, q = forest(flat[offsets[i] : offsets[i + 1]], None, max_diff)
                a.append(p)
                b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return groups.mapInArrow(kernel, "a bigint, b bigint")


def _classes(docs: DataFrame, shingle: int, max_diff: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row of docs, and (fp, component, component_id) of every fingerprint."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    comp = components(links(classes.select("fp"), max_diff))
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, named.join(least, "component").select("fp", "component", "component_id")


def near_components(docs: DataFrame, shingle: int = 4, max_diff: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    rows, to = _classes(docs, shingle, max_diff)
    return rows.join(to, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 4, max_diff: int = 4) -> DataFrame:
    """The rows of docs that stand for their component: one of each, with its least doc_id.

    Where several rows have that id, the one whose text has the least hash stands
    for it.  Rows without an id stand for a component only where all of it has
    none.
    """
    rows, to = _classes(docs, shingle, max_diff)
    id_, n, hash_ = (free(docs.columns, x) for x in ("__id", "__rows", "__text"))
    kept = rows.join(to, "fp").where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias(n)).select(F.col("doc_id").alias(id_), n)
    found = docs.join(kept, F.col("doc_id") == F.col(id_))
    once = found.where(F.col(n) == 1).drop(id_, n)
    # rows whose id is repeated or null are rare; only they are told apart by their texts
    rest = found.where(F.col(n) > 1).drop(id_, n)
    if not rows.where("doc_id IS NULL").isEmpty():
        rest = rest.unionByName(docs.where("doc_id IS NULL"))
    rest = rest.withColumn(hash_, F.xxhash64("text"))
    fps = fingerprints(rest.select(F.col(hash_).alias("doc_id"), "text"), shingle).select(F.col("doc_id").alias(hash_), "fp")
    best = fps.join(to, "fp").groupBy("component", F.col("component_id").alias(id_)).agg(F.min(hash_).alias(n)).select(id_, n)
    stands = rest.join(best, (F.col(hash_) == F.col(n)) & F.col("doc_id").eqNullSafe(F.col(id_))).dropDuplicates(["doc_id", hash_])
    return once.unionByName(stands.drop(id_, n, hash_))
