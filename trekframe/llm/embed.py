"""Embedding near-duplicates: an exact metric range join.

Pivots partition the distinct vectors: each has its home in the cell of its
nearest pivot; pivots that point the same way count once.  A vector also visits every other cell where a partner could be
at home.  The triangle inequality on the sphere rules cells out exactly, by the
vector's angle to the plane that bisects its own pivot and the cell's, and by
the least and greatest angle of the cell's members to every pivot.  A cell with
more than ``cell`` members is cut into several, which visit one another.  Cells
then join independently: a task holds one cell's members, at most ``cell`` in
the mean, and streams its visitors past them in batches.  It counts links and
emits a spanning forest, never the pairs.

In many dimensions angles concentrate, and random vectors visit most cells; the
join stays exact, and its memory bounded, at a cost near that of all pairs.
``max_pivots`` bounds what the driver holds, not the result: beyond that many
cells, cells are cut into more parts instead.

Equal vectors are joined once, with their number.  Defined results: a vector
that is null, empty or zero, or holds a null or non-finite component, links with
nothing and is its own component; shorter vectors count as padded with zeros;
repeated rows are vectors of their own; a null vec_id counts as a link, and is
never a component's id unless all are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Added to every bound: arccos turns a rounding error of 1e-16 near 1 into one of 1e-8 in the angle.
SLACK = 1e-6
#: Pivots nearer than this to an earlier one are left out: the plane between them would be lost in rounding.
APART = 1e-3


def _units(raw: list[bytes], dtype: str, dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim))
    for i, b in enumerate(raw):
        x = np.frombuffer(b, dtype)
        out[i, : len(x)] = x
    return out / np.linalg.norm(out / np.abs(out).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(out).max(axis=1, keepdims=True)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _packed(classes: DataFrame, dtype: str) -> DataFrame:
    """(v: the components as bytes, uid, n)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            raw = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1), batch.column(2)], names=["v", "uid", "n"])

    return classes.select("embedding", "uid", "n").mapInArrow(kernel, "v binary, uid bigint, n bigint")


class _Cell:
    """A cell's members and what its visitors have shown so far."""

    def __init__(self, units, uid, n, least: float):
        self.units, self.uid, self.n, self.least = units, uid, n, least
        self.links = n - 1
        self.root = np.arange(len(uid))  # a root per member, kept flat
        self.edges: list[tuple[int, int]] = []
        for i in range(0, len(uid), 1024):
            hit = self.units[i : i + 1024] @ self.units.T >= least
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
            self.links[i : i + 1024] = self.links[i : i + 1024] + hit @ n
            for k in np.flatnonzero(hit.any(axis=1)):
                roots = np.unique(self.root[np.append(np.flatnonzero(hit[k]), i + k)])
                self._join(roots, int(uid[i + k]), emit_own=False)

    def _join(self, roots: np.ndarray, other: int, emit_own: bool = True) -> None:
        low = roots[0]
        if emit_own:
            self.edges.append((other, int(self.uid[low])))
        for r in roots[1:]:
            self.edges.append((int(self.uid[low]), int(self.uid[r])))
            self.root[self.root == r] = low

    def visit(self, units, uid, n) -> None:
        for i in range(0, len(uid), 1024):
            hit = self.units @ units[i : i + 1024].T >= self.least
            self.links = self.links + hit @ n[i : i + 1024]
            for k in np.flatnonzero(hit.any(axis=0)):
                self._join(np.unique(self.root[np.flatnonzero(hit[:, k])]), int(uid[i + k]))


def near_vectors(vectors: DataFrame, least: float = 0.9, cell: int = 4096, max_pivots: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(valid, F.lit(False))
    # equal vectors meet by hash; those that differ under one hash stay apart
    keyed = rows.where(valid).withColumn("h", F.xxhash64("embedding"))
    classes = keyed.groupBy("h", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    size, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = dim or 1
    count = int(min(max_pivots, max(1, -(-size // cell))))
    chosen = classes.orderBy(F.xxhash64("h"), "uid").limit(count).select("embedding").collect()  # at most max_pivots vectors
    pivots = np.zeros((max(1, len(chosen)), dim))
    for i, r in enumerate(chosen):
        pivots[i, : len(r.embedding)] = r.embedding
    top = np.maximum(np.abs(pivots).max(axis=1, keepdims=True), 1e-300)  # scaled first: squares may leave the range
    pivots = pivots / top / np.maximum(np.linalg.norm(pivots / top, axis=1, keepdims=True), 1e-300)
    kept: list[int] = []
    for i, p in enumerate(pivots):
        if all(np.linalg.norm(p - pivots[k]) >= APART for k in kept):
            kept.append(i)
    pivots = pivots[kept]
    packed = _packed(classes, dtype)
    limit, n_pivots = float(np.arccos(least)), len(pivots)
    share = spark.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, n = np.full((n_pivots, n_pivots), 9.0), np.full((n_pivots, n_pivots), -9.0), np.zeros(n_pivots, np.int64)
        for batch in batches:
            if batch.num_rows:
                angle = _angles(_units(batch.column(0).to_pylist(), dtype, dim), share.value)
                home = angle.argmin(axis=1)
                np.minimum.at(lo, home, angle)
                np.maximum.at(hi, home, angle)
                n += np.bincount(home, minlength=n_pivots)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(lo[some]), pa.list_(pa.float64())), pa.array(list(hi[some]), pa.list_(pa.float64()))], names=["c", "n", "lo", "hi"])

    lists = lambda f, c: [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(n_pivots)]
    stats = packed.select("v").mapInArrow(measure, "c bigint, n bigint, lo array<double>, hi array<double>")
    # a row for each task and cell, of two numbers for each pivot
    got = stats.groupBy("c").agg(F.sum("n").alias("n"), F.array(*lists(F.min, "lo")).alias("lo"), F.array(*lists(F.max, "hi")).alias("hi")).collect()
    lo, hi, parts = np.full((n_pivots, n_pivots), 9.0), np.full((n_pivots, n_pivots), -9.0), np.zeros(n_pivots, np.int64)
    for r in got:
        lo[r.c], hi[r.c], parts[r.c] = r.lo, r.hi, -(-r.n // cell)
    base = np.concatenate([[0], np.cumsum(parts)])
    plan = spark.sparkContext.broadcast((lo - limit - SLACK, hi + limit + SLACK, parts, base))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, cut, first = plan.value
        p = share.value
        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, APART**2 / 2)) + np.eye(n_pivots)  # no plane lies between a cell and itself
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                units = _units(batch.column(0).to_pylist(), dtype, dim)
                dots = units @ p.T
                angle = np.arccos(np.clip(dots, -1, 1))
                home = angle.argmin(axis=1)
                rows_ = np.arange(len(home))
                beyond = (dots[rows_, home][:, None] - dots) / apart[home]  # sine of the angle to the bisecting plane
                may = (beyond <= np.sin(limit) + SLACK) & (cut > 0)[None, :]
                for c in np.flatnonzero(cut > 0):
                    own = np.flatnonzero(may[:, c])
                    may[own, c] = ((angle[own] >= low[c]) & (angle[own] <= high[c])).all(axis=1)
                may[rows_, home] = True
                uid = batch.column(1).to_numpy()
                sub = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, cut[home])
                who, where = np.nonzero(may)
                times = cut[where]
                who, where = np.repeat(who, times), np.repeat(where, times)
                part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                guest = ~((where == home[who]) & (part == sub[who]))
                take = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(first[where] + part), pa.array(guest), take.column(0), take.column(1), take.column(2)], names=["cell", "guest", "v", "uid", "n"])

    dealt = packed.select("v", "uid", "n").mapInArrow(deal, "cell bigint, guest boolean, v binary, uid bigint, n bigint")
    cells = dealt.repartition("cell").sortWithinPartitions("cell", "guest")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held = None, None, []

        def closed(cell_: _Cell):
            a, b = zip(*cell_.edges) if cell_.edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(cell_.uid), pa.nulls(len(cell_.uid), pa.int64()), pa.array(cell_.links.astype(np.int64))], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "links"])

        def members(batches_: list) -> _Cell:
            return _Cell(*(np.concatenate(x) for x in zip(*batches_)), least)

        for batch in batches:
            cell_of, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(cell_of) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *edge], [*edge, len(cell_of)]):
                if i == j:
                    continue
                if at != cell_of[i]:
                    if held:
                        own, held = members(held), []
                    if own is not None:
                        yield from closed(own)
                    at, own = cell_of[i], None
                part = batch.slice(i, j - i)
                got_ = (_units(part.column(2).to_pylist(), dtype, dim), part.column(3).to_numpy(), part.column(4).to_numpy())
                if not guest[i]:
                    held.append(got_)
                    continue
                if held:
                    own, held = members(held), []
                if own is not None:
                    own.visit(*got_)
        if held:
            own = members(held)
        if own is not None:
            yield from closed(own)

    found = stored(cells.mapInArrow(join, "a bigint, b bigint, links bigint"), "links")
    comp = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "uid")
    named = classes.join(found.where("b IS NULL").select(F.col("a").alias("uid"), "links"), "uid").join(comp, "uid", "left")
    named = named.select("h", "embedding", "first", "links", F.coalesce("component", "uid").alias("component"))
    to = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    linked = keyed.join(to, ["h", "embedding"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
