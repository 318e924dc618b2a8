"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes.  The transducer's state is the side that leads
and the bytes by which it leads; the next token is always one of the side that
lags, and a transition depends on nothing but the state and that token, so it is
worked out once and kept.  Every token of the lagging side overlaps the leader's
last token: that is a link, so each step but a group's first makes one.  Where no
byte is left over, a group is closed.

Each text is encoded once.  Its linked pairs of ids, with how often it has them,
go into a table; their counts over all rows are added up by task and then by
Spark.  There are at most as many pairs as the vocabularies' sizes multiply to,
whatever the corpus; they return to the table in blocks of ``block_pairs`` of
them, each over all rows, so what is broadcast is bounded.

Defined results: texts that are null, empty, or not given back byte for byte by
both tokenizers have no token, group or link, and an empty digest; repeated rows
give repeated results and count each; ties for an id's highest count all count as
highest; null or repeated ids stay as they are; bytes that are no UTF-8 are read
as U+FFFD; an empty table gives an empty result; other columns stay, unless a
result column has their name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import free, slices, small_batches, stored

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Texts of more characters are split into pieces by array scans instead of a pattern, which backtracks.
_LONG = 500_000
START, OF_A, OF_B = 0, 1, 2
#: The steps of a group of one token each.
SINGLE = bytes([START, OF_B])


def printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others 256 and up in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """Ids by bytes of a byte-level vocabulary whose merges stand in the order of their ids, as merging by least id needs."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    special = {x["content"] for x in known.get("added_tokens", ()) if x.get("special")}
    byte, vocab = printable(), known["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in known["model"]["merges"]]
    out = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    if merged != sorted(set(merged)) or len(out) != 256 + len(merged) or not all(bytes([b]) in out for b in range(256)):
        raise ValueError(f"{path}: ids do not follow the merges")
    return out


class State(dict):
    """The next state by the lagging side's token, worked out when it is first asked for; ahead: side A leads, by the bytes rest."""

    def __init__(self, machine: Transducer, ahead: bool, rest: bytes):
        self.machine, self.ahead, self.rest = machine, ahead, rest

    def __missing__(self, token: int) -> State | None:
        own = (self.machine.bytes_b if self.ahead else self.machine.bytes_a)[token]
        n = min(len(own), len(self.rest))
        if own[:n] != self.rest[:n] or not own:
            got = None  # the sides' bytes differ
        elif len(self.rest) > n:
            got = self.machine.state(self.ahead, self.rest[n:])
        elif len(own) > n:
            got = self.machine.state(not self.ahead, own[n:])
        else:
            got = self.machine.empty
        self[token] = got
        self.machine.moves += 1
        return got


class Transducer:
    def __init__(self, bytes_a: dict[int, bytes], bytes_b: list[bytes], most: int = 1_000_000):
        self.bytes_a, self.bytes_b, self.most = bytes_a, bytes_b, most
        self.forget()

    def forget(self) -> None:
        self.states, self.moves = {}, 0
        self.empty = State(self, False, b"")  # A's token comes first

    def state(self, ahead: bool, rest: bytes) -> State:
        found = self.states.get((ahead, rest))
        if found is None:
            found = self.states[ahead, rest] = State(self, ahead, rest)
        return found

    def steps(self, a: list[int], b: list[int]) -> list[bytes] | None:
        """For each group its steps: START (its first token, A's), then OF_A or OF_B; None if the bytes differ."""
        if self.moves > self.most:
            self.forget()
        out, empty = [], self.empty
        add, more_a, more_b = out.append, iter(a), iter(b)
        try:
            for x in more_a:
                state = empty[x][next(more_b)]
                if state is empty:
                    add(SINGLE)
                    continue
                own = bytearray(SINGLE)
                while state is not empty:
                    if state.ahead:
                        own.append(OF_B)
                        state = state[next(more_b)]
                    else:
                        own.append(OF_A)
                        state = state[next(more_a)]
                add(bytes(own))
        except (StopIteration, AttributeError, TypeError):  # a side ends too soon; or None, differing bytes
            return None
        return out if next(more_b, None) is None else None


class Pair:
    """Two tokenizers and the transducer between them."""

    def __init__(self, ids: dict[bytes, int], pattern: str, model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        self.long = bpe.Encoder(ids, cache=10_000)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.size_b = len(pieces)
        bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.machine = Transducer({i: t for t, i in ids.items()}, bytes_b)
        self.told = _Told(self.size_b)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            text = " " + text
            yield (self.a.encode_ordinary(text) if len(text) <= _LONG else self.long.encode([text])[0][0]), b

    def align(self, a: list[int], b: list[int]) -> tuple[np.ndarray, list[str]] | None:
        """(links as A's id * B's vocabulary + B's id, groups as text) of two encodings; None if their bytes differ."""
        steps = self.machine.steps(a, b)
        if steps is None:
            return None
        kind = np.frombuffer(b"".join(steps), np.uint8)
        n_b = np.cumsum(kind == OF_B)
        last_a, last_b = np.arange(len(kind)) - n_b, n_b - 1  # the last token of each side at every step
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        linked, start = kind != START, np.flatnonzero(kind == START)
        links = ids_a[last_a[linked]] * self.size_b + ids_b[last_b[linked]]
        from_a, from_b = np.append(last_a[start], len(a)), np.append(n_b[start], len(b))
        several = np.flatnonzero(np.diff(np.append(start, len(kind))) > 2).tolist()
        codes = (ids_a[from_a[:-1]] * self.size_b + ids_b[from_b[:-1]]).tolist()
        from_a, from_b = from_a.tolist(), from_b.tolist()
        for k in several:
            codes[k] = (*a[from_a[k] : from_a[k + 1]], -1, *b[from_b[k] : from_b[k + 1]])
        told = list(map(self.told.__getitem__, codes))
        if len(self.told) > 500_000:
            self.told.clear()
        return links, told


class _Told(dict):
    """The text of a group: of one token each by the pair's number, of more by the ids with -1 between the sides."""

    def __init__(self, size_b: int):
        self.size_b = size_b

    def __missing__(self, code: int | tuple) -> str:
        if isinstance(code, tuple):
            text = ",".join(map(str, code)).replace(",-1,", "|")
        else:
            text = f"{code // self.size_b}|{code % self.size_b}"
        self[code] = text
        return text


_pairs: dict[str, Pair] = {}


def _pair(key: str, parts: tuple) -> Pair:
    """The worker's pair of tokenizers: its transitions outlive a task."""
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(*parts)
    return _pairs[key]


LONG = ("n_a", "n_b", "n_groups", "n_links")
SUMS = ("n_best", "count_sum")


def aligned(docs: DataFrame, parts, key: str, pairs: str, times: str) -> DataFrame:
    """docs without text, with counts, digest, and the columns pairs and times: a text's linked pairs, and how often it has each."""
    new = [*((n, T.LongType(), pa.int64()) for n in LONG), ("groups_sha256", T.StringType(), pa.string()), (pairs, T.ArrayType(T.LongType()), pa.list_(pa.int64())), (times, T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    names = {x[0] for x in new} | {"text", *SUMS}
    keep = [f for f in docs.schema.fields if f.name not in names]
    nothing = (0, 0, 0, 0, "", [], [])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(key, parts.value)
        held: dict[str, tuple] = {}  # repeated texts near each other
        for batch, texts in slices(batches, "text", max_rows=256, max_bytes=1 << 20):
            texts = [(t or b"").decode("utf-8", "replace") for t in texts]
            if len(held) > 2048:
                held.clear()
            new_texts = [t for t in dict.fromkeys(texts) if t and t not in held]
            found = {"": nothing}
            for text, (a, b) in zip(new_texts, pair.encode(new_texts)):
                got = pair.align(a, b)
                if got is None:
                    found[text] = nothing
                else:
                    codes, n = np.unique(got[0], return_counts=True)
                    found[text] = (len(a), len(b), len(got[1]), len(got[0]), hashlib.sha256(";".join(got[1]).encode()).hexdigest(), codes, n)
            out = [found[t] if t in found else held[t] for t in texts]
            held.update({t: x for t, x in found.items() if len(t) < 10_000})
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in keep] + [pa.array(c, x[2]) for c, x in zip(zip(*out), new)], names=[f.name for f in keep] + [x[0] for x in new])

    return docs.mapInArrow(kernel, T.StructType(keep + [T.StructField(n, t) for n, t, _ in new]))


def pair_counts(rows: DataFrame, pairs: str, times: str, held: int = 1_000_000) -> DataFrame:
    """(pair, n): how many links hold each pair of ids, over all rows; tasks add up what they read first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told():
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            more, at = np.unique(np.concatenate([codes, batch.column(0).flatten().to_numpy()]), return_inverse=True)
            weight = np.zeros(len(more), np.int64)
            np.add.at(weight, at, np.concatenate([n, batch.column(1).flatten().to_numpy()]))
            codes, n = more, weight
            if len(codes) > held:
                yield told()
                codes, n = codes[:0], n[:0]
        yield told()

    return rows.select(pairs, times).mapInArrow(kernel, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_level: str, model: str, pattern: str, block_pairs: int = 4_000_000) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    byte_level, model: paths of a byte-level vocabulary (A) and of a piece model
    (B), read on the driver and broadcast; their size is that of a tokenizer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model, "rb") as f:
        proto = f.read()
    ids = read_byte_level(byte_level)
    key = hashlib.sha256(repr((sorted(ids.items()), pattern)).encode() + proto).hexdigest()
    size_b = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()
    pairs, times = free(docs.columns, "pairs"), free(docs.columns, "times")
    rows = stored(aligned(docs, spark.sparkContext.broadcast((ids, pattern, proto)), key, pairs, times), "aligned")
    counts = stored(pair_counts(rows, pairs, times), "pairs")
    best = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("b", F.col("pair") % size_b).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    blocks = max(1, -(-counts.count() // block_pairs))
    if blocks > 1:
        judged = stored(judged, "judged")
    rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in SUMS})
    for k in range(blocks):
        block = judged.where(F.pmod("pair", F.lit(blocks)) == k) if blocks > 1 else judged
        table = [np.asarray(c.combine_chunks()) for c in block.toArrow().sort_by("pair").columns]  # at most about block_pairs
        rows = _add(rows, pairs, times, spark.sparkContext.broadcast(table))
        if k < blocks - 1:
            rows = stored(rows, "aligned")
    keep = [c for c in docs.columns if c not in {"text", *LONG, *SUMS, "groups_sha256"}]
    return rows.select(*(F.col(f"`{c}`") for c in keep), *LONG, *SUMS, "groups_sha256")


def _add(rows: DataFrame, pairs: str, times: str, table) -> DataFrame:
    """Adds one block of counts to the rows' sums."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = table.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pairs))
            of, many = lists.flatten().to_numpy(), batch.column(batch.schema.get_field_index(times)).flatten().to_numpy()
            fits = np.zeros(len(of), bool)
            if len(codes) and len(of):
                at = np.minimum(np.searchsorted(codes, of), len(codes) - 1)
                fits = codes[at] == of
            end = np.cumsum(lists.value_lengths().to_numpy())
            cols = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            for name, worth in (("n_best", best), ("count_sum", n)):
                each = np.zeros(len(of) + 1, np.int64)
                if fits.any():
                    each[1:] = np.cumsum(np.where(fits, worth[at] * many, 0))
                cols[name] = pa.array(cols[name].to_numpy() + np.diff(each[np.append(0, end)]))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return rows.mapInArrow(kernel, rows.schema)
