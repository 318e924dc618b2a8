"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each text becomes an array of code points.  A table maps them to classes, their
neighbours make symbols of them, and a small automaton over the symbols says
where pieces begin.  A symbol acts on the automaton's states as a function, and
composing functions is associative, so the state before every code point comes
from a two-level scan over a composition table: all rows of a block matrix at
once, then the rows' totals.  Pieces are slices between boundaries; their bytes
go through cached pair merging, and their byte offsets are kept: decoding puts
each piece's bytes at its offset and checks that they fill it, and any stretch of
pieces can be decoded alone.

Defined results: a null text is empty and has no token; bytes that are no UTF-8
become U+FFFD before they are encoded; a piece of any length is merged whole; texts keep their order and repeated rows give repeated results; an
empty table gives an empty result; other columns stay, unless a result column
has their name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches

L, N, S, O = 0, 1, 2, 3  # letters, numbers, white space, others
#: Code points that the pattern's \\s matches.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a piece of its own.
SHORT = ["s", "t", "re", "ve", "m", "ll", "d"]

# symbols
LETTER, NUMBER, OTHER, SHORT1, SHORT2, WHITE_IN, SPACE_LAST, WHITE_LAST, EDGE = range(9)
# states: after an ended piece, in a white run, after a leading space, in letters, numbers, others, or 1 or 2 before the end of a short form
END, RUN, LEAD, IN_L, IN_N, IN_O, LEFT1, LEFT2 = range(8)


#: Letters and numbers of Unicode 16.0 beyond those of 15.1, which unicodedata may not know.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = L
        elif kind == "N":
            out[cp] = N
    for kind, ranges in ((L, NEW_LETTERS), (N, NEW_NUMBERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[WHITE] = S
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this symbol."""
    if symbol == EDGE:
        return END, True
    if state in (LEFT1, LEFT2):
        return (END if state == LEFT1 else LEFT1), False
    if symbol == WHITE_IN:
        return RUN, state != RUN
    if symbol == SPACE_LAST:
        return LEAD, True
    if symbol == WHITE_LAST:
        return END, True
    if symbol in (SHORT1, SHORT2):
        return (IN_O, False) if state in (IN_O, LEAD) else (LEFT1 if symbol == SHORT1 else LEFT2, True)
    own = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}[symbol]
    return own, state not in (own, LEAD)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Functions of the symbols closed under composition: number of each symbol's, composition table, values at END, begins[state, symbol]."""
    states = range(8)
    base = [tuple(_step(s, y)[0] for s in states) for y in range(9)]
    funcs = list(dict.fromkeys(base))
    index = {f: i for i, f in enumerate(funcs)}
    k = 0
    while k < len(funcs):
        for f in [tuple(g[x] for x in funcs[k]) for g in base]:
            if f not in index:
                index[f] = len(funcs)
                funcs.append(f)
        k += 1
    table = np.array([[index[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.uint16)
    begins = np.array([[_step(s, y)[1] for y in range(9)] for s in states])
    return np.array([index[f] for f in base], np.uint16), table, np.array(funcs, np.uint8), begins


def boundaries(cps: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """begins[i]: a piece begins at code point i.  edge marks separators between texts, which are no text."""
    n = len(cps)
    kind = classes()[cps]
    kind[edge] = S
    white = kind == S
    last = np.zeros(n, bool)  # followed by something that isn't white; an edge ends the text
    last[:-1] = ~white[1:]
    symbol = np.array([LETTER, NUMBER, WHITE_IN, OTHER], np.uint8)[kind]
    symbol[white & last] = WHITE_LAST
    symbol[white & last & (cps == 0x20)] = SPACE_LAST
    for i in np.flatnonzero(cps == 0x27):
        tail = cps[i + 1 : i + 3]
        if len(tail) and chr(tail[0]) in SHORT:
            symbol[i] = SHORT1
        elif len(tail) == 2 and chr(tail[0]) + chr(tail[1]) in SHORT:
            symbol[i] = SHORT2
    symbol[edge] = EDGE
    own, table, values, begins = automaton()
    width = max(1, int(n**0.5) // 4)
    rows = -(-n // width)
    f = np.full(rows * width, own[EDGE], np.uint16)
    f[:n] = own[symbol]
    f = np.ascontiguousarray(f.reshape(rows, width).T)
    for j in range(1, width):  # within every row at once
        f[j] = table[f[j - 1], f[j]]
    start, state = np.empty(rows, np.uint8), END
    for i, total in enumerate(f[-1].tolist()):  # over the rows' totals
        start[i] = state
        state = values[total, state]
    after = values[f, start[None, :]].T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, after[:-1]
    return begins[before, symbol]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], cache: int = 250_000):
        self.ranks, self.cache, self.held, self.missed, self.bytes = ranks, cache, {}, 0, {i: b for b, i in ranks.items()}
        self.sizes = np.zeros(max(self.bytes, default=0) + 1, np.int64)
        self.sizes[list(self.bytes)] = [len(b) for b in self.bytes.values()]

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of least rank, leftmost first, until none is known; a heap holds the pairs."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n <= 24:  # a scan over few pairs is quicker than a heap
            parts = [piece[i : i + 1] for i in range(n)]
            pairs = [ranks.get(piece[i : i + 2]) for i in range(n - 1)]
            while known := [r for r in pairs if r is not None]:
                i = pairs.index(min(known))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1])
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            return tuple(ranks[x] for x in parts)
        nxt, prev, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank = lambda i: ranks.get(piece[i : end[nxt[i]]]) if nxt[i] < n else None
        heap = [(r, i, end[i], end[nxt[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := rank(i)) is not None:
                    heapq.heappush(heap, (r, i, end[i], end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := rank(p)) is not None:
                heapq.heappush(heap, (r, p, end[p], end[i]))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """(ids, byte offsets of the pieces, the end included) of each text."""
        joined = "\0".join(["", *texts, ""])  # an edge before and after every text
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(cps), bool)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        edge[at] = True
        begin = boundaries(cps, edge)
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        data = joined.encode()
        starts = np.flatnonzero(begin)
        cut = place[starts]
        first = np.searchsorted(starts, at)  # the edges' places among the starts
        held, out = self.held, []
        for k in range(len(texts)):
            off = cut[first[k] + 1 : first[k + 1] + 1]
            ids: list[int] = []
            ends = off.tolist()
            for a, b in zip(ends, ends[1:]):
                piece = data[a:b]
                got = held.get(piece)
                if got is None:
                    got = self.merged(piece)
                    if len(piece) <= 64:
                        if len(held) < self.cache:
                            held[piece] = got
                        elif (missed := self.missed + 1) > 8 * self.cache:  # the texts have changed: start anew
                            held.clear()
                            self.missed = 0
                        else:
                            self.missed = missed
                ids.extend(got)
            out.append((ids, off - off[0]))
        return out

    def decode(self, ids: list[int], offsets: np.ndarray, first: int = 0, last: int | None = None) -> bytes:
        """The bytes of pieces first to last, all by default, of a text's ids and its pieces' offsets."""
        ends = np.cumsum(self.sizes[np.asarray(ids, np.int64)]) if len(ids) else np.zeros(0, np.int64)
        cut = np.searchsorted(ends, offsets, "right")  # tokens that end up to each offset
        filled = np.concatenate([[0], ends])[cut]
        if (filled != offsets).any() or cut[-1] != len(ids):
            raise ValueError("the ids do not fill the pieces")
        last = len(offsets) - 1 if last is None else last
        return b"".join(map(self.bytes.__getitem__, ids[cut[first] : cut[last]]))


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, ranks: dict[bytes, int]) -> Encoder:
    """The worker's encoder: its cache outlives a task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: str, ids: bool = True) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids and piece_offsets (in bytes, the end included).

    vocabulary: path of a rank file, read on the driver and broadcast (its size
    is that of a tokenizer, whatever the corpus).
    """
    small_batches(docs.sparkSession)
    known = read_ranks(vocabulary)
    key = hashlib.sha256(repr(sorted(known.items())).encode()).hexdigest()
    ranks = docs.sparkSession.sparkContext.broadcast(known)
    new = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    new += [("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("piece_offsets", T.ArrayType(T.LongType()), pa.list_(pa.int64()))] if ids else []
    keep = [f for f in docs.schema.fields if f.name not in {"text", *(x[0] for x in new)}]
    names = [f.name for f in keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, ranks.value)
        for batch, texts in slices(batches, "text", max_bytes=1 << 20):
            got = encoder.encode([(t or b"").decode("utf-8", "replace") for t in texts])
            raw = [np.array(x, "<u4") for x, _ in got]
            cols = [[len(x) for x in raw], [hashlib.sha256(x.tobytes()).hexdigest() for x in raw], [hashlib.sha256(encoder.decode(*x)).hexdigest() for x in got], [x.view(np.int32) for x in raw], [x for _, x in got]]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(c, x[2]) for c, x in zip(cols, new)], names=names + [x[0] for x in new])

    return docs.mapInArrow(kernel, T.StructType(keep + [T.StructField(n, t) for n, t, _ in new]))
