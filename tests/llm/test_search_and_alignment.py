"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trekframe.llm import align, lexical, suffixes

DOCS = "doc_id bigint, text string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind)


# --- suffix-array dedup ---


def slow_dedup(docs, length=100):
    """Every string by its first place."""
    first, out = {}, {}
    rows = sorted((d, (t or "").encode()) for d, t in docs)
    for d, t in rows:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(first.get(t[i : i + length], (d, i)), (d, i))
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] != (d, i):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.setdefault(d, set()).add((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def got_dedup(spark, docs, settings=suffixes.Settings(), parts=4):
    rows = suffixes.dedup_strings(frame(spark, docs).repartition(parts), settings).collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert len(rows) == len(docs)
    return out


@pytest.mark.parametrize("kind", ["phrases", "letters", "passage"])
@pytest.mark.parametrize("settings", [suffixes.Settings(), suffixes.Settings(sample=1.0, heavy=1 / 300)])
def test_strings_against_brute_force(spark, kind, settings):
    r = random.Random(3)
    if kind == "phrases":
        docs = [(i, " ".join(r.choices(["the quick brown fox jumps over", "lazy", "dogs and cats are " * 3, "é" * 20, "a" * 150, "😀漢"], k=r.randrange(40)))) for i in range(60)]
    elif kind == "letters":
        docs = [(i, r.choice("ab") * r.randrange(400) + r.choice(["", "ab" * 90])) for i in range(30)]
    else:
        shared = "".join(r.choices("abcdefghij ", k=180))
        docs = [(i, "".join(r.choices("klmnopqrst ", k=r.randrange(90))) + shared[r.randrange(60) :] + "".join(r.choices("uvwxyz ", k=r.randrange(90)))) for i in range(80)]
    assert got_dedup(spark, docs, settings) == slow_dedup(docs)


def test_strings_repeated_rows_and_edges(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300))
    docs = [(1, long), (1, long), (2, "x" + long[:150]), (2, long[140:]), (3, None), (4, ""), (5, long[:99]), (6, long[:100]), (7, "é" * 3)]
    got = got_dedup(spark, docs)
    # rows of one id are one document: neither goes for the other
    assert {x[1] for x in got[1]} == {0} and {x[1] for x in got[2]} == {150, 160}
    assert got[3] == got[4] == {(0, 0, 0, hashlib.sha256(b"").hexdigest())} and {x[1] for x in got[5]} == {0} and {x[1] for x in got[6]} == {100}
    unnamed = suffixes.dedup_strings(frame(spark, [(None, long), (9, long)]).withColumns({"n_bytes": F.lit("clash"), "doc": F.lit(1), "own": F.lit(2), "g": F.lit(3)}))
    assert unnamed.columns[:5] == ["doc_id", "text", "doc", "own", "g"] and {r.doc_id: r.n_removed for r in unnamed.collect()} == {None: 0, 9: 300}
    cut = suffixes.dedup_strings(frame(spark, [(1, long), (2, long[:120] + "rest")])).orderBy("doc_id").collect()
    assert cut[1].text == "rest" and cut[0].text == long
    assert suffixes.dedup_strings(frame(spark, [])).count() == 0


def test_long_text_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 1 << 10)
    text = np.frombuffer(bytes(random.Random(2).choices(b"abcd", k=9000)), np.uint8)
    s = suffixes.Settings()
    data = np.concatenate([text, np.zeros(200, np.uint8)])
    at, _ = suffixes.anchors(data, np.arange(9000) <= 8900, s)
    monkeypatch.setattr(suffixes, "_BLOCK", 1 << 22)
    whole, _ = suffixes.anchors(data, np.arange(9000) <= 8900, s)
    assert sorted(set(at.tolist())) == whole.tolist()


def test_deep_shallow_order():
    r = random.Random(5)
    for depth in (8, 20, 48, 68, 100):
        text = b"".join(r.choices([b"ab", b"abc", b"\0", b"a" * 30, b"xyz" * 20, b"\xff"], k=200))
        data = np.frombuffer(text + bytes(depth + 16), np.uint8)
        starts, group = np.arange(len(text)), np.sort([r.randrange(3) for _ in text])
        order, lcp = suffixes.deep_shallow(data, starts, group, depth)
        strings = [data.tobytes()[i : i + depth] for i in starts]
        assert [strings[i] for i in order] == [strings[i] for i in sorted(range(len(text)), key=lambda i: (group[i], strings[i]))] and (group[order] == group).all()
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), depth)
        assert lcp.tolist() == [0 if k == 0 or group[k] != group[k - 1] else common(strings[order[k]], strings[order[k - 1]]) for k in range(len(text))]


# --- ranked search ---


def slow_rank(docs, items, k):
    terms = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    counts = [(d, len(w), Counter(w)) for d, w in held]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    own = {}
    for i, text in items:
        own.setdefault(i, set()).update(terms(text))
    for i, wanted in own.items():
        scored = []
        for d, n, c in counts:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total))) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms,block_docs,k", [(6000, 8192, 5), (3, 70, 5), (6000, 64, 50), (1, 7, 1)])
def test_ranks_against_brute_force(spark, block_terms, block_docs, k):
    r = random.Random(7)
    vocabulary = ["The", "river", "HOUSE", "été", "漢字", "x1", "of", "a", "zeta", "Ünit", "b2b", "só"]
    docs = [(i * 3 % 301, " ".join(r.choices(vocabulary, weights=range(12, 0, -1), k=r.randrange(30))) + r.choice(["", ", (tail)!"])) for i in range(260)]
    docs += [(1, docs[0][1]), (None, "river zeta"), (None, "zeta"), (500, None), (501, ""), (502, "?!"), (503, "zeta " * 3000)]
    items = [(1, "The river, the RIVER"), (2, "zeta só"), (3, "nowhere"), (4, None), (5, ""), (1, "été"), (6, "a of x1 b2b house 漢字 ünit"), (6, "a of x1 b2b house 漢字 ünit"), (None, "tail")]
    got = lexical.rank(frame(spark, docs).withColumns({"n": F.lit(1), "score": F.lit(2)}).repartition(3), frame(spark, items, "item_id bigint, text string"), k, block_terms, block_docs)
    assert sorted([tuple(x) for x in got.collect()], key=repr) == slow_rank(docs, items, k)


def test_ranks_of_empty_tables(spark):
    items = frame(spark, [(1, "a")], "item_id bigint, text string")
    assert lexical.rank(frame(spark, []), items).count() == 0
    assert lexical.rank(frame(spark, [(1, "a")]), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank(frame(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_bitmaps_add_and_select():
    r = np.random.default_rng(3)
    values = r.integers(0, 1 << 20, (5, 200)) * (r.random((5, 200)) < 0.5)
    numbers = [lexical.sliced(np.flatnonzero(v), v[v > 0], 4) for v in values]
    total = np.zeros((23, 4), np.uint64)
    for n in numbers:
        lexical.add(total, n)
    want = values.sum(axis=0)
    for k in (1, 7, 199, 300):
        rows, scores = lexical.top(total, k)
        best = sorted(sorted(range(200), key=lambda i: (-want[i], i))[:k])
        assert rows.tolist() == [i for i in best if want[i]] and scores.tolist() == want[rows].tolist()


# --- alignment ---


def slow_alignment(texts):
    """Groups and links by byte ranges, counts by dictionary."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = align.printable()
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        raw_a = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        raw_b = [piece(i) for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            rows.append(None)
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(end_a[i] - len(raw_a[i]), end_b[j] - len(raw_b[j])) < min(end_a[i], end_b[j])]
        cuts, groups, i, j = set(end_a.tolist()) & set(end_b.tolist()), [], 0, 0
        for c in sorted(cuts):
            x, y = int(np.searchsorted(end_a, c)) + 1, int(np.searchsorted(end_b, c)) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        rows.append((len(a), len(b), groups, links))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


TEXTS = ["Hello world, it's a test.", "naïve café — ünïcödé 漢字かな 😀🤦🏽", "  two  spaces\n\n\tand tabs ", None, "", " ", "a▁b", "<|endoftext|> <s> </s> <unk>", "x = y**2; // 12345 'tis", "Hello world, it's a test.", "\0 nul", "é", "ﬁ Ａ ½ Ⅷ", "don't DON'T we'll", " line sep", "é combining", "🇩🇪", "word" * 40]


@pytest.mark.parametrize("block_pairs", [4_000_000, 7])
def test_alignment_against_brute_force(spark, block_pairs):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choices(["the", "Reason", "étéx", "ionth", "12.5", "😀", "a\nb", "==="], k=r.randrange(1, 40))) for _ in range(40)]
    df = frame(spark, list(enumerate(texts))).withColumns({"n_best": F.lit("clash"), "pairs": F.lit(1), "PAIRS_": F.lit(2)}).repartition(3)
    got = align.align(df, A, B, public_tokenizers.PATTERN, block_pairs)
    assert got.columns == ["doc_id", "pairs", "PAIRS_", *align.LONG, *align.SUMS, "groups_sha256"]
    rows = {x.doc_id: tuple(x)[3:] for x in got.collect()}
    assert [rows[i] for i in range(len(texts))] == slow_alignment(texts)


def test_alignment_edges(spark):
    assert align.align(frame(spark, []), A, B, public_tokenizers.PATTERN).count() == 0
    long = "lorem ipsum " * 60_000
    got = align.align(frame(spark, [(None, long), (1, "lorem"), (1, "lorem"), (2, " " * 700_000)]), A, B, public_tokenizers.PATTERN).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4 and by[None].n_links == by[None].n_a + by[None].n_b - by[None].n_groups > 200_000
    assert [r.n_a for r in got if r.doc_id == 1] == [by[1].n_a] * 2


def test_transducer_keeps_its_transitions():
    ids = align.read_byte_level(A)
    with open(B, "rb") as f:
        pair = align.Pair(ids, public_tokenizers.PATTERN, f.read())
    text = ["internationalisation of uncharacteristically long words"] * 2
    encoded = list(pair.encode(text))
    pair.align(*encoded[0])
    before = pair.machine.moves
    pair.align(*encoded[1])
    assert pair.machine.moves == before and before > 0
    assert pair.align(encoded[0][0], encoded[0][1][:-1]) is None and pair.align(encoded[0][0][:-1], encoded[0][1]) is None
    assert pair.align(encoded[0][0], encoded[0][1][::-1]) is None
