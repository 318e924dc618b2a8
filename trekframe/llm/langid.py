"""Language identification: script ranges, per-word scores, Viterbi over the words of a text.

Training counts hashed character 1- to 4-grams of words, by language, over a
bounded sample of labelled rows: about ``per_language`` rows of each language,
all if it has no more, else those whose hash falls in that share of its range;
equal rows are in together.  The model is two tables of ``1 << bits`` rows a
language, so its size does not grow with the corpus; more than ``max_languages``
languages are an error, never cut.

Prediction reads whole texts.  Maximal runs of letters (and marks after them) are
words.  A word's script, from fixed code point ranges, narrows the languages to
those seen in that script; the others cost a fixed amount.  The words' scores go
through Viterbi with a penalty for each switch of language, which labels spans.
The prediction is the language with most letters under it, the score its share of
all letters.

Defined results: a null or letterless text is ``und`` with score 0; a word in a
script that no language was seen in speaks for none, its letters count in the
total only, so a text wholly in such a script has score 0; ties go to the
language first in order; languages are the non-null lang values of the training
rows, and without any every text is ``und``; null ids are not held out; repeated
rows give repeated results; an empty table gives an empty result; a long text is
labelled whole; bytes that are no UTF-8 become U+FFFD; U+0000 is a
character like other controls; other columns stay, unless a result column has their name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches

#: Code point ranges of scripts (first, last, script).
SCRIPTS = [
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xA720, 0xA7FF, 1), (0xFB00, 0xFB06, 1), (0xFF21, 0xFF5A, 1),
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2), (0x0400, 0x052F, 3), (0x2DE0, 0x2DFF, 3), (0xA640, 0xA69F, 3), (0x0530, 0x058F, 4),
    (0x0590, 0x05FF, 5), (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0xFB50, 0xFDFF, 6), (0xFE70, 0xFEFF, 6), (0x0900, 0x097F, 7),
    (0x0980, 0x09FF, 8), (0x0A00, 0x0A7F, 9), (0x0A80, 0x0AFF, 10), (0x0B80, 0x0BFF, 11), (0x0C00, 0x0C7F, 12), (0x0C80, 0x0CFF, 13),
    (0x0D00, 0x0D7F, 14), (0x0E00, 0x0E7F, 15), (0x10A0, 0x10FF, 16), (0x1100, 0x11FF, 17), (0xAC00, 0xD7AF, 17), (0x3040, 0x30FF, 18),
    (0x3400, 0x4DBF, 19), (0x4E00, 0x9FFF, 19), (0x20000, 0x2FA1F, 19), (0x1200, 0x137F, 20), (0x1780, 0x17FF, 21), (0x0E80, 0x0EFF, 22),
]
N_SCRIPTS = 23


@dataclass(frozen=True)
class Settings:
    per_language: int = 1000  # the bound of the training sample, in the mean: rows are taken by hash, so that no language is ranked in one task
    bits: int = 15
    switch: float = 12.0  # cost of a change of language, in nats
    foreign: float = 20.0  # cost of a word in a script its language was not seen in
    script_share: float = 0.001  # of a language's words, to count as seen
    max_languages: int = 256


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for letters, 2 for marks; lower-case code point; script."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        major = unicodedata.category(c)[0]
        if major == "L":
            kind[cp] = 1
            if len(x := c.lower()) == 1:
                low[cp] = ord(x)
        elif major == "M":
            kind[cp] = 2
    script = np.zeros(0x110000, np.uint8)
    for a, b, s in SCRIPTS:
        script[a : b + 1] = s
    return kind, low, script


_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, ...]:
    """(buckets[4, letters]: -1 where a gram leaves its word; word of each letter; text, script and length of each word).

    Grams run backwards from each letter; the place before a word's first letter counts as a mark of its start.
    """
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    joined = "\0".join([*decoded, ""]).encode("utf-32-le")
    cps = np.frombuffer(joined, np.uint32)
    kind, low, script = tables()
    k = kind[cps]
    letter = k == 1
    inside = letter | ((k == 2) & np.concatenate([[False], letter[:-1]]))
    first = inside & ~np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(first)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in decoded]), starts, "right")  # by lengths: a text may hold the separator
    word = (np.cumsum(first, dtype=np.int32) - 1)[inside]
    at = np.flatnonzero(inside).astype(np.int32)
    c = low[cps[at]].astype(np.uint64) + np.uint64(1)
    depth = at - starts[word].astype(np.int32)  # letters before it in its word
    words_script = script[cps[starts]]
    del cps, kind, k, letter, inside, first, at, joined, decoded  # a slice's arrays come to many times its text
    length = np.bincount(word, minlength=len(starts))
    grams = np.full((4, len(c)), -1, np.int32)
    h = np.zeros(len(c), np.uint64)
    for n in range(4):
        back = np.zeros(len(c), np.uint64)
        back[n:] = c[: len(c) - n] if n else c
        back[depth < n] = 0  # the word's start
        h = (h ^ back) * _SEED[n]
        h ^= h >> np.uint64(29)
        ok = depth >= n - 1
        grams[n, ok] = (h[ok] >> np.uint64(64 - bits)).astype(np.int32)
    return grams, word, owner, words_script, length


def viterbi(scores: np.ndarray, owner: np.ndarray, n_texts: int, switch: float) -> np.ndarray:
    """Best language of each word; scores[word, language], words in order of owner.  All texts move one word at a time together."""
    count = np.bincount(owner, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    order = np.argsort(-count, kind="stable")
    long_first, begin = count[order], begin[order]
    steps, n_lang = int(count.max(initial=0)), scores.shape[1]
    best = np.zeros((n_texts, n_lang))
    came = np.zeros(scores.shape, np.int16 if n_lang > 127 else np.int8)  # language of the word before
    own = np.arange(n_lang)
    active = np.searchsorted(-long_first, -np.arange(steps), side="left")  # texts with more than t words
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        if t:
            prev = best[:m]
            top = prev.argmax(axis=1)
            lead = prev[np.arange(m), top] - switch
            stay = prev >= lead[:, None]
            came[at] = np.where(stay, own[None, :], top[:, None])
            best[:m] = np.where(stay, prev, lead[:, None])
        best[:m] += scores[at]
    labels = np.zeros(len(scores), np.int16)
    now = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        labels[at] = now[:m]
        now[:m] = came[at, now[:m]] if t else now[:m]
    return labels


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # [1 << bits, language], log probabilities by gram
    seen: np.ndarray  # [script, language]
    settings: Settings

    def label(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """(label, owner, length, whether some language was seen in its script) of the words of all texts."""
        s = self.settings
        grams, word, owner, script, length = features(texts, s.bits)
        scores = np.zeros((len(owner), len(self.languages)))
        for lang in range(len(self.languages)):
            table = np.append(self.weight[:, lang], 0.0)  # -1 is the place after the last
            worth = table[grams[0]]
            for n in range(1, 4):
                worth += table[grams[n]]
            scores[:, lang] = np.bincount(word, weights=worth, minlength=len(owner))
        seen = self.seen[script]
        known = seen.any(axis=1)
        scores[:] = np.where(known[:, None], np.where(seen, scores, scores.min(axis=1, keepdims=True) - s.foreign), 0.0)
        return viterbi(scores, owner, len(texts), s.switch), owner, length, known

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        label, owner, length, known = self.label(texts)
        n = len(self.languages)
        held = np.bincount(owner * n + label, weights=length * known, minlength=n * len(texts)).reshape(-1, n)
        total = np.bincount(owner, weights=length, minlength=len(texts))
        top = held.argmax(axis=1)
        return [("und", 0.0) if not t else (self.languages[k], float(held[i, k] / t)) for i, (t, k) in enumerate(zip(total, top))]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end word, language) of the spans of a text."""
        label, *_ = self.label([text.encode()])
        cut = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        return [(a, b, self.languages[label[a]]) for a, b in zip(cut, cut[1:]) if b > a]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Counts n-grams of the training rows' sample in Spark; the driver gets tables of fixed size."""
    s = settings
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(s.max_languages + 1).collect()
    if len(sizes) > s.max_languages:
        raise ValueError(f"more than {s.max_languages} languages: raise max_languages, 256 KB of driver and task memory each, or clean lang")
    # a row is in the sample if its hash lies in the share of the range that leaves per_language rows of its language
    shares = [(r.lang, min(1.0, s.per_language / r.n)) for r in sizes]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(place < F.col("share")).select("lang", F.col("text").cast("binary"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text", max_bytes=1 << 20):
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for one in set(lang):
                grams, _, _, script, _ = features([t for t, x in zip(texts, lang) if x == one], s.bits)
                counts[one] = counts.get(one, 0) + np.bincount(grams[grams >= 0], minlength=1 << s.bits)
                scripts[one] = scripts.get(one, 0) + np.bincount(script, minlength=N_SCRIPTS)
        for one, c in counts.items():
            both = np.concatenate([c, scripts[one]])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at)), pa.array(at), pa.array(both[at])], names=["lang", "bucket", "n"])

    got = sample.mapInArrow(kernel, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = got["lang"].to_pylist(), got["bucket"].to_numpy(), got["n"].to_numpy()
    names = sorted(set(lang))
    table = np.zeros(((1 << s.bits) + N_SCRIPTS, len(names)))
    table[bucket, np.searchsorted(names, lang) if names else []] = n
    grams, script = table[: 1 << s.bits] + 0.5, table[1 << s.bits :]
    weight = np.log(grams / grams.sum(axis=0, keepdims=True)) if names else grams
    if names:
        weight -= weight.mean(axis=1, keepdims=True)  # only differences count; words of any length stay comparable
    return Model(names, weight / 4, script > s.script_share * np.maximum(1, script.sum(axis=0, keepdims=True)), s)


def identify(docs: DataFrame, model: Model | None = None, settings: Settings = Settings(), reject: float | None = None) -> DataFrame:
    """docs without text, with held_out, lang_pred and score; with ``reject``, docs' rows, whole, that are not ``und`` and score at least that."""
    small_batches(docs.sparkSession)
    model = model or train(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    keep = docs.schema.fields if reject is not None else [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score", "held_out")]
    names = [f.name for f in keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in slices(batches, "text", max_rows=4096, max_bytes=1 << 20):
            got = m.predict(texts)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            if reject is not None:
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array([x != "und" and y >= reject for x, y in got], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=names + ["lang_pred", "score"])

    out = docs.mapInArrow(kernel, T.StructType([*keep] if reject is not None else [*keep, *new]))
    return out if reject is not None else out.withColumn("held_out", held_out())
