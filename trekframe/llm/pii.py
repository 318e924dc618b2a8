"""Personal data: patterns with checks, and information-theoretic sanitisation of the terms around them.

All column expressions; nothing runs in Python on the executors.

Base spans are the leftmost matches of four patterns (see ``KINDS``), of which
failing ones are dropped.  Each found value is a protected entity e.  A term t
co-occurs with e where it stands, as a whole run of letters and digits, within
``context`` code points of a mention; that is the definition of co-occurrence,
and every mention and term of every document counts.  Over all documents, with
df as the number of documents,

    IC(e) = ln(N / df(e)),   PMI(t; e) = ln(N * df(t, e) / (df(t) * df(e))),

where df(t, e) counts documents with t near e.  PMI / IC is the share of the
entity's information that the term discloses.  A term from ``generalise`` on is
replaced by its class, from ``remove`` on it is removed, wherever it stands near
that entity.  A pair seen in fewer than ``support`` documents is judged too: its
df(t) is smoothed by as many documents with t and without e as are missing, so
what rests on one document counts for less, and in a small corpus for too little.

df(t) is counted over every word of every document: each task first counts its
own words by hash, so a frequent word is one row a task.  Texts without a base
span take no part in any shuffle.

Java's matcher recurses over repeated groups, so separators between digits and
dots between labels are first replaced, one for one, by a private-use character;
the patterns are then runs of one class, and a run of any length is one match.
Positions are sums of the lengths of what ``split`` leaves and what was matched.
No array is built by appending to it whole (see ``running``), and texts with
spans are cut into chunks, so the cost of a text grows with its length.

Defined results: a null text is empty; digits or labels in any number are
read whole; spans that overlap are merged when a text is rewritten, and the kind
of the first, then longest, wins; rows with equal id and text are one document;
null ids are kept, told apart by their texts; an empty table gives an empty
result; other columns, whatever their names, are ignored by ``find`` and kept by
``sanitise``, which updates n_chars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
_M = "\ue000"  # stands for one separator


@dataclass(frozen=True)
class Settings:
    context: int = 64
    support: int = 3
    generalise: float = 0.75
    remove: float = 0.95


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, zero: Column, op) -> Column:
    """For each of the values, op over zero and all before it.

    Appending to an array copies it, so a fold over n values costs n * n.  Here
    blocks of about sqrt(n) values are folded alone, each from what the blocks
    before it come to.
    """

    def fold(items, start):
        return F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def cut(v):
        n = F.size(v)
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size).cast("int") - 1)), lambda k: F.slice(v, k * size + 1, size))

    def run(blocks):
        starts = fold(F.transform(blocks, lambda x: F.aggregate(x, zero, op)), zero)
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda x, start: F.slice(fold(x, start), 1, F.size(x))))

    return let(values, lambda v: let(cut(v), run))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of a pattern's matches; code points, end exclusive."""

    def placed(found, gaps):
        before = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), F.lit(0), lambda a, x: a + x)
        pair = F.arrays_zip(before.alias("at"), gaps.alias("gap"), found.alias("m"))
        return F.transform(pair, lambda x: F.struct((x["at"] + F.length(x["gap"])).alias("start"), (x["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("m")))

    def some(t):
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: let(F.slice(F.split(t, F.lit(pattern), F.lit(-1)), 1, F.size(found)), lambda gaps: placed(found, gaps)))

    return let(text, some)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind array<struct<start, end, value>>; value names the entity.  text must not be null."""
    safe = F.translate(text, _M, "\ue001")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    as_span = lambda found, value: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), value(x["m"]).alias("value")))
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")

    dotted = F.regexp_replace(safe, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _M)
    local, label = rf"A-Za-z0-9._%+\-{_M}", "A-Za-z0-9-"
    email = matches(dotted, rf"(?:\G|(?<![{local}]))[{local}]++@(?=[{label}]++{_M})[{label}{_M}]++")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    ip = matches(safe, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    ip = F.filter(ip, lambda x: x["m"].rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
    joined = F.regexp_replace(safe, r"(?<=[0-9])[\x20-](?=[0-9])", _M)
    card = matches(joined, rf"[0-9][0-9{_M}]++")
    card = F.filter(card, lambda x: F.length(digits(x["m"])).between(13, 19))
    card = F.filter(card, lambda x: _luhn(digits(x["m"])))
    phone = F.filter(matches(safe, r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: F.length(digits(x["m"])).between(9, 15))
    given = lambda test, found, value: F.when(test, as_span(found, value)).otherwise(none)
    return {
        "email": given(F.contains(text, F.lit("@")), email, lambda m: F.lower(F.translate(m, _M, "."))),
        "ip": given(text.rlike(r"[0-9]\.[0-9]"), ip, lambda m: m),
        "card": given(text.rlike(r"[0-9][0-9\x20-]{11,}[0-9]"), card, digits),
        "phone": given(F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]"), phone, digits),
    }


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def with_base(docs: DataFrame) -> DataFrame:
    """(row: the columns but text, doc, text, n: its code points, base: its base spans by kind as listed, then start)."""
    found = base_spans(F.coalesce(F.col("text"), F.lit("")))

    def named(kind: str) -> Column:
        return F.transform(found[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    base = F.concat(*map(named, KINDS)).cast(SPANS)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select(row.alias("row"), F.xxhash64("doc_id", "text").alias("doc"), "text", F.length("text").alias("n"), base.alias("base"))


CHUNK = 1024


def near_terms(hit: DataFrame, context: int) -> DataFrame:
    """(doc, e, start, end, t, word) of the whole terms near base spans, without those that share a code point with one.

    Texts are cut into chunks with a margin of the context to each side, and
    spans are dealt to the chunks they reach: a chunk and the spans in it are
    bounded, whatever the text's length.
    """
    margin, b = context + 1, F.col("b")
    span = F.struct(b["start"].alias("start"), b["end"].alias("end"), "n", F.xxhash64(b["kind"], b["value"]).alias("e"))
    first, last = F.expr(f"cast(greatest(0, b.start - {margin}) div {CHUNK} as int)"), F.expr(f"cast((b.end + {margin}) div {CHUNK} as int)")
    spans = hit.select("doc", "n", F.explode("base").alias("b")).select("doc", F.explode(F.sequence(first, last)).alias("k"), span.alias("span"))
    spans = spans.groupBy("doc", "k").agg(F.collect_set("span").alias("spans"))

    def pieces(parts):
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        left = lambda i: F.when(i > 0, F.substring(part(i - 1), -margin, margin)).otherwise("")
        return F.transform(parts, lambda own, i: F.struct(i.alias("k"), (i * CHUNK - F.length(left(i))).alias("shift"), F.concat(left(i), own, F.substring(part(i + 1), 1, margin)).alias("piece")))

    chunks = hit.select("doc", F.inline(let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), pieces)))
    words = F.transform(matches(F.col("piece"), r"[\p{L}\p{N}]+"), lambda x: F.struct((x["start"] + F.col("shift")).alias("start"), (x["end"] + F.col("shift")).alias("end"), x["m"].alias("word")))
    words = F.filter(words, lambda w: ~F.exists("spans", lambda y: (y["start"] < w["end"]) & (y["end"] > w["start"])))
    rows = chunks.join(spans, ["doc", "k"]).select("doc", "k", "spans", words.alias("words"))
    # a word up to the very edge of the context counts as running on beyond it, unless the text begins or ends there
    near = f"""flatten(transform(spans, s -> transform(filter(words, w ->
        (s.start div {CHUNK} = k AND w.end <= s.start AND (w.start > s.start - {context} OR w.start = 0 AND s.start <= {context}))
        OR (s.end div {CHUNK} = k AND w.start >= s.end AND (w.end < s.end + {context} OR w.end = s.n AND s.n <= s.end + {context}))), w -> named_struct('e', s.e, 'start', w.start, 'end', w.end, 'word', w.word))))"""
    return rows.select("doc", F.inline(F.expr(near))).select("doc", "e", "start", "end", F.xxhash64(F.lower("word")).alias("t"), "word")


def document_counts(docs: DataFrame) -> DataFrame:
    """(t, df) of every term of every document, by hash."""
    terms = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return docs.where("text IS NOT NULL").select(F.explode(terms).alias("w")).groupBy(F.xxhash64("w").alias("t")).agg(F.count("*").alias("df"))


def disclosing(docs: DataFrame, hit: DataFrame, s: Settings) -> DataFrame:
    """(doc, terms): the spans, kind ``term``, of what discloses too much, by document."""
    near = stored(near_terms(hit, s.context), "near-terms")
    n = docs.count()
    pairs = near.select("doc", "e", "t").distinct().groupBy("e", "t").agg(F.count("*").alias("both"))
    entities = hit.select("doc", F.explode("base").alias("b")).select("doc", F.xxhash64("b.kind", "b.value").alias("e")).distinct().groupBy("e").agg(F.count("*").alias("df_e"))
    known = pairs.join(entities, "e").join(document_counts(docs), "t")
    ic = F.log(F.lit(float(n))) - F.log(F.col("df_e"))
    # docs counts rows, so a repeated row may make df exceed a pair's count, never the reverse
    missing = F.greatest(F.lit(0), F.lit(s.support) - F.col("both"))
    share = (ic + F.log("both") - F.log(F.greatest("df", "both") + missing)) / F.when(ic > 0, ic)
    bad = known.select("e", "t", share.alias("share")).where(F.col("share") >= s.generalise)
    kind = F.when(F.col("word").rlike(r"^\p{N}+$"), "NUMBER").when(F.col("word").rlike(r"^\p{Lu}"), "NAME").otherwise("TERM")
    value = F.when(F.col("share") >= s.remove, F.lit("")).otherwise(kind)
    spans = near.join(bad, ["e", "t"]).groupBy("doc", "start", "end").agg(F.min(value).alias("value"))  # '' is least: removal wins
    term = F.struct(F.lit("term").alias("kind"), "start", "end", "value")
    return spans.groupBy("doc").agg(F.sort_array(F.collect_set(term)).alias("terms"))


def with_spans(docs: DataFrame, found: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows of found (see with_base) without base spans, and the others with their terms."""
    hit = found.where(F.size("base") > 0)
    terms = disclosing(docs, hit, settings)
    marked = hit.join(terms, "doc", "left").withColumn("terms", F.coalesce("terms", F.array().cast(SPANS)))
    return found.where(F.size("base") == 0), marked


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    docs = docs.select("doc_id", "text")
    # texts without a span are not needed again
    found = stored(with_base(docs).withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "personal")
    clean, marked = with_spans(docs, found, settings)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    some = marked.select("row.doc_id", *(count(k) for k in KINDS), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.concat("base", "terms")).alias("spans"))
    none = clean.select("row.doc_id", *(F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return some.unionByName(none)


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the mark of its first, then longest."""
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)
    mark = lambda x: F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["value"] == "", "").otherwise(F.concat(F.lit("["), x["value"], F.lit("]")))
    join = lambda chars, a, n: F.array_join(F.slice(chars, a + 1, n), "")

    def write(x, chars):
        begun = running(F.transform(x, lambda s: s["end"]), F.lit(0), lambda a, end: F.greatest(a, end))
        # where the spans before a span end: it is the first of a run if it does not begin before that
        pairs = F.filter(F.arrays_zip(x.alias("s"), begun.alias("at")), lambda p: p["s"]["start"] >= p["at"])
        last = F.array_max(F.transform(x, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(join(chars, p["at"], p["s"]["start"] - p["at"]), mark(p["s"]))), ""), join(chars, last, F.size(chars) - last))

    return let(F.array_sort(spans, order), lambda x: let(F.split(text, F.lit("")), lambda chars: write(x, chars)))


def sanitise(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with its texts rewritten: base spans become [KIND], terms their class or nothing."""
    clean, marked = with_spans(docs, stored(with_base(docs), "personal"), settings)

    def columns(text: Column, n: Column) -> list[Column]:
        own = {"text": text} | ({"n_chars": n.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
        return [own.get(c, F.col("row")[c]).alias(c) for c in docs.columns]

    done = marked.select("row", rewritten(F.col("text"), F.concat("base", "terms")).alias("text"))
    kept = F.col("row")["n_chars"] if "n_chars" in docs.columns else F.lit(0)
    return clean.select(*columns(F.col("text"), kept)).unionByName(done.select(*columns(F.col("text"), F.length("text"))))
