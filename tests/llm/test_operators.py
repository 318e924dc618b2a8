"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from trekframe.llm import bpe, chat, decontam, embed, html, langid, pii, simhash, spans, urls
from trekframe.llm.common import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RND = random.Random(5)
WORDS = ["the", "of", "and", "Reason", "été", "straße", "niño", "house", "river", "x1", "漢字", "a", "😀"]


def prose(n: int) -> str:
    return " ".join(RND.choice(WORDS) + (". " if RND.random() < 0.2 else "") for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- components ---


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 60) if a % 20 != 19] + [(100, b) for b in range(101, 160)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {n: n // 20 * 20 for n in range(60)} | {n: 100 for n in range(100, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- language identification ---


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(1)
    parts = {"aa": ["bal", "kor", "tim"], "bb": ["zus", "pex", "wyn"], "ru": ["при", "вет", "мир"]}
    rows = [(i, " ".join("".join(r.choices(parts[k], k=3)) for _ in range(40)), k, "s", 0) for i in range(300) for k in [list(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, langid.train(docs)


def test_language_held_out_accuracy(spark, languages):
    docs, model = languages
    got = langid.identify(docs, model).where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 50 and all(r.lang == r.lang_pred and r.score > 0.9 for r in got)


def test_language_spans_of_mixed_text(languages):
    _, model = languages
    assert model.spans("balkortim korbaltim timtimbal " * 5 + "zuspexwyn wynpexzus pexzuswyn " * 5) == [(0, 15, "aa"), (15, 30, "bb")]
    assert model.spans("balkor привет мирмир balkor") and model.spans("привет")[0][2] == "ru"


def test_language_edges(spark, languages):
    docs, model = languages
    texts = [None, "", "123 !!", "balkortim", "balkortim " * 30000, "balkortim"]
    df = frame(spark, texts, [1, 2, 3, 4, 5, 4]).withColumns({"lang_pred": F.lit("clash"), "score": F.lit(9)})
    got = langid.identify(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "aa", "aa", "aa"] and [r.score for r in got[:3]] == [0, 0, 0]
    kept = langid.identify(df, model, reject=0.5)
    assert kept.columns == df.columns and kept.count() == 3
    none = langid.train(empty(spark))
    assert none.languages == [] and langid.identify(df, none).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty(spark), model).count() == 0


def test_language_of_unseen_scripts(spark, languages):
    _, model = languages
    texts = ["ახალი ამბები დღეს", "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺ", "Ελληνικά κείμενα", "balkortim ახალი", "balkortim timbalkor ახალი"]
    got = model.predict([t.encode() for t in texts])
    assert [x for x, _ in got] == ["aa"] * 5 and [round(y, 3) for _, y in got] == [0, 0, 0, round(9 / 14, 3), round(18 / 23, 3)]
    assert [r.doc_id for r in langid.identify(frame(spark, texts), model, reject=0.7).collect()] == [4]
    assert [r.doc_id for r in langid.identify(frame(spark, texts), model, reject=0.5).orderBy("doc_id").collect()] == [3, 4]


def slow_model(rows, s):
    """Gram counts, languages' weights and scripts by dictionaries."""
    seeds, mask = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], (1 << 64) - 1

    def word_grams(word):
        out = []
        for i in range(len(word)):
            h = 0
            for n in range(4):
                back = ord(word[i - n]) + 1 if i >= n else 0
                h = ((h ^ back) * seeds[n]) & mask
                h ^= h >> 29
                if i >= n - 1:
                    out.append((n, h >> (64 - s.bits)))
        return out

    cut = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    script = lambda w: next((k for a, b, k in langid.SCRIPTS if a <= ord(w[0]) <= b), 0)
    names = sorted({lang for _, lang in rows})
    counts = {x: np.full(1 << s.bits, 0.5) for x in names}
    seen = {x: {} for x in names}
    for text, lang in rows:
        for w in cut(text):
            seen[lang][script(w)] = seen[lang].get(script(w), 0) + 1
            for _, h in word_grams(w):
                counts[lang][h] += 1
    logs = np.stack([np.log(counts[x] / counts[x].sum()) for x in names], axis=1)
    logs = (logs - logs.mean(axis=1, keepdims=True)) / 4
    known = lambda x, k: seen[x].get(k, 0) > s.script_share * max(1, sum(seen[x].values()))

    def predict(text):
        words = cut(text or "")
        if not words:
            return "und", 0.0
        rows_, sure = [], []
        for w in words:
            v = [sum(logs[h, i] for _, h in word_grams(w)) for i in range(len(names))]
            ok = [known(x, script(w)) for x in names]
            sure.append(any(ok))
            rows_.append([v[i] if ok[i] else min(v) - s.foreign for i in range(len(names))] if any(ok) else [0.0] * len(names))
        best, back = rows_[0], []
        for x in rows_[1:]:
            come = [max(range(len(names)), key=lambda p, q=q: (best[p] - s.switch * (p != q), p == q, -p)) for q in range(len(names))]
            back.append(come)
            best = [best[come[q]] - s.switch * (come[q] != q) + x[q] for q in range(len(names))]
        k = int(np.argmax(best))
        path = [k]
        for come in reversed(back):
            path.append(k := come[k])
        share = [sum(len(w) for w, p, y in zip(words, path[::-1], sure) if y and p == i) for i in range(len(names))]
        top = int(np.argmax(share))
        return names[top], share[top] / sum(map(len, words))

    return predict


def test_language_training_and_prediction_against_brute_force(spark, languages):
    docs, model = languages
    rows = [(r.text, r.lang) for r in docs.where(~langid.held_out()).collect()]
    slow = slow_model(rows, model.settings)
    r = random.Random(4)
    words = [w for t, _ in rows for w in t.split()[:3]]
    texts = [" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(150)] + [None, "", "12", "q", "\0", "bal\0kor \0\0 zus", "\0привет", "漢字 bal", "plain zuspex, balkor!"]
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        want = slow(t)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), t


def test_texts_with_odd_bytes(spark):
    """U+0000 and bytes that are no UTF-8 pass every operator that reads texts."""
    df = spark.createDataFrame([(1, "a\0b c\0"), (2, "\0"), (3, "plain words here")], "doc_id bigint, text string")
    df = df.union(spark.sql("SELECT 4L, cast(X'61FF6220C328' AS string)")).withColumn("lang", F.lit("en"))
    n = df.count()
    assert langid.identify(df, langid.train(df)).count() == n and simhash.near_components(df).count() == n and spans.dedup_spans(df).count() == n and pii.find(df).count() == n
    assert decontam.decontaminate(df, df.selectExpr("doc_id AS item_id", "text")).count() == n
    got = {r.doc_id: r for r in bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(b"a\0b c\0").hexdigest() and got[4].decoded_sha256 == hashlib.sha256("a\ufffdb \ufffd(".encode()).hexdigest()
    assert html.extract(df.selectExpr("doc_id AS page_id", "'' AS url", "text AS html")).count() == n
    assert chat.read_back(chat.segments(df.selectExpr("doc_id AS conv_id", "0 AS turn", "'user' AS role", "text"))).count() == n


def test_viterbi_matches_brute_force():
    r = np.random.default_rng(0)
    scores, owner = r.normal(size=(40, 3)) * 3, np.repeat([0, 1, 3], [25, 14, 1])
    got = langid.viterbi(scores, owner, 4, 2.0)
    for t in (0, 1, 3):
        s = scores[owner == t]
        best = s[0].copy()
        back = []
        for x in s[1:]:
            come = [max(range(3), key=lambda p, q=q: best[p] - 2.0 * (p != q)) for q in range(3)]
            back.append(come)
            best = np.array([best[come[q]] - 2.0 * (come[q] != q) + x[q] for q in range(3)])
        k = int(best.argmax())
        path = [k]
        for come in reversed(back):
            path.append(k := come[k])
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert value(list(got[owner == t])) == pytest.approx(value(path[::-1]))


# --- SimHash ---


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark):
    base = [prose(60) for _ in range(12)]
    texts = base + [t.replace("the", "The", 1) for t in base] + [t + " more" for t in base] * 3 + [None, "", "  \t", "one", "One", prose(20000)] + [base[0]] * 30
    ids = RND.sample(range(10_000), len(texts) - 1)
    ids += [ids[0]]
    df = frame(spark, texts, ids).withColumns({"fp": F.lit("clash"), "component_id": F.lit("x")})
    got = [tuple(r) for r in simhash.near_components(df).collect()]
    fps = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    assert sorted((d, f % (1 << 64), c) for d, f, c in got) == sorted((ids[i], fps[i], least[find(i)]) for i in range(len(texts)))
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_components(empty(spark)).count() == 0 and simhash.near_dedup(empty(spark)).count() == 0


def test_near_dedup_of_rows_without_id(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, c), (7, c), (9, c), (8, d), (None, None), (None, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, (r.text or "").strip()) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (7, c), (8, d), (None, "")], key=str)


def test_near_dedup_of_repeated_ids(spark):
    """Different texts under one id each keep a row; of equal texts under one id one stays."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(1, a), (1, b), (1, b), (1, a), (2, c), (2, c), (3, c), (0, a)]], DOCS)
    got = sorted((r.doc_id, r.text[0]) for r in simhash.near_dedup(df).collect())
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_simhash_chunks_of_large_keys_lose_nothing(spark):
    centre = 0x0123456789ABCDEF
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in (RND.sample(range(64), 3) for _ in range(300))} | {RND.getrandbits(64) for _ in range(200)}
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    whole, cut = (components(simhash.links(fps, group=g)).collect() for g in (8192, 16))
    assert sorted(whole) == sorted(cut) and len(whole) > 200


# --- URLs ---


def test_url_parts_and_rules(spark):
    cases = [
        ("http://EXAMPLE.com/en/x?y#z", "example.com", "/en/x", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("http://m.www.example.com/en/a", "m.www.example.com", "/en/a", "www.example.com/en/"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/"), ("http://com", "com", "", None), ("x://notcom.org/?q", "notcom.org", "/", None), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://xcom/", "xcom", "/", None), ("http://com?a/", "com", "", None), ("http://b.com//en", "b.com", "//en", "com/"),
    ]
    df = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)] + [(0, cases[0][0], "")], "page_id int, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge(df.limit(0)).count() == 0


def test_url_trust_spreads_like_brute_force(spark):
    hosts = [f"h{i}.org" for i in range(8)]
    edges = [(RND.choice(hosts), RND.choice(hosts), RND.randint(1, 3)) for _ in range(20)]
    edges = [e for e in {(a, b): (a, b, n) for a, b, n in edges if a != b}.values()]
    seeds = [(h, float(i == 0), float(i == 1)) for i, h in enumerate(hosts)]
    got = {r.host: (r.trust, r.distrust) for r in urls.spread(spark.createDataFrame(edges, "src string, dst string, n bigint"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for k, turn in ((0, False), (1, True)):
        links = [(b, a, n) if turn else (a, b, n) for a, b, n in edges]
        rank = {h: s[k + 1] for h, s in zip(hosts, seeds)}
        start = dict(rank)
        for _ in range(100):
            out = {h: sum(n for a, _, n in links if a == h) for h in hosts}
            rank = {h: start[h] + 0.85 * sum(rank[a] * n / out[a] for a, b, n in links if b == h) for h in hosts}
        for h in hosts:
            assert got.get(h, (0, 0))[k] == pytest.approx(rank[h], abs=1e-4)


def test_url_trust_is_exact_to_the_tolerance(spark):
    """Cycles, hubs, dangling and far hosts, against the solved equations."""
    edges = {("a", "b"): 1, ("b", "a"): 1, ("b", "c"): 3, ("c", "hub"): 1, ("d", "d2"): 2, ("d2", "d"): 1} | {(f"x{i}", "hub"): 1 for i in range(20)} | {("hub", f"x{i}"): 1 + i for i in range(20)}
    hosts = sorted({h for e in edges for h in e} | {"alone"})
    seeds = [(h, float(h in ("a", "d", "alone")), float(h in ("hub", "d2"))) for h in hosts]
    frame_ = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n bigint")
    seeds_ = spark.createDataFrame(seeds, "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urls.spread(frame_, seeds_).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    for k in (0, 1):
        m = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in edges.items():
            s, d = (at[a], at[b]) if k == 0 else (at[b], at[a])
            m[d, s] += n
        m /= np.maximum(m.sum(axis=0, keepdims=True), 1)
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, [s[k + 1] for s in seeds])
        for h in hosts:
            assert abs(got.get(h, (0, 0))[k] - want[at[h]]) < 1e-6
    with pytest.raises(RuntimeError):
        urls.spread(frame_, seeds_, urls.Settings(max_rounds=8))


def test_url_verdicts_by_rank_match_sql(spark):
    """The registered SQL, over pages whose verdicts depend on rank."""
    import duckdb

    from trekframe.llm import sql

    hosts = [f"s{i}.{z}" for i in range(12) for z in ("org", "net", "com")]
    rows = [(i, f"http://{RND.choice(hosts)}/{RND.choice(['es', 'fr', 'en'])}/{i}", "".join(f"<a href='http://{RND.choice(hosts)}/x'>" for _ in range(RND.randint(0, 4)))) for i in range(150)] + [(900, None, None), (901, "x", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").toPandas()
    want = {r[0]: tuple(r[1:]) for r in duckdb.connect().execute(sql.OP3).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages)).collect()}
    assert len(pages) == 152 and got == want and sum(r[2] is None and r[3] == "block" for r in want.values()) > 5


def test_url_linked_hosts_are_judged_by_distrust(spark):
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://pal.org/", '<a href="http://bad.net/x">'), (3, "http://far.org/", "<a href='/own'>")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "allow")}


# --- HTML ---


def test_html_text(spark):
    page = lambda a: f'<html><head><title>T</title><style>p</style></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Big &amp; x</h1>{a}</article><aside>side</aside><footer>foot</footer>'
    cases = [
        (page("<p>One  <b>tw</b>o\n three<br>four<p>Five</p>"), "Big & x\n\nOne two three four\n\nFive"), (page('<form>f</form><p>t<!-- c --></p><section id="comments"><p>me too</p></section><script>var a="</p>";</script>'), "Big & x\n\nt"),
        (None, ""), ("", ""), ("plain &lt;text&gt; 2 < 3", "plain <text> 2 < 3"), (page("<p>" + "w " * 50000 + "</p>"), "Big & x\n\n" + "w " * 49999 + "w"), ("<div class=cookie-notice>n</div><div><p>a</p><p>b", "a\n\nb"),
    ]
    rows = [(i, f"http://h{i % 2}/{i}", h) for i, (h, _) in enumerate(cases)] + [(0, "http://h0/0", cases[0][0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit(3)})
    got = html.extract(df)
    found = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    assert found == {i: (t, len(t)) for i, (_, t) in enumerate(cases)} and got.count() == len(rows)
    assert html.extract(df.limit(0)).count() == 0
    few = html.extract(df, few=0)
    assert {r.page_id: r.text for r in few.collect()} == {i: t for i, (_, t) in enumerate(cases)}


def test_html_template_without_article(spark):
    rows = [(i, "http://h/x", f'<body><div id="top">site</div><div class="post-body"><p>{prose(40)}</p>{"<p>more</p>" * i}</div></body>') for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html.templates(df.select(F.lit(1).cast("bigint").alias("host"), "html")).collect()
    [main] = {e[1] for e in html.scan(rows[0][2]) if e[0] == html.OPEN and e[2] == "div"} - {html.scan('<body><div id="top">')[3][1]}
    assert [(r.host, r.main) for r in got] == [(1, main)]
    assert all("site" not in r.text for r in html.extract(df).collect())


def portal(i: int) -> str:
    slogan = "<div>Site name and slogan of this portal</div>"
    return f"<html><body>{slogan}<ul>{'<li><a>x</a></li>' * (i % 4)}</ul><div><h1>{prose(5)} {i}</h1>{''.join(f'<p>{prose(30)}</p>' for _ in range(1 + i % 3))}<b>All rights reserved by us</b></div></body></html>"


@pytest.mark.parametrize("few", [200_000, 0])
def test_html_portal_without_class_names(spark, few):
    """Six pages lose the shared slogan by the main slot; ten also lose the text run that all articles share."""
    pages = [("six", portal(i)) for i in range(6)] + [("ten", portal(i)) for i in range(10)]
    df = spark.createDataFrame([(k, f"http://{h}.org/{k}", p) for k, (h, p) in enumerate(pages)] + [(99, None, None), (None, None, "")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df, few=few).collect()}
    for k, (h, p) in enumerate(pages):
        want = [" ".join(x.split()) for x in re.findall(r"<(?:h1|p)>(.*?)</", p)]
        if h == "six":
            want.append("All rights reserved by us")
        assert got[k].split("\n\n") == want
    assert got[99] == "" and got[None] == ""


def test_html_copies_of_a_page_keep_their_text(spark):
    page = portal(2)
    rows = [(i, "http://h/x", page) for i in range(12)]
    assert all("All rights" in r.text and r.n_chars > 100 for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())


def test_html_classes_against_brute_force(spark):
    pages = [("a", portal(i)) for i in range(7)] + [("b", f"<div>{'<p>x' * (i % 3)}<i>{i}</i><u></u></div>") for i in range(5)] + [("b", None)]
    df = spark.createDataFrame([(1 if h == "a" else 2, p) for h, p in pages], "host bigint, html string")
    got: dict = {}
    for r in html.classes(df).collect():
        got.setdefault((r.host, r["class"]), set()).add((r.kind, r.token))
    want: dict = {}
    for host, name in ((1, "a"), (2, "b")):
        own = [p or "" for h, p in pages if h == name]
        counts = [[(k, t) for k, t, *_ in html.scan(p) if k != html.BREAK and t] for p in own]
        for x in {x for c in counts for x in c}:
            vector = tuple(c.count(x) for c in counts)
            on = sum(v > 0 for v in vector)
            if 2 * on >= len(own) and (x[0] != html.TEXT or on >= 3):
                want.setdefault((host, x[0] == html.TEXT, vector), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 6


def test_html_classes_that_change_their_order_make_no_template(spark):
    a, b = "<div id=a><p>{} " + "one two " * 20 + "</p></div>", "<div id=b><p>three</p></div>"
    rows = [(1, f"<body>{a + b if i % 2 else b + a}</body>".format(f"page{i}")) for i in range(6)]
    df = spark.createDataFrame(rows, "host bigint, html string")
    assert html.templates(df).count() == 0 and html.templates(df.where(F.col("html").contains("<body><div id=a>"))).first().main is not None


def test_html_hostile_pages_end():
    import time

    start = time.time()
    for p in ["<script" * 150_000, "<a " * 350_000, '<a "' * 250_000, "<a ='" * 200_000, "<!--" * 250_000, '<a title="x>' * 80_000, "<div>" * 100_000 + "</b>" * 50_000, "<article>x" * 50_000, "<p>" * 100_000]:
        html.main_text(p)
    assert time.time() - start < 60
    assert html.main_text("a < b <c") == "a < b <c" and html.main_text('<p title="a>b">x') == "x" and html.main_text("<p title=it's>x</p>y'") == "x\n\ny'"


def test_html_words_do_not_drop_the_main_slot(spark):
    text = "the river at night " * 10
    cases = [
        (f'<body><nav>menu</nav><article class="post has-comments"><p>{text}</p><div class="comments">me too</div></article></body>', text.strip()),
        (f'<body><div id="page" class="no-sidebar"><div class="sidebar">side</div><article><p>{text}</p></article></div></body>', text.strip()),
        (f'<body><div class="no-sidebar"><p>{text}</p><div class="ad">buy</div></div></body>', text.strip()),
        (f'<body><article><p>{text}</p></article><div id="comments"><article>me too</article></div></body>', text.strip()),
        (f'<body><div class="share">x</div><article class="post social-story"><p>{text}</p></article></body>', text.strip()),
    ]
    rows = [(10 * i + k, f"http://h{i}/{k}", h) for i, (h, _) in enumerate(cases) for k in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {10 * i + k: t for i, (_, t) in enumerate(cases) for k in range(3)}


# --- substring dedup ---


def test_spans(spark):
    passage = ". ".join(f"Sentence {i} has these seven plain words" for i in range(10)) + "."
    texts = [f"Alpha one two. {passage} Omega end.", f"Different start here.\n{passage}\nAnother end.", "Clean text. Of. In. The. On.", "Of. In. The. On. Clean also.", None, "", passage + " " + passage, "no stop " * 40000, "x", f"Alpha one two. {passage} Omega end."]
    df = frame(spark, texts, [5, 9, 3, 4, 1, 2, 20, 21, 22, 30]).withColumns({"n_removed": F.lit("clash"), "h": F.lit(1), "doc": F.lit(1)})
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.dedup_spans(df).collect()}
    assert got[5] == (texts[0], 0) and got[9] == ("Different start here.\nAnother end.", 10)
    assert got[3] == (texts[2], 0) and got[4] == (texts[3], 0) and got[1] == (None, 0) and got[2] == ("", 0)
    assert got[20] == ("", 20) and got[30] == ("", 12) and got[21][1] > 2000 and got[21][0].split() == ["no", "stop"] * (len(got[21][0].split()) // 2)
    assert spans.dedup_spans(empty(spark)).count() == 0


def test_spans_against_brute_force(spark):
    pool = [" ".join(RND.choice("abcdefgh") * 2 for _ in range(RND.randint(1, 30))) + "." for _ in range(25)]
    texts = [" ".join(RND.choices(pool, k=RND.randint(0, 14))) for _ in range(60)]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.dedup_spans(frame(spark, texts)).collect()}
    s, first = spans.Settings(), {}

    def runs(x):  # every run of several sentences, not only the shortest
        w = [len(t.split()) for t in x]
        return [(i, j) for i in range(len(x)) for j in range(i + 2, len(x) + 1) if sum(w[i:j]) >= s.min_words]

    cut = [re.split(r"(?<=\.) ", t) if t else [] for t in texts]
    for d, x in enumerate(cut):
        for i, j in runs(x):
            first.setdefault(tuple(x[i:j]), d)
    for d, x in enumerate(cut):
        gone, seen = set(), set()
        for i, j in runs(x):
            k = tuple(x[i:j])
            if first[k] != d or k in seen:
                gone |= set(range(i, j))
            seen.add(k)
        assert got[d][1] == len(gone)
        assert got[d][0].split() == " ".join(t for i, t in enumerate(x) if i not in gone).split()


def test_spans_of_text_without_stops(spark):
    r = random.Random(3)
    own = lambda n: " ".join(str(r.random()) for _ in range(n))
    shared, texts = own(200), []
    texts = [f"{own(37)} {shared} {own(41)}", f"{own(90)} {shared}", own(300)]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.dedup_spans(frame(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[2] == (texts[2], 0)
    assert got[1][1] >= 2 and len(set(got[1][0].split()) & set(shared.split())) <= 64 and texts[1][: len(own(1)) * 80] in got[1][0] + texts[1]


def test_spans_of_rows_without_id(spark):
    p = ". ".join(f"Sentence {i} has these seven plain words" for i in range(10)) + "."
    rows = [(None, f"One. {p}"), (None, f"Two. {p}"), (7, p), (7, p), (7, None)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert [n for *_, n in got if n] == [10, 10, 10] and sum(n == 0 for *_, n in got) == 2


# --- decontamination ---


def slow_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - 12)) if x else ():
            p = x[i : i + 13]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_decontamination_against_brute_force(spark, block_words):
    items = [(i, prose(RND.choice([1, 2, 5, 13, 14, 40]))) for i in range(15)] + [(50, None), (51, " .,"), (3, "The the"), (3, "The the"), (10, "a a a a a a a a a a a a a a a a")]
    texts = [prose(80), prose(30) + " " + items[4][1] + "! " + prose(300), items[0][1].upper(), None, "", "...", "a " * 20000, items[7][1] + items[8][1]] + [prose(RND.randint(1, 60)) for _ in range(30)]
    docs = frame(spark, texts).withColumns({"n_hit": F.lit("clash"), "contaminated": F.lit(1), "item_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, bench, block_words=block_words).collect()}
    assert got == {i: slow_hits(t, items) for i, t in enumerate(texts)}
    kept = decontam.decontaminate(docs, bench, block_words=block_words, drop=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g[4]}


def test_decontamination_share_is_exact(spark):
    text = " ".join(["one two three"] + [f"w{i}" for i in range(7)])
    bench = spark.createDataFrame([(None, "one two three"), (1, "w0 w1")], "item_id bigint, text string")
    got = [[r.contaminated for r in decontam.decontaminate(frame(spark, [text]), bench.where(w), min_share=m).collect()][0] for w, m in (("item_id IS NULL", 0.3), ("item_id IS NULL", 0.31), ("item_id = 1", 0.2), ("true", 0.5), ("true", 0.8))]
    assert got == [True, False, True, True, False]
    odd = frame(spark, [text]).withColumns({"spans": F.lit(1), "items": F.lit(2)})
    assert [(r.n_hit, r.n_items, r.spans) for r in decontam.decontaminate(odd, bench, block_words=1).collect()] == [(5, 1, 1)]


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in decontam.decontaminate(frame(spark, ["a b"]), none).collect()] == [0]
    assert decontam.decontaminate(empty(spark), none).count() == 0


# --- personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_against_regex(spark):
    parts = [*"ab.@-_1 2.+()%é\U0001f600\ue000", "4111111111111111", "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "5500-0000-0000-0004 ", "256.1.1.1"]
    texts = ["".join(RND.choices(parts, k=RND.randint(0, 25))) for _ in range(3000)] + ["a@b.com_x@y.com", "1 " * 30000, "a." * 9000 + "@" + "b." * 9000 + "c", "1" * 30000, None, ""]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, texts), pii.Settings(support=1 << 30)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(t))


def test_pii_terms_and_rewriting(spark):
    secret = "Call Zorblatt at +1 (555) 123-4567 now."
    texts = [f"{secret} {i} the river" for i in range(4)] + ["the river at night now, Call me"] * 30 + [None, "", "mail a@b.co, 1.2.3.4 or 4111 1111 1111 1111"]
    df = frame(spark, texts).withColumns({"terms": F.lit("clash"), "spans": F.lit(1), "b": F.lit(2)})
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert found[0].n_phone == 1 and found[0].spans == "phone:17:34,term:5:13" and found[10].spans == "" and found[0].base_sha256 == hashlib.sha256(b"phone:17:34").hexdigest()
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.sanitise(df).collect()}
    assert clean[0][0] == "Call  at [PHONE] now. 0 the river" and clean[0][1] == len(clean[0][0])
    assert clean[36][0] == "mail [EMAIL], [IP] or [CARD]" and clean[34] == (None, 0) and clean[35][0] == ""
    assert pii.sanitise(df).columns == df.columns and pii.sanitise(df).count() == len(texts)
    assert pii.find(empty(spark)).count() == 0 and pii.sanitise(empty(spark)).count() == 0


def test_pii_terms_of_entities_seen_once_or_twice(spark):
    once, twice = "Call Zorblatt at +1 (555) 123-4567 now.", "Call Quuxley at q@b.co now."
    texts = [once, f"{twice} a", f"{twice} b"] + ["the river at night now, Call me a b"] * 200
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert clean[0] == "Call [NAME] at [PHONE] now." and clean[1] == "Call [NAME] at [EMAIL] now. a" and clean[2] == "Call [NAME] at [EMAIL] now. b"
    assert all(clean[i] == texts[i] for i in range(3, len(texts)))


def test_pii_cost_of_a_text_with_many_spans(spark):
    import time

    text, start = "10.0.0.1 word " * 20_000, time.time()
    rows = [(1, text), (1, text), (None, "a@b.co"), (None, "c@d.co"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("doc", "row", "base", "n", "terms", "k")})
    got = pii.find(df).collect()
    assert sorted(r.n_ip for r in got) == [0, 0, 0, 20_000, 20_000] and sorted(r.n_email for r in got) == [0, 0, 0, 1, 1]
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and sorted(r.text or "" for r in clean.collect()) == sorted(["", "[EMAIL]", "[EMAIL]", "[IP] word " * 20_000, "[IP] word " * 20_000])
    assert time.time() - start < 240


def test_pii_runs_no_python(spark):
    plan = pii.find(frame(spark, ["a@b.co x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- BPE ---


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_tiktoken(tokenizer):
    mine, theirs = tokenizer
    texts = ["".join(RND.choices("ab'stremvld  \n\t.,!1 2é漢\u3000\xa0\x85\x1c😀", k=RND.randint(0, 40))) for _ in range(4000)] + ["", "\0\0", "'" * 50, "x" * 3000, "  \n " * 200]
    for text, (ids, offsets) in zip(texts, mine.encode(texts)):
        assert ids == theirs.encode_ordinary(text) and mine.decode(ids, offsets) == text.encode() and offsets[-1] == len(text.encode())
        k = len(offsets) // 2
        assert mine.decode(ids, offsets, k) == text.encode()[offsets[k] :] if len(offsets) > 1 else not text


def test_bpe_classes_of_all_code_points(tokenizer):
    mine, theirs = tokenizer
    every = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) != "Cs"]
    texts = ["".join(f"a{c}1{c} {c}{c}'s\n" for c in every[i : i + 256]) for i in range(0, len(every), 256)]
    for i in range(0, len(texts), 64):
        for t, (ids, _) in zip(texts[i : i + 64], mine.encode(texts[i : i + 64])):
            assert ids == theirs.encode_ordinary(t)


def test_bpe_decoding_checks_offsets(tokenizer):
    mine, _ = tokenizer
    [(ids, offsets)] = mine.encode(["the river at night"])
    with pytest.raises(ValueError):
        mine.decode(ids[:-1], offsets)
    with pytest.raises(ValueError):
        mine.decode(ids, offsets + 1)


def test_bpe_frame(spark, tokenizer):
    _, theirs = tokenizer
    texts = [None, "", prose(50), prose(20000), prose(50)]
    df = frame(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[2].piece_offsets[-1] == len(texts[2].encode()) and got[0].piece_offsets == [0]
    assert bpe.encode(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


# --- embeddings ---


@pytest.mark.parametrize("cell", [4096, 40])
def test_embeddings_against_brute_force(spark, cell):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 8))
    xs = [(centres[i % 12] + r.normal(size=8) * s).astype(np.float32) for i, s in enumerate(r.uniform(0, 0.6, size=300))]
    xs += xs[:30] + [xs[3]] * 40
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(xs)] + [(9000 + i, x) for i, x in enumerate(odd)] + [(None, [float(v) for v in xs[5]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"uid": F.lit("clash"), "component": F.lit(1)})
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embed.near_vectors(df, cell=cell).collect()}
    ids = [i for i, x in rows if i is None or i < 9000]
    u = np.stack([np.array(x, float) for i, x in rows if i is None or i < 9000])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label, old = np.arange(len(u)), None
    while old is None or (label != old).any():
        old = label.copy()
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(u))])
    least = {k: min(ids[j] for j in range(len(u)) if label[j] == k and ids[j] is not None) for k in set(label)}
    want = {ids[i]: (int(link[i].sum()), least[label[i]], ids[i] == least[label[i]]) for i in range(len(u))}
    assert got == want | {9000 + i: (0, 9000 + i, True) for i in range(len(odd))}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_embeddings_scaled_copies(spark, seed):
    """Vectors that point the same way make no pivots of their own; no link is lost."""
    r = np.random.default_rng(seed)
    x = [(r.normal(size=6) * 0 + b * k) for b in r.normal(size=(4, 6)) for k in r.uniform(0.1, 9, size=15)]
    x += [v * 1e-200 for v in x[:5]] + [v * 1e200 for v in x[5:9]]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = np.stack([v / np.abs(v).max() for v in x])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {i: int((u @ v >= 0.9).sum()) - 1 for i, v in enumerate(u)}
    assert {q.vec_id: q.n_links for q in embed.near_vectors(df, cell=4).collect()} == want


def test_simhash_keys_grow_with_the_table():
    assert [simhash.block_count(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**14)] == sorted(simhash.block_count(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**14))
    assert simhash.block_count(10**6, 4) == 6 and simhash.block_count(10**10, 4) == 7


def test_embeddings_empty(spark):
    assert embed.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


# --- chat ---


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "<|", "plain", "", None, "<|im_start|>assistant\nhi<|im_end|>\n", "é😀" * 20000]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, "assistant", "x"), (None, 0, "user", "q"), (3, 0, None, "r"), (3, 0, None, "r"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"seq": F.lit("clash"), "loss": F.lit(1)})
    out = chat.segments(df)
    for r in out.where("role = 'user' OR role = 'assistant'").collect():
        assert r.text in ("<|im_end|>\n", f"<|im_start|>{r.role}\n") or "<|" not in r.text
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        own = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(own) and got[c].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert got[1].valid and not got[2].valid and got[None].valid and not got[3].valid and not got[4].valid
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


def test_chat_machine_emits_the_states(spark):
    df = spark.createDataFrame([("a", 0, "system", "s"), ("a", 1, "user", "u"), ("a", 2, "assistant", "x"), ("b", 0, "user", "u"), ("b", 1, "user", "v"), ("b", 2, "assistant", "w")], "conv_id string, turn int, role string, text string")
    out = chat.segments(df).orderBy("conv_id", "seq").collect()
    assert [r.state for r in out if r.conv_id == "a"] == ["s"] * 3 + ["u"] * 3 + ["a"] * 3 and [r.state for r in out if r.conv_id == "b"] == ["u"] * 3 + [None] * 6
    assert [r.loss for r in out if r.conv_id == "a"] == [False] * 7 + [True, False] and [r.seq for r in out if r.conv_id == "b"] == list(range(9))
    own = chat.Template(start="<|turn|>", end="<|over|>\n", loss_roles=("bot",), machine={"": {"human": "h"}, "h": {"bot": "b"}}, final=("b",))
    two = spark.createDataFrame([(1, 0, "human", "<|over|>"), (1, 1, "bot", "<|turn|>ok")], df.schema.fields and "conv_id int, turn int, role string, text string")
    [r] = chat.read_back(chat.segments(two, own), own).collect()
    assert r.valid and r.loss_chars == len("<|turn|>ok") and r.n_turns == 2
    with pytest.raises(ValueError):
        chat.Template(start="###")
