"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm import test_operators as T
from trekframe.llm import bpe, langid


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    leak = T.prose(60)
    texts = [T.prose(120) for _ in range(25)]
    texts += [texts[0], texts[1] + " x", leak + " " + T.prose(40), None, "", "12 34", "mail me: a@b.co please " + T.prose(50), T.prose(9000)]
    docs = T.frame(spark, texts, range(100, 100 + len(texts)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(docs)
    keep = [(100 + i, t) for i, (t, (lang, score)) in enumerate(zip(texts, model.predict([None if t is None else t.encode() for t in texts]))) if lang != "und" and score >= 0.5]
    fps = [T.slow_fingerprint(t) for _, t in keep]
    group = list(range(len(keep)))
    for _ in keep:
        group = [min(group[j] for j in range(len(keep)) if bin(fps[i] ^ fps[j]).count("1") <= 4) for i in range(len(keep))]
    keep = [x for i, x in enumerate(keep) if group[i] == i]
    keep = [(i, t) for i, t in keep if not T.slow_hits(t, [(1, leak)])[4]]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in keep:
        for kind, a, b in sorted(T.slow_base(t), key=lambda x: -x[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        want[i] = hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "personal_data", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, ties and clashing columns pass every stage."""
    import corpus_pipeline

    r = T.random.Random(2)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    texts = [" ".join(word() for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[4], None, None, None), (None, " ".join(word() for _ in range(40)), None, "s", 0), (None, None, None, None, None), (50, "", "en", "s", 0), (51, "mail a@b.co " + texts[5][:90], "en", None, None)]
    docs = spark.createDataFrame(rows, T.DOCS).withColumns({c: T.F.lit("clash") for c in ("text_", "component", "fp", "__id", "__rows", "spans", "base", "row", "doc", "k", "share", "score", "held_out", "n_hit", "contaminated")})
    spark.createDataFrame([(None, None), (1, ""), (None, "never found here at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
    assert len(kept["language_id"]) == len(rows) - 2 and len(kept["decontaminate"]) == len(rows) == len(kept["personal_data"])
    assert len(kept["near_dedup"]) == 30 + 1 + 1 + 1  # one of each text; 50 stands for those without one
    assert sum("[EMAIL]" in (x.text or "") for x in kept["personal_data"]) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(rows) and all(x.n_tokens == 0 for x in last if x.decoded_sha256 == hashlib.sha256(b"").hexdigest())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    T.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
