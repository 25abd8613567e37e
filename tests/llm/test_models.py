"""Learned operators, exact search and the pipeline: small tables, odd rows, brute force."""

from __future__ import annotations

import zlib

import numpy as np

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_restored_spellings():
    from annospark.llm import toxicity
    grams = toxicity._trigrams(["the idiot and the moron were stupid losers in trash"] * 50)
    features = toxicity.Features(toxicity.character_model(grams))
    for disguised, plain in {"1d10t": "idiot", "m0r0n": "moron", "i.d.i.o.t": "idiot", "$tupid": "stupid", "moronnn": "moron"}.items():
        assert plain in features.restored(disguised)
    assert "idiot" in features.words("an i d i o t here")
    assert features.restored("plain") == ("plain",) and features.words("") == []


def test_classifiers_on_odd_rows(spark):
    from annospark.llm import pu_quality, toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "a", 0), (None, "x", "en", "a", 1)], DOCS)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for score, modulus, remainder in ((toxicity.score_toxicity, 4, 2), (pu_quality.score_quality, 5, 0)):
        rows = score(docs.unionByName(odd), labels).collect()
        assert len(rows) == docs.count() + 3
        for r in rows:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
            if r["doc_id"] is not None:
                assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert score(docs.limit(0), labels).count() == 0
        assert score(odd, labels.limit(0)).count() == 3


def test_exact_top_k(spark):
    from annospark.llm import topk
    pick = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in pick.integers(-3, 4, 4) / 64]) for i in range(120)]  # few values: many ties
    odd = [(200, None), (201, [float("nan")] * 4), (None, [0.0] * 4), (202, [0.0, None, 0.0, 0.0])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(frame, bins=4).collect()}
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    want = set()
    for a in range(0, 120, 20):
        ranked = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:20]
        want |= {(a, n + 1, b, -s) for n, (s, b) in enumerate(ranked)}
    assert got == want
    assert topk.exact_top_k(frame.limit(0)).count() == 0


def test_pages():
    from annospark.llm import html_content
    weights = html_content.train([])
    page = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; '
            'more</h1><p>First  line\nof the text, long enough to be read.<p>Second line of the text, just as long.</article>'
            "<footer>&copy; x</footer>")
    assert html_content.main_text(page, weights) == ("Head & more\nFirst line of the text, long enough to be read.\n"
                                                     "Second line of the text, just as long.")
    assert html_content.main_text(None, weights) == html_content.main_text("", weights) == ""


def test_pipeline_stages(spark):
    import corpus_pipeline
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(1 <= r["length"] <= 1024 and r["offset"] + r["length"] <= 1024 for r in packed)
