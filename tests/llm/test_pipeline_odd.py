"""The corpus pipeline end to end on empty, null-only and repeated rows."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = ("The river town held a market in summer and people came by boat to buy bread, salt and paper while others walked along "
        "the winter road past the old stone house to see the fields and talk about the light. ")
ROWS = {
    "empty": [],
    "nulls": [(None, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0)],
    "repeats": [(1, TEXT, "en", "a", len(TEXT))] * 40 + [(2, TEXT.upper() + "mail me: ann@example.org", "en", None, 9), (3, TEXT * 400, "en", "b", 1)],
}


@pytest.mark.parametrize("which", list(ROWS))
def test_pipeline(spark, tmp_path, which):
    import corpus_pipeline
    spark.createDataFrame(ROWS[which], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if which != "repeats":
        assert rows == []
        return
    ids = {r["doc_id"] for r in rows}
    assert ids and ids <= {1, 2, 3}
    for r in rows:
        assert 1 <= r["length"] <= 1024 and r["offset"] + r["length"] <= 1024
    for sequence in {r["sequence_id"] for r in rows}:
        at = 0
        for offset, length in sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == sequence):
            assert offset == at
            at += length


@pytest.mark.parametrize("which", ["empty", "nulls"])
def test_each_stage(spark, which):
    import corpus_pipeline
    docs = spark.createDataFrame(ROWS[which], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
