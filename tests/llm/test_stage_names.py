"""Stages of the pipeline with columns named as those that the stages add, repeated and missing ids, one long text."""

import pytest

import corpus_pipeline

NAMES = ("_row", "_MANY", "_row_", "kept", "component_id", "count", "_id", "key", "size")


@pytest.mark.parametrize("stage", ["exact dedup", "n-gram Jaccard join"])
def test_clashing_names(spark, stage):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " "), (None, text), (None, None), (3, None), (3, "other words " * 9), (4, " ".join(f"w{i % 977}" for i in range(60_000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *NAMES) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, None)
    assert out.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:7]) for r in out.collect())
    assert [g for g in got if g[1] == "word0 w"] == [(2, "word0 w")] and (3, "other w") in got and (4, "w0 w1 w") in got
    assert all(r[n] == n for r in out.collect() for n in NAMES)
