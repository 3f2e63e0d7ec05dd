"""The registered queries against DuckDB, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm.common import Cuts
from quillspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def canon(x):
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = duck.sql(ORACLE[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(tuple(map(canon, r)) for r in zip(*(t[c].to_pylist() for c in cols), strict=True))
    assert rows(got) == rows(want)


def test_pipeline(spark):
    cuts = Cuts(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, n = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cuts.cut(stage(spark, docs, SF))
        assert docs.columns == cols
        n.append(docs.count())
    assert 0.97 * n[0] < n[1] <= n[0] and n[3] <= n[2] < n[1] and n[2] < n[4]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == n[4] and all(r.round_trip for r in out)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_tell_rows_apart(spark):
    """Repeated and missing ids, nulls, blanks and a clashing column, by brute force."""
    story = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    close = story(1) + " one more"
    rows = [(1, story(1), "a"), (1, story(1), "a"), (2, story(1) + " ", "a"), (3, close, None), (None, story(4), "b"), (None, story(4), "b"), (None, story(5), "b"), (5, story(5), None), (6, None, "a"), (6, "", "a"), (7, story(7), "a"), (7, story(8), "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    squeezed = lambda t: "".join((t or "").split())
    got = stage("exact dedup")(spark, docs, SF)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(squeezed(r.text) for r in kept) == sorted({squeezed(t) for _, t, _ in rows})
    got = Cuts(spark).cut(got)
    got = stage("n-gram Jaccard join")(spark, got, SF)
    assert got.columns == docs.columns
    texts = sorted(squeezed(r.text) for r in got.collect())
    assert texts == sorted({squeezed(t) for _, t, _ in rows} - {squeezed(close)})  # 1 and 3 link, the smaller id stays
    mixed = stage("mixing sources to target weights")(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() >= 1
    sizes = {}
    for r in mixed.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    before = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in (None, "a", "b")}
    assert all(sizes.get(s, 0) <= 2 * before[s] for s in before)


def test_stages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs = empty
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == empty.columns and docs.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).isEmpty()


def test_language_id_does_not_depend_on_the_dealing(spark):
    from quillspark.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(d).collect())
    assert scores(docs) == scores(docs.repartition(7))
