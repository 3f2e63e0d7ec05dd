"""Queries do the whole job: they are compared with SQL or brute force without any cut."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark import registry
from quillspark.sources.tables import with_views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(spark, name, *cols, d=SF):
    return sorted(map(tuple, registry.queries()[name](spark, d).select(*cols).collect()))


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_alias_pairs_of_all_names(spark, duck):
    sql = with_views("chunks", "mentions") + ", n AS (SELECT DISTINCT chapter_id, name FROM mentions) SELECT a.chapter_id, a.name, b.name FROM n a JOIN n b ON a.chapter_id = b.chapter_id AND a.name < b.name"
    assert rows(spark, "alias_pairs", "chapter_id", "name_a", "name_b") == sorted(duck.sql(sql).fetchall())


def test_entity_clusters_of_all_names(spark, tmp_path):
    words = ["Alice", "Alise", "Alices", "Lices", "Aalice", "Bobby", "Bob", "Robby", "Lobbying", "Ab"]
    text = "\n".join(["nothing here", "nor here"] + [w + " said" for w in words])
    pd.DataFrame({"doc_id": [1, 2], "text": [text, "x\ny\nAlice and Bobby"], "source": ["s", "t"], "lang": ["en", "en"], "n_chars": [1, 1]}).to_parquet(tmp_path / "documents.parquet")
    got = rows(spark, "entity_clusters", "book", "name", "canonical", d=str(tmp_path))
    want = []
    for book, names in (("s", {w for w in words if len(w) >= 5}), ("t", {"Alice", "Bobby"})):
        taken = set()
        for n in sorted(names):
            if n not in taken:
                group = [n, *(x for x in sorted(names - taken - {n}) if edits(n, x) <= 1)]
                taken.update(group)
                want += [(book, x, n) for x in group]
    assert got == sorted(want)


def nearest(ids):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    v = np.stack(e["embedding"].to_numpy()).astype(float)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    every, at = e["vec_id"].tolist(), {x: i for i, x in enumerate(e["vec_id"])}
    return {q: sorted((-round(float(s), 6), i) for i, s in zip(every, v @ v[at[i]], strict=True))[:10] for q, i in ids.items()}


def test_dense_topk_of_every_twentieth_vector(spark):
    ids = [x for x in pd.read_parquet(f"{SF}/embeddings.parquet")["vec_id"].tolist() if x % 20 == 0]
    want = sorted((q, i, -s) for q, best in nearest({x: x for x in ids}).items() for s, i in best)
    got = rows(spark, "dense_topk", "query_id", "id", "score")
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_every_question_has_dense_hits(spark):
    from quillspark.plans import search

    ids = pd.read_parquet(f"{SF}/benchmark.parquet")["item_id"].tolist()
    want = sorted((q, i) for q, best in nearest({x: x % 500 for x in ids}).items() for _, i in best)
    assert sorted(map(tuple, search._hits(spark, SF).where("list = 'dense'").select("query_id", "id").collect())) == want
    # all that is fused: of five lists' hits the ten best need not hold a dense one
    fused = search.rel.rank_fusion(search._hits(spark, SF), search._WEIGHTS, 20, 1000)
    assert {r.query_id for r in fused.where("source = 'chapter_fact'").select("query_id").distinct().collect()} == set(ids)


def cut_up(text, most):
    """Brute force for texts of one letter: halves until they fit."""
    return [text] if len(text) <= most else cut_up(text[: len(text) // 2], most) + cut_up(text[len(text) // 2 :], most)


def test_index_items_of_long_texts(spark, tmp_path):
    texts = {1: "short", 2: "x" * 50_000, 3: "y" * 50_001, 4: "z" * 210_003, 5: "Some words, and more. " * 6_000}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}).to_parquet(tmp_path / "documents.parquet")
    got = rows(spark, "index_items", "doc_id", "split_index", "point_id", "preview", "size", d=str(tmp_path))
    want = [(k, i, k * 10_000 + i, p[:200], len(p)) for k, t in texts.items() if k != 5 for i, p in enumerate(cut_up(t, 50_000))]
    assert [r for r in got if r[0] != 5] == want
    at, last = 0, [r for r in got if r[0] == 5]
    for i, (_, split, point, preview, size) in enumerate(last):
        assert (split, point) == (i, 50_000 + i) and size <= 50_000 and preview == texts[5][at : at + 200]
        at += size
    assert at == len(texts[5]) and len(last) > 2


def test_lexical_long_words_of_whole_questions(spark, duck):
    sql = with_views("chunks") + """, k AS (SELECT DISTINCT item_id AS query_id, lower(w) AS keyword FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM benchmark)),
     h AS (SELECT *, row_number() OVER (PARTITION BY query_id, keyword ORDER BY chapter_id, chunk_index) AS n FROM k JOIN chunks ON contains(lower(content), keyword))
    SELECT query_id, chapter_id, chunk_index, min(keyword), count(*) FROM h WHERE n <= 5 GROUP BY 1, 2, 3"""
    assert rows(spark, "lexical_long_words", "query_id", "chapter_id", "chunk_index", "keyword", "keywords") == sorted(duck.sql(sql).fetchall())


def test_lexical_finds_parts_of_words(spark):
    from quillspark.operators import retrieve

    c = spark.createDataFrame([(1, "The Undertaking's end"), (2, "take UNDERTAKINGS undertaking"), (3, "under taking"), (4, "of")], "id long, text string")
    k = spark.createDataFrame([(7, "Taking"), (7, "undertaking"), (8, "of"), (8, "taken")], "q long, w string")
    got = retrieve.lexical(c, k, "q", "w", ["id"], "text", 5).select("q", "id", "keyword", "keywords").collect()
    assert sorted(map(tuple, got)) == [(7, 1, "taking", 2), (7, 2, "taking", 2), (7, 3, "taking", 1), (8, 4, "of", 1)]


def test_keywords_ngram_of_whole_texts(spark):
    def grams(text):
        got = {r[i : i + n] for r in re.findall("[a-z]+", text) for n in (2, 3, 4) for i in range(len(r) - n + 1)} - {"th", "he"}
        return sorted(got, key=lambda g: (len(g), g))[:20]

    b = pd.read_parquet(f"{SF}/benchmark.parquet")
    assert rows(spark, "keywords_ngram", "item_id", "keywords") == sorted((i, grams(t)) for i, t in zip(b["item_id"], b["text"], strict=True) if grams(t))
