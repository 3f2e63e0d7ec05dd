"""Tables in key partitions and the vector index: upserts, deletes by filter, cascades, changes that were cut off."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieve
from quillspark.operators.vector_index import VectorIndex
from quillspark.sources import keyed, sinks


@pytest.fixture
def table(spark, tmp_path):
    return lambda buckets=8: keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k int, v string, n int", ["k"], buckets)


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def test_upsert_and_delete(spark, table):
    t = table()
    df = lambda *r: spark.createDataFrame(r, "k int, v string, n int")
    assert rows(t) == [] and t.upsert(df(*[(i, "a", 1) for i in range(40)], (None, "a", 1)))
    t.upsert(df((3, "b", 2), (50, "b", 2)))
    t.upsert(df((3, "old", 0), (4, "new", 2)), order=["n"])
    assert sorted(map(tuple, t.read().where("k IN (3, 4, 50)").collect())) == [(3, "b", 2), (4, "new", 2), (50, "b", 2)] and t.read().count() == 42


def test_null_keys_are_keys(spark, table):
    t = table()
    t.upsert(spark.createDataFrame([(None, "a", 1), (1, "a", 1)], t.schema))
    assert t.read().where("k IS NULL").count() == 1


def test_only_touched_partitions_are_written(spark, table, tmp_path):
    import os

    t = table(64)
    t.upsert(spark.range(5000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("n")))
    stamp = lambda: {d: os.stat(f"{tmp_path}/t/data/{d}").st_ino for d in os.listdir(f"{tmp_path}/t/data")}
    before = stamp()
    t.upsert(spark.createDataFrame([(7, "b", 2)], t.schema))
    after = stamp()
    assert len(before) == 64 and sum(before[d] != after[d] for d in before) == 1 and t.read().count() == 5000


def test_a_partition_that_loses_all_goes(spark, table):
    t = table()
    t.upsert(spark.createDataFrame([(i, "de" if i % 2 else "en", i) for i in range(6)], t.schema))
    t.delete_where(F.col("v") == "de")
    assert [r[0] for r in rows(t)] == [0, 2, 4]
    t.delete_where(F.lit(True))
    assert rows(t) == []


def test_numbered_changes_are_applied_once(spark, table):
    t = table()
    one = spark.createDataFrame([(1, "a", 1)], t.schema)
    assert t.upsert(one, number=0) and not t.upsert(one.withColumn("v", F.lit("b")), number=0)
    assert table().upsert(one.limit(0), number=1) and not table().upsert(one, number=1) and rows(t) == [(1, "a", 1)]


def test_a_change_cut_off_is_whole_or_absent(spark, table, monkeypatch):
    t = table()
    t.upsert(spark.createDataFrame([(i, "a", 1) for i in range(30)], t.schema))
    moved, rename = [], keyed.Files.rename

    def dies(self, a, b):
        if "stage/data" in a:
            moved.append(a)
            if len(moved) == 3:
                raise KeyboardInterrupt
        rename(self, a, b)

    monkeypatch.setattr(keyed.Files, "rename", dies)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(spark.createDataFrame([(i, "b", 2) for i in range(30)], t.schema), number=5)
    monkeypatch.setattr(keyed.Files, "rename", rename)
    t = table()  # opened again: ended
    assert {r[1] for r in rows(t)} == {"b"} and len(rows(t)) == 30 and not t.upsert(t.read(), number=5)

    def never(self, p, text):
        raise KeyboardInterrupt

    write = keyed.Files.write
    monkeypatch.setattr(keyed.Files, "write", never)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(spark.createDataFrame([(1, "c", 3)], t.schema))
    monkeypatch.setattr(keyed.Files, "write", write)
    assert {r[1] for r in rows(table())} == {"b"}  # without its note it was never there


def test_cascade(spark, tmp_path):
    make = lambda name, ddl, keys, data: keyed.KeyedTable(spark, f"file://{tmp_path}/{name}", ddl, keys, 4)
    data = {"book": ("b int", ["b"], [(1,), (2,)]), "chapter": ("c int, b int", ["c"], [(10, 1), (11, 1), (20, 2), (30, None)]), "fact": ("f int, c int", ["f"], [(1, 10), (2, 11), (3, 20), (4, None)]), "note": ("n int, c int, b int", ["n"], [(1, 10, 2), (2, 20, 1), (3, 20, 2)])}
    tables = {k: make(k, *v) for k, v in data.items()}
    for k, (ddl, _, r) in data.items():
        tables[k].upsert(spark.createDataFrame(r, ddl))
    keys = [keyed.Key("chapter", ["b"], "book"), keyed.Key("fact", ["c"], "chapter"), keyed.Key("note", ["c"], "chapter"), keyed.Key("note", ["b"], "book")]
    assert keyed.cascade(tables, keys, "book", F.col("b") == 1) == {"fact": 2, "note": 2, "chapter": 2, "book": 1}
    assert sorted(r.n for r in tables["note"].read().collect()) == [3] and sorted(r.f for r in tables["fact"].read().collect()) == [3, 4]
    assert keyed.cascade(tables, keys, "book", F.col("b") == 1) == {"fact": 0, "note": 0, "chapter": 0, "book": 0}
    with pytest.raises(ValueError):
        keyed.cascade(tables, [*keys, keyed.Key("book", ["b"], "note")], "book", F.lit(True))


def test_rewrite_drops_what_loses_all(spark, tmp_path):
    from quillspark.sources import sinks

    t = spark.createDataFrame([(1, "en", "a"), (2, "de", "b c/d=%"), (3, "de", "a")], "id int, lang string, book string")
    at = f"file://{tmp_path}/r"
    sinks.rewrite(t, at)
    for _ in range(2):
        sinks.rewrite(t.where("lang <> 'de'"), at, of=t)
        assert [(r.id, r.book) for r in spark.read.parquet(at).collect()] == [(1, "a")]


# --- vectors


def by_hand(rows, queries, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = []
    for q, v, book in queries:
        s = sorted((-round(float(unit(v) @ unit(x)), 6), i) for i, b, x in rows if book is None or b == book)[:k]
        out += [(q, i, n) for n, (_, i) in enumerate(s, 1)]
    return sorted(out)


def test_vector_index(spark, tmp_path):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(5)]
    data = [(i, i % 4, vec()) for i in range(300)] + [(300 + i, 1, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)]
    df = lambda r: spark.createDataFrame(r, "id long, book int, vector array<double>")
    at = f"file://{tmp_path}/i"
    index = VectorIndex(spark, at, shelves=2, buckets=2)
    index.fit(df(data), 6)
    assert index.upsert(df([*data, (900, 1, None), (901, 1, [0.0] * 5)])) == 340
    asked = [(1, vec(), None), (2, vec(), 1), (3, data[0][2], 0), (4, [1.0, 2.0, 3.0, 4.0, 5.0], None), (5, vec(), 99)]
    q = spark.createDataFrame(asked, "query_id long, vector array<double>, book int")
    found = lambda i, **kw: sorted((r.query_id, r.id, r["rank"]) for r in i.search(q, 7, 2, exact=True, **kw).collect())
    assert found(index) == by_hand(data, asked, 7)
    assert index.upsert(df(data)) == 0 and index.rows().count() == 340  # a second time nothing is written
    data = [r for r in data if r[1] != 3]
    assert index.delete(F.col("book") == 3) == 75
    data[0] = (data[0][0], 2, vec())  # another book and another cell
    assert index.upsert(df([*data[:5], (990, 0, data[7][2])])) == 2
    data.append((990, 0, data[7][2]))
    index = VectorIndex(spark, at, shelves=2, buckets=2)  # opened again
    assert found(index) == by_hand(data, asked, 7)
    index.compact()
    assert len(index._commits()) == 1 and found(index) == by_hand(data, asked, 7) and index.upsert(df(data)) == 0


def test_vector_index_cut_off(spark, tmp_path, monkeypatch):
    """A commit whose table of ids did not follow is caught up; one without its mark never was."""
    df = spark.createDataFrame([(i, 0, [float(i % 7), 1.0]) for i in range(50)], "id long, book int, vector array<double>")
    at = f"file://{tmp_path}/i"
    index = VectorIndex(spark, at, shelves=1, buckets=2)
    index.fit(df, 3)

    def dies(self, commit):
        raise KeyboardInterrupt

    note = VectorIndex._note
    monkeypatch.setattr(VectorIndex, "_note", dies)
    with pytest.raises(KeyboardInterrupt):
        index.upsert(df)
    monkeypatch.setattr(VectorIndex, "_note", note)
    index = VectorIndex(spark, at, shelves=1, buckets=2)
    assert index.upsert(df) == 0 and index.rows().count() == 50


def test_recall_of_probed_cells(spark):
    from quillspark import registry

    r = registry.queries()["vector_index_recall"](spark, "/root/testdata/sf0.001").agg(F.sum("found"), F.sum("nearest")).first()
    assert r[0] >= 0.9 * r[1] > 0


def test_dense_topk_without_vectors(spark):
    v = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "query_id")
    assert [tuple(r) for r in retrieve.dense_topk(v, q, "id", "query_id", "embedding", 3).collect()] == [(3, 3, 1.0, 1)]
    assert retrieve.dense_topk(v, q.limit(0), "id", "query_id", "embedding", 3).collect() == []


def test_a_tile_of_many_queries_takes_no_matrix_of_all_scores():
    import tracemalloc

    import pandas as pd

    from quillspark.operators.vector_index import best_pairs

    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, (9_000, 4)).astype(float), rng.integers(-2, 3, (3_000, 4)).astype(float)
    v[(v == 0).all(axis=1), 0] = q[(q == 0).all(axis=1), 0] = 1
    ids = rng.permutation(len(v))
    args = pd.Series(np.arange(len(q))), pd.Series(list(q)), None, pd.Series(ids), pd.Series(list(v)), None, 10
    tracemalloc.start()
    got = best_pairs(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores are 216 MB
    for i in (0, 63, 64, 2_999):
        s = np.round(v @ q[i] / np.linalg.norm(v, axis=1) / np.linalg.norm(q[i]), 6)
        want = np.lexsort((ids, -s))[:10]
        assert got[got.query_id == i][["id", "score"]].values.tolist() == [[ids[j], s[j]] for j in want]


def test_search_by_tiles_is_that_of_all_at_once(spark, monkeypatch):
    """Queries in shares and cells in pieces, some rows of a book alone: the same hits as in whole cells."""
    from quillspark.operators import vector_index as vi

    monkeypatch.setattr(vi, "PIECE", 7)
    monkeypatch.setattr(vi, "QUERIES", 5)
    e = spark.range(60).selectExpr("id", "cast(id % 3 as int) book", "array(sin(id), cos(id * 3), sin(id * 7)) vector")
    index = vi.VectorIndex(spark, f"{sinks.shared_folder(spark)}/tiles-{uuid.uuid4().hex}", "int", shelves=2, buckets=2)
    index.fit(e, 4)
    index.upsert(e)
    q = e.where("id % 4 = 0").selectExpr("id query_id", "vector", "if(id % 8 = 0, book, null) book")
    got = {(r.query_id, r["rank"]): r.id for r in index.search(q, 3, 2, exact=True).collect()}
    rows = {r.id: (r.book, r.vector) for r in e.collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)
    for r in q.collect():
        near = sorted((-cos(r.vector, v), i) for i, (b, v) in rows.items() if r.book is None or b == r.book)[:3]
        assert [got[r.query_id, n] for n in (1, 2, 3)] == [i for _, i in near]


def test_a_bucket_of_many_rows_is_written_by_several_tasks(spark, table):
    t = table(1)
    said = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in said.items():
        spark.conf.set(k, v)
    try:
        t.upsert(spark.range(20_000).selectExpr("cast(id as int) k", "sha2(string(id), 256) v", "1 n"))
    finally:
        for k in said:
            spark.conf.unset(k)
    assert len([f for f in t.files.names(f"{t.path}/data/kb=0") if f.endswith(".parquet")]) > 1
    assert t.read().count() == 20_000
