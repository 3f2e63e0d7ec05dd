"""Queries of the vector index and of tables in key partitions: upserts, deletes by filter, cascades."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import retrieve as ret
from quillspark.operators.vector_index import VectorIndex
from quillspark.registry import query
from quillspark.sources import keyed, sinks
from quillspark.sources import tables as T
from quillspark.sources.tables import table

#: Vectors' labels are their books.  One book is deleted, one is changed (its vectors turned round) and put in again.
DELETED, CHANGED, CELLS, PROBES = 3, 5, 16, 12
_V = f"""v AS (SELECT vec_id AS id, label AS book, CASE WHEN label = {CHANGED} THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings WHERE label IS DISTINCT FROM {DELETED}),
 q AS (SELECT vec_id AS query_id, label AS book, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0)"""
_HITS = "round(list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)), 6)"


def _index(spark, d) -> VectorIndex:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("book"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    index = VectorIndex(spark, f"{sinks.shared_folder(spark)}/vectors-{uuid.uuid4().hex}", "int", shelves=2, buckets=4)
    index.fit(e, CELLS)
    index.upsert(e)
    index.delete(F.col("book") == DELETED)
    index.upsert(e.where(F.col("book") == CHANGED).withColumn("vector", F.transform("vector", lambda x: -x)))
    return index


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("book"), F.col("embedding").alias("vector"))


@query("vector_index_search", f"WITH {_V} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, {_HITS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_HITS} DESC, id) AS rank FROM v, q) WHERE rank <= 10")
def vector_index_search(spark, d):
    """All vectors indexed, a book deleted, another changed; every twentieth vector asks, cells are visited by bound."""
    return _index(spark, d).search(_asked(spark, d).drop("book"), 10, PROBES, exact=True)


@query("vector_index_in_book", f"WITH {_V} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, {_HITS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_HITS} DESC, id) AS rank FROM v JOIN q ON v.book = q.book) WHERE rank <= 10")
def vector_index_in_book(spark, d):
    """The same within the book of each query; the deleted book finds nothing."""
    return _index(spark, d).search(_asked(spark, d), 10, PROBES, exact=True)


@query("vector_index_recall")
def vector_index_recall(spark, d):
    """Recall at 10 of the probed cells alone: of each query's ten nearest, how many are found."""
    index = _index(spark, d)
    q = _asked(spark, d).drop("book")
    true = ret.dense_topk(index.rows().select("id", "vector"), q, "id", "query_id", "vector", 10).select("query_id", "id")
    got = index.search(q, 10, PROBES).select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(got, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("nearest"), F.count("hit").alias("found"))



def _tables(spark, d):
    """Books, chapters, chunks, mentions and tasks as keyed tables."""
    root = f"{sinks.shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    rows = {
        "book": (docs.groupBy(F.col("source").alias("book")).agg(F.count(F.lit(1)).alias("chapters")), ["book"]),
        "chapter": (docs.select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("book"), "lang"), ["chapter_id"]),
        "chunk": (T.chunks(spark, d).where("book IS NOT NULL").select("chapter_id", "chunk_index", "content"), ["chapter_id", "chunk_index"]),
        "mention": (T.mentions(spark, d).where("book IS NOT NULL").select("chapter_id", "chunk_index", "pos", "name"), ["chapter_id", "chunk_index", "pos"]),
        "task": (docs.select((F.col("doc_id") + 1).alias("task_id"), F.col("source").alias("book")), ["task_id"]),
    }
    out = {}
    for name, (df, keys) in rows.items():
        out[name] = keyed.KeyedTable(spark, f"{root}/{name}", df.schema, keys, buckets=8)
        out[name].upsert(df)
    return out


FOREIGN = [keyed.Key("chapter", ["book"], "book"), keyed.Key("task", ["book"], "book"), keyed.Key("chunk", ["chapter_id"], "chapter"), keyed.Key("mention", ["chapter_id", "chunk_index"], "chunk")]
_CASCADE = "d AS (SELECT *, source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) WHERE source IS NOT NULL AND contains(source, '2')) AS gone FROM documents WHERE source IS NOT NULL)"


@query("delete_cascade", f"""WITH {T.SQL["chunks"]}, {T.SQL["mentions"]}, {_CASCADE}
SELECT 'book' AS name, count(DISTINCT source) FILTER (WHERE NOT gone) AS kept, count(DISTINCT source) FILTER (WHERE gone) AS deleted FROM d
UNION ALL SELECT 'chapter', count(*) FILTER (WHERE NOT gone), count(*) FILTER (WHERE gone) FROM d UNION ALL SELECT 'task', count(*) FILTER (WHERE NOT gone), count(*) FILTER (WHERE gone) FROM d
UNION ALL SELECT 'chunk', count(*) FILTER (WHERE NOT contains(book, '2')), count(*) FILTER (WHERE contains(book, '2')) FROM chunks WHERE book IS NOT NULL
UNION ALL SELECT 'mention', count(*) FILTER (WHERE NOT contains(book, '2')), count(*) FILTER (WHERE contains(book, '2')) FROM mentions WHERE book IS NOT NULL""")
def delete_cascade(spark, d):
    """Some books deleted with their chapters, chunks, mentions and tasks: rows kept and deleted of each table."""
    tables = _tables(spark, d)
    gone = keyed.cascade(tables, FOREIGN, "book", F.contains("book", F.lit("2")))
    parts = [t.read().agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("kept")).withColumn("deleted", F.lit(gone[name]).cast("long")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
