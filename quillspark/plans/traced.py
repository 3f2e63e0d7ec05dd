"""Queries of timelines of many targets, and of candidates in texts without blanks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import extract, segment
from quillspark.operators.timelines import pair_of, timelines
from quillspark.registry import query
from quillspark.sources import sinks
from quillspark.sources import tables as T
from quillspark.sources.tables import NAME, table, with_views

_CHUNK_ID = "chapter_id * 10000 + chunk_index"
#: Targets: the first two names of a benchmark item, in each book that has the first (items of odd id look at chapters up
#: to half of the greatest), and those of each chapter whose id is divisible by 20 (by 40: up to that chapter).  Relations: names that follow each other in a chunk.
_TARGETS = f"""m AS (SELECT * FROM mentions WHERE book IS NOT NULL),
 named AS (SELECT item_id, n[1] AS name, CASE WHEN len(n) > 1 THEN n[2] END AS other FROM (SELECT item_id, list_distinct(list_filter(regexp_extract_all(text, '{NAME}'), lambda x: length(x) <= 12)) AS s, regexp_extract_all(text, '{NAME}') AS o FROM benchmark), LATERAL (SELECT list_slice(list_filter(o, lambda x, i: length(x) <= 12 AND list_position(o, x) = i), 1, 2) AS n) WHERE len(n) > 0),
 opened AS (SELECT chapter_id, book, list_slice(list_filter(o, lambda x, i: length(x) <= 12 AND list_position(o, x) = i), 1, 2) AS n FROM (SELECT chapter_id, book, list(name ORDER BY chunk_index, pos) AS o FROM m WHERE chapter_id % 20 = 0 GROUP BY 1, 2)),
 targets AS (SELECT 'chapter ' || chapter_id AS target_id, book, n[1] AS name, CASE WHEN len(n) > 1 THEN n[2] END AS other, NULL::BIGINT AS first, CASE WHEN chapter_id % 40 = 0 THEN chapter_id END AS last FROM opened WHERE len(n) > 0 UNION ALL
 SELECT item_id || ' ' || book AS target_id, book, named.name, other, CASE WHEN item_id % 2 = 1 THEN 0 END AS first, CASE WHEN item_id % 2 = 1 THEN (SELECT max(doc_id) // 2 FROM documents) END AS last FROM named JOIN (SELECT DISTINCT book, name FROM m) b ON b.name = named.name),
 steps AS (SELECT book, chapter_id, chunk_index, pos, name AS source, lead(name) OVER (PARTITION BY chapter_id, chunk_index ORDER BY pos) AS target FROM m),
 rel AS (SELECT book, min({_CHUNK_ID}) AS id, source, target, 'NEAR' AS type, min(chapter_id) AS first_chapter, max(chapter_id) AS last_chapter, count(*) AS strength, count(*) / (count(*) + 1.0::DOUBLE) AS confidence FROM steps WHERE target IS NOT NULL GROUP BY book, source, target),
 facts AS (SELECT source AS book, doc_id AS chapter_id, doc_id AS id, split_part(text, chr(10), 1) AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"""
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _cut(flat: str, a: str, b: str) -> str:
    start = f"greatest(least(instr({flat}, {a}), instr({flat}, {b})) - 80, 1)"
    return f"substring({flat}, {start}, greatest(instr({flat}, {a}) + length({a}), instr({flat}, {b}) + length({b})) + 140 - {start})"


_IN = "(t.first IS NULL OR {0} >= t.first) AND (t.last IS NULL OR {0} <= t.last)"
_SQL = with_views("chunks", "mentions") + f""", {_TARGETS},
 r0 AS (SELECT t.*, r.id, r.source, r.target, r.first_chapter, r.confidence, row_number() OVER (PARTITION BY target_id ORDER BY first_chapter, last_chapter, strength DESC, confidence DESC, r.id) AS n FROM targets t JOIN rel r ON r.book = t.book AND ((contains(source, t.name) AND contains(target, t.other)) OR (contains(source, t.other) AND contains(target, t.name)))),
 r1 AS (SELECT target_id, 'relation_state' AS kind, 'relation' AS source_type, id AS source_id, first_chapter AS chapter_id, source || ' -NEAR- ' || target AS excerpt, 'DIRECT' AS level, confidence AS score, 1 AS k, n FROM r0 t WHERE n <= 10 AND {_IN.format("first_chapter")}),
 hold AS (SELECT t.*, c.chapter_id, {_CHUNK_ID} AS id, {_FLAT.format("content")} AS flat, contains(content, t.other) AS two FROM targets t JOIN chunks c ON c.book = t.book AND contains(content, t.name) WHERE {_IN.format("c.chapter_id")}),
 c1 AS (SELECT target_id, 'relation_context' AS kind, 'chunk' AS source_type, id AS source_id, chapter_id, {_cut("flat", "name", "other")} AS excerpt, 'DIRECT' AS level, 0.8::DOUBLE AS score, 2 AS k, n FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY chapter_id, id) AS n FROM hold WHERE two) WHERE n <= 10),
 m1 AS (SELECT target_id, 'target_mention' AS kind, 'chunk' AS source_type, id AS source_id, chapter_id, {_cut("flat", "name", "name")} AS excerpt, 'DIRECT' AS level, 0.85::DOUBLE AS score, 3 AS k, n FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY chapter_id, id) AS n FROM hold) WHERE n <= 20),
 f1 AS (SELECT target_id, 'chapter_fact' AS kind, 'chapter_fact' AS source_type, id AS source_id, chapter_id, {_cut("flat", "name", "name")} AS excerpt, 'NEAR' AS level, 0.65::DOUBLE AS score, 4 AS k, n FROM (SELECT t.*, f.chapter_id, f.id, {_FLAT.format("text")} AS flat, row_number() OVER (PARTITION BY target_id ORDER BY f.chapter_id, f.id) AS n FROM targets t JOIN facts f ON f.book = t.book AND contains(text, t.name) WHERE {_IN.format("f.chapter_id")}) WHERE n <= 10),
 e AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY k, n) - 1 AS INT) AS evidence_ref FROM (SELECT * FROM r1 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM f1)),
 o AS (SELECT * EXCLUDE (k, n), CAST(row_number() OVER (PARTITION BY target_id ORDER BY chapter_id, excerpt, evidence_ref) AS INT) AS rank FROM e) SELECT * FROM o WHERE rank <= 20"""


def _targets(spark, d):
    named = table(spark, d, "benchmark").select("item_id", pair_of(F.concat_ws(",", F.regexp_extract_all("text", F.lit(f"({NAME})"), 1)), F.lit("")).alias("n")).where("size(n) > 0")
    named = named.select("item_id", F.get("n", F.lit(0)).alias("name"), F.get("n", F.lit(1)).alias("other"))
    half = table(spark, d, "documents").agg(F.expr("max(doc_id) div 2").alias("half"))
    in_books = T.mentions(spark, d).where("book IS NOT NULL").select("book", "name").distinct()
    odd = F.col("item_id") % 2 == 1
    m = T.mentions(spark, d).where("book IS NOT NULL AND chapter_id % 20 = 0")
    own = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "pos", "name"))), lambda x: x["name"])
    opened = m.groupBy("chapter_id", "book").agg(own.alias("n")).select("chapter_id", "book", pair_of(F.concat_ws(",", "n"), F.lit("")).alias("n")).where("size(n) > 0")
    opened = opened.select(F.concat_ws(" ", F.lit("chapter"), "chapter_id").alias("target_id"), "book", F.get("n", F.lit(0)).alias("name"), F.get("n", F.lit(1)).alias("other"), F.lit(None).cast("long").alias("first"), F.when(F.col("chapter_id") % 40 == 0, F.col("chapter_id")).alias("last"))
    return opened.unionByName(named.join(in_books, "name").crossJoin(F.broadcast(half)).select(F.concat_ws(" ", "item_id", "book").alias("target_id"), "book", "name", "other", F.when(odd, F.lit(0)).cast("long").alias("first"), F.when(odd, F.col("half")).alias("last")))


@query("target_timelines", _SQL)
def target_timelines(spark, d):
    """Timelines of the names of all benchmark items in all books."""
    c = T.chunks(spark, d).where("book IS NOT NULL").withColumn("id", F.expr(_CHUNK_ID))
    m = T.mentions(spark, d).where("book IS NOT NULL")
    step = m.withColumn("target", F.lead("name").over(Window.partitionBy("chapter_id", "chunk_index").orderBy("pos"))).where("target IS NOT NULL")
    n = F.count(F.lit(1))
    r = step.groupBy("book", F.col("name").alias("source"), "target").agg(F.min(F.expr(_CHUNK_ID)).alias("id"), F.min("chapter_id").alias("first_chapter"), F.max("chapter_id").alias("last_chapter"), n.alias("strength"), (n / (n + 1)).alias("confidence")).withColumn("type", F.lit("NEAR"))
    f = table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter_id"), F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("text"))
    return timelines(_targets(spark, d), c, f, r)


@query("segmented_candidates")
def segmented_candidates(spark, d):
    """Candidates of all documents read without their blanks: words by best paths, names by ending."""
    docs = table(spark, d, "documents")
    sinks.shared_folder(spark)
    words = segment.lexicon(docs, "text").checkpoint()
    bare = docs.select("doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    found = segment.segment(bare, ["doc_id"], "text", words, longest=12)
    return extract.candidates(bare, ["doc_id"], "text", "", ("tion", "ment"), (), "a-z", words=found)
