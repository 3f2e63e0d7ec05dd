"""Queries of rule extraction with hints on whole chunks, and of chapter facts with relations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import extract
from quillspark.operators import rule_facts as rf
from quillspark.registry import query
from quillspark.sources import tables as T
from quillspark.sources.tables import NAME, with_views

VERBS, KINDS, ACTIONS = ("the", " of ", " in "), {"IS": ("the",), "AT": (" in ",)}, ("with", "from")
_AT = ["chapter_id", "chunk_index"]

#: Hints of a book: its five commonest names, each with up to two other names of the same four first letters as aliases, and
#: the three names next in number as locations.
_HINTS = """freq AS (SELECT book, name, count(*) AS n FROM mentions WHERE book IS NOT NULL GROUP BY 1, 2), placed AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, name) AS k FROM freq),
 mains AS (SELECT book, name, k FROM placed WHERE k <= 5), places AS (SELECT book, name, k FROM placed WHERE k BETWEEN 6 AND 8),
 other AS (SELECT * FROM (SELECT m.book, m.name, m.k, p.name AS alias, row_number() OVER (PARTITION BY m.book, m.name ORDER BY p.n DESC, p.name) AS j FROM mains m JOIN placed p ON p.book = m.book AND p.k > 5 AND left(p.name, 4) = left(m.name, 4)) WHERE j <= 2),
 normal AS (SELECT book, alias AS key, arg_min(name, k) AS value FROM other GROUP BY 1, 2 UNION ALL SELECT book, name, name FROM mains)"""
_CANDS = f"""w AS (SELECT chapter_id, chunk_index, unnest(regexp_extract_all(content, '{NAME}')) AS term FROM chunks), w2 AS (SELECT chapter_id, chunk_index, term, count(*) AS n FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 w20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY n DESC, term) AS k FROM w2) WHERE k <= 20), s AS (SELECT chapter_id, chunk_index, unnest(regexp_extract_all(content, '[a-z]{{1,4}}(?:tion|ment)')) AS term FROM chunks),
 u AS (SELECT chapter_id, chunk_index, term, max(n) AS n FROM (SELECT chapter_id, chunk_index, term, n FROM w20 UNION ALL SELECT chapter_id, chunk_index, term, count(*) FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
 cand AS (SELECT chapter_id, chunk_index, term, k FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY n DESC, term) AS k FROM u) WHERE k <= 30)"""
_ENTITIES = """merged AS (SELECT chapter_id, chunk_index, term, 1 AS g, k AS o FROM cand UNION ALL SELECT chapter_id, chunk_index, name, 0, -k FROM chunks JOIN mains USING (book)
  UNION ALL SELECT chapter_id, chunk_index, alias, 2, k * 10 + j FROM chunks JOIN other USING (book) UNION ALL SELECT chapter_id, chunk_index, name, 3, k FROM chunks JOIN places USING (book)),
 once AS (SELECT chapter_id, chunk_index, term, coalesce(min((g, o)) FILTER (WHERE g = 1), min((g, o))) AS seat FROM merged GROUP BY 1, 2, 3),
 p20 AS (SELECT * FROM (SELECT chapter_id, chunk_index, term, row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY seat) AS k FROM once) WHERE k <= 20),
 e AS (SELECT p.chapter_id, p.chunk_index, term AS surface, coalesce(value, term) AS name, l.name IS NOT NULL AS place, content, p.k FROM p20 p JOIN chunks c ON c.chapter_id = p.chapter_id AND c.chunk_index = p.chunk_index LEFT JOIN normal n ON n.book = c.book AND n.key = term LEFT JOIN places l ON l.book = c.book AND l.name = term WHERE contains(content, term)),
 entities AS (SELECT chapter_id, chunk_index, CAST(row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY k) - 1 AS INT) AS ordinal, surface, name, CASE WHEN place OR regexp_matches(surface, '[xz]') THEN 'LOCATION' ELSE 'CHARACTER' END AS entity_type, CASE WHEN place OR regexp_matches(surface, '[xz]') THEN 'CANONICAL' ELSE 'UNCERTAIN' END AS role,
  (CASE WHEN place THEN 0.6 WHEN regexp_matches(surface, '[xz]') THEN 0.5 ELSE 0.3 END)::DOUBLE AS confidence, content, k FROM e)"""
_NAMES = """nm AS (SELECT chapter_id, chunk_index, name, content, row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY k) - 1 AS i FROM entities WHERE contains(content, name)), firsts AS (SELECT chapter_id, chunk_index, name, any_value(content) AS content, min(i) AS i FROM nm GROUP BY 1, 2, 3)"""
_RELATIONS = """p AS (SELECT a.chapter_id, a.chunk_index, a.i, b.i AS j, a.name AS source, b.name AS target, instr(a.content, a.name) AS x, instr(a.content, b.name) AS y, a.content FROM firsts a JOIN firsts b ON a.chapter_id = b.chapter_id AND a.chunk_index = b.chunk_index AND a.i < b.i AND a.i < 10),
 q AS (SELECT *, substring(content, least(x, y), abs(x - y)) AS between_ FROM p), v AS (SELECT *, CASE WHEN contains(between_, 'the') THEN 'the' WHEN contains(between_, ' of ') THEN ' of ' WHEN contains(between_, ' in ') THEN ' in ' END AS verb FROM q),
 c AS (SELECT *, (CASE WHEN verb IS NULL THEN 0.2 ELSE 0.4 END)::DOUBLE AS confidence, count(*) OVER (PARTITION BY chapter_id, chunk_index) AS n FROM v), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY CASE WHEN n > 20 THEN -confidence ELSE 0 END, i, j) - 1 AS INT) AS ordinal FROM c),
 relations AS (SELECT chapter_id, chunk_index, ordinal, source, target, CASE verb WHEN 'the' THEN 'IS' WHEN ' in ' THEN 'AT' ELSE 'RELATED_TO' END AS relation_type, confidence, left(between_, 80) AS evidence FROM r WHERE ordinal < 20)"""
_EVENTS = """cx AS (SELECT *, substring(content, greatest(instr(content, name) - 60, 1), instr(content, name) + length(name) + 60 - greatest(instr(content, name) - 60, 1)) AS context FROM nm WHERE i < 8),
 act AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id, chunk_index ORDER BY i) - 1 AS INT) AS ordinal FROM cx WHERE contains(context, 'with') OR contains(context, 'from')),
 events_ AS (SELECT a.chapter_id, a.chunk_index, a.ordinal, 'ACTION' AS event_type, a.name, list_slice(list_concat([a.name], coalesce(list(o.name ORDER BY o.i) FILTER (WHERE o.name IS NOT NULL), [])), 1, 5) AS participants, left(context, 100) || CASE WHEN length(context) > 100 THEN '…' ELSE '' END AS description, left(context, 120) AS evidence, 0.35::DOUBLE AS confidence
  FROM act a LEFT JOIN firsts o ON o.chapter_id = a.chapter_id AND o.chunk_index = a.chunk_index AND o.name <> a.name AND contains(a.context, o.name) GROUP BY a.chapter_id, a.chunk_index, a.ordinal, a.name, a.context)"""
_SQL = with_views("chunks", "mentions") + f", {_HINTS}, {_CANDS}, {_ENTITIES}"


def book_hints(spark, d):
    n = T.mentions(spark, d).where("book IS NOT NULL").groupBy("book", "name").agg(F.count(F.lit(1)).alias("n"))
    placed = n.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "name")))
    mains = placed.where("place <= 5").select("book", "place", "name", F.left("name", F.lit(4)).alias("stem"))
    near = placed.where("place > 5").select("book", "n", F.col("name").alias("alias"), F.left("name", F.lit(4)).alias("stem")).join(mains, ["book", "stem"])
    near = near.withColumn("j", F.row_number().over(Window.partitionBy("book", "name").orderBy(F.desc("n"), "alias"))).where("j <= 2")
    near = near.groupBy("book", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return rf.hints(mains.drop("stem").join(near, ["book", "name"], "left"), placed.where("place BETWEEN 6 AND 8"), "book")


def extraction(spark, d):
    c = T.chunks(spark, d)
    cands = extract.candidates(c, _AT, "content", NAME, ("tion", "ment"), (), "a-z")
    return rf.extracted(c, _AT, "book", "content", cands, book_hints(spark, d), VERBS, KINDS, ACTIONS, "place", place_marks="xz")


def _rows(spark, d, part):
    return rf.exploded(extraction(spark, d), _AT, part, "ordinal", "x").select(*_AT, "ordinal", "x.*")


@query("extracted_entities", _SQL + " SELECT chapter_id, chunk_index, ordinal, surface, name, entity_type, role, confidence FROM entities")
def extracted_entities(spark, d):
    """Entities of whole chunks: candidates with hints, the first twenty, aliases under their names."""
    return _rows(spark, d, "entities")


@query("extracted_relations", _SQL + f", {_NAMES}, {_RELATIONS} SELECT * FROM relations")
def extracted_relations(spark, d):
    """The twenty surest relations of a chunk."""
    return _rows(spark, d, "relations")


@query("extracted_events", _SQL + f", {_NAMES}, {_EVENTS} SELECT * FROM events_")
def extracted_events(spark, d):
    """Events around the first eight names of a chunk, with who else is there."""
    return _rows(spark, d, "events")


@query("chapter_fact_rows", _SQL + f""", {_NAMES}, {_RELATIONS}, {_EVENTS}, f1 AS (SELECT chapter_id, name, surface, min((chunk_index, ordinal, confidence)) AS o FROM entities GROUP BY 1, 2, 3), f2 AS (SELECT chapter_id, name, min(o) AS o, list(surface ORDER BY o) AS surfaces FROM f1 GROUP BY 1, 2),
 f3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY o, name) - 1 AS INT) AS ordinal FROM f2)
 SELECT chapter_id, 'character' AS part, o[1] AS chunk_index, ordinal, name, NULL::VARCHAR AS other, NULL::VARCHAR AS kind, surfaces, NULL::VARCHAR AS text, o[3] AS confidence, 'ev_' || o[1] || '_' || ordinal AS evidence_id FROM f3
 UNION ALL SELECT chapter_id, 'relation', chunk_index, ordinal, source, target, relation_type, NULL, evidence, confidence, NULL FROM relations UNION ALL SELECT chapter_id, 'event', chunk_index, ordinal, name, NULL, event_type, participants, description, confidence, NULL FROM events_""")
def chapter_fact_rows(spark, d):
    """Chapter facts whole: characters with surfaces and evidence, relations, events."""
    return rf.chapter_fact_rows(extraction(spark, d), ["chapter_id"], "chunk_index")
