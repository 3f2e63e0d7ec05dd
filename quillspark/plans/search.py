"""Queries of retrieval, fusion, gates, contexts, timelines and analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.operators import relational as rel
from quillspark.operators import retrieve as ret
from quillspark.registry import query
from quillspark.sources import tables as T
from quillspark.sources.sinks import checkpointed
from quillspark.sources.tables import table, with_views

_COS = "round(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6)"
_DENSE = f"dense AS (SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, i.vec_id) AS rank FROM embeddings i, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"


#: The same for the questions' vectors.
_QVEC = "qvec AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT max(vec_id) + 1 FROM embeddings))"
_QDENSE = _QVEC + ", " + _DENSE.replace("q.vec_id AS query_id", "q.query_id").replace("PARTITION BY q.vec_id", "PARTITION BY q.query_id").replace("embeddings q WHERE q.vec_id % 20 = 0", "qvec q")


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM dense")
def dense_topk(spark, d):
    return _dense(spark, d, table(spark, d, "embeddings").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


def _dense(spark, d, q):
    return ret.dense_topk(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), q, "id", "query_id", "embedding", 10)


def _question_vectors(spark, d):
    """A vector for every question: that of equal number, counted round where there are fewer vectors than questions."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = questions(spark, d).select("query_id").crossJoin(F.broadcast(e.agg((F.max("vec_id") + 1).alias("n"))))
    return q.select("query_id", F.pmod("query_id", "n").alias("vec_id")).join(e, "vec_id").select("query_id", "embedding")


#: Questions: benchmark items; keywords: n-grams of their words and other names of who is named.  A chunk's id is that of its chapter with nine digits more.
_CHUNK = "chapter_id * 1000000000 + chunk_index"
_QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
_KEYWORDS = """runs AS (SELECT query_id, unnest(regexp_extract_all(lower(question), '\\p{L}+')) AS r FROM questions), grams AS (SELECT DISTINCT query_id, substring(r, CAST(i AS INT), CAST(n AS INT)) AS g FROM runs, (SELECT unnest([2, 3, 4]) AS n) x, LATERAL (SELECT unnest(range(1, length(r) - n + 2)) AS i)),
 keywords AS (SELECT query_id, g AS keyword FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(g), g) AS k FROM grams) WHERE k <= 20 UNION SELECT query_id, unnest(aliases) FROM found JOIN profiles USING (name))"""
_LEX = """share AS (SELECT query_id, greatest(16 // count(*), 2) AS most FROM keywords GROUP BY 1), hit AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY chapter_id, chunk_index) AS n FROM (SELECT DISTINCT keyword FROM keywords) JOIN chunks ON contains(lower(content), keyword)),
 lexical AS (SELECT query_id, chapter_id, chunk_index, min(keyword) AS keyword, count(*) AS keywords, 0.8::DOUBLE AS score FROM keywords JOIN share USING (query_id) JOIN hit USING (keyword) WHERE n <= most GROUP BY 1, 2, 3)"""


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def keywords(spark, d, named):
    """The first twenty n-grams of a question's words, and the aliases of the names that it contains, written once."""
    grams = R.ngram_keywords("lower_", r"\p{L}", stop=())
    q = questions(spark, d).select("query_id", F.lower("question").alias("lower_"))
    other = named.select("query_id", F.explode("aliases").alias("keyword"))
    return checkpointed(q.select("query_id", F.explode(grams).alias("keyword")).unionByName(other.where("char_length(keyword) >= 2")))


def lexical(spark, d, named):
    return ret.lexical_grams(T.chunks(spark, d), keywords(spark, d, named), "query_id", "keyword", ["chapter_id", "chunk_index"], "content")


# --- entities

_PROFILES = "profiles AS (SELECT name, count(*) AS mention_count, list(DISTINCT lower(name)) AS aliases FROM mentions GROUP BY 1)"


def profiles(spark, d):
    return T.mentions(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("mention_count"), F.collect_set(F.lower("name")).alias("aliases"))


_NAMES_IN = "found AS (SELECT query_id, name FROM questions JOIN profiles ON contains(question, name))"


def _found(spark, d):
    return ret.names_in(questions(spark, d), profiles(spark, d), "query_id", "question", "name", 4)


def _named(spark, d):
    """Names that questions contain, with their profiles: written once, so what is joined with it sees how small it is."""
    return checkpointed(_found(spark, d).join(profiles(spark, d), "name"))


@query("mention_in_question", with_views("chunks", "mentions") + f", {_QUESTIONS}, {_PROFILES}, {_NAMES_IN} SELECT query_id, name FROM found")
def mention_in_question(spark, d):
    return _found(spark, d)


@query("alias_expand", with_views("chunks", "mentions") + f", {_QUESTIONS}, {_PROFILES}, {_NAMES_IN} SELECT DISTINCT query_id, unnest(aliases) AS alias FROM found JOIN profiles USING (name)")
def alias_expand(spark, d):
    return ret.expand_aliases(_found(spark, d), profiles(spark, d), "query_id", "name", "aliases")


@query("lexical_search", with_views("chunks", "mentions") + f", {_QUESTIONS}, {_PROFILES}, {_NAMES_IN}, {_KEYWORDS}, {_LEX} SELECT query_id, chapter_id, chunk_index, keyword, keywords, score FROM lexical")
def lexical_search(spark, d):
    return lexical(spark, d, _named(spark, d))


_LONG = "longs AS (SELECT DISTINCT query_id, lower(w) AS keyword FROM (SELECT query_id, unnest(regexp_extract_all(question, '[A-Za-z]{7,}')) AS w FROM questions))"


@query("lexical_long_words", with_views("chunks") + f""", {_QUESTIONS}, {_LONG}, hit AS (SELECT *, row_number() OVER (PARTITION BY query_id, keyword ORDER BY chapter_id, chunk_index) AS n FROM longs JOIN chunks ON contains(lower(content), keyword))
SELECT query_id, chapter_id, chunk_index, min(keyword) AS keyword, count(*) AS keywords, 0.8::DOUBLE AS score FROM hit WHERE n <= 5 GROUP BY 1, 2, 3""")
def lexical_long_words(spark, d):
    """Lexical search by whole words of seven letters A to Z and more, five chunks each."""
    q = questions(spark, d)
    words = q.select("query_id", F.explode(F.regexp_extract_all("question", F.lit("([A-Za-z]{7,})"), 1)).alias("keyword"))
    return ret.lexical(T.chunks(spark, d), words, "query_id", "keyword", ["chapter_id", "chunk_index"], "content", 5)


@query("embedding_expansion", with_views("chunks", "mentions") + f""", {_QUESTIONS}, {_PROFILES}, {_NAMES_IN}, a AS (SELECT DISTINCT query_id, unnest(aliases) AS alias FROM found JOIN profiles USING (name)), b AS (SELECT query_id, list(alias ORDER BY alias)[1:5] AS a FROM a JOIN questions USING (query_id) WHERE NOT contains(question, alias) GROUP BY 1)
SELECT query_id, question || CASE WHEN a IS NULL THEN '' ELSE ' ' || array_to_string(a, ' ') END AS text FROM questions LEFT JOIN b USING (query_id)""")
def embedding_expansion(spark, d):
    """Questions as they are embedded: with five other names of who is named."""
    return ret.expanded(questions(spark, d), ret.expand_aliases(_found(spark, d), profiles(spark, d), "query_id", "name", "aliases"), "query_id", "question")


_EXACT = """five AS (SELECT * FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY mention_count DESC, name) AS n FROM found JOIN profiles USING (name)) WHERE n <= 5),
 held AS (SELECT five.query_id, five.name, c.chapter_id, c.chunk_index FROM five JOIN chunks c ON contains(c.content, five.name)), ex AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY chapter_id, chunk_index) AS n FROM held),
 exact AS (SELECT query_id, chapter_id, chunk_index, min(name) AS name, 0.95::DOUBLE AS score FROM ex WHERE n <= 4 GROUP BY 1, 2, 3)"""


@query("exact_entity_search", with_views("chunks", "mentions") + f""", {_QUESTIONS}, {_PROFILES}, {_NAMES_IN}, {_EXACT} SELECT query_id, chapter_id, chunk_index, name, score FROM exact""")
def exact_entity_search(spark, d):
    return _exact(spark, d, _named(spark, d))


def _exact(spark, d, named):
    """Chunks that contain a found name, for the five commonest names of a question and four chunks a name."""
    few = rel.first_by  # keep-first by windows
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mention_count"), "name"))
    five = named.select("query_id", "name", "mention_count").withColumn("n", n).where("n <= 5").select("query_id", "name")
    # names are found in the chunks' words by their first letters, as keywords are
    c = five.join(ret.containing(T.chunks(spark, d), five.select("name"), "name", ["chapter_id", "chunk_index"], "content"), "name")
    n = F.row_number().over(Window.partitionBy("query_id", "name").orderBy("chapter_id", "chunk_index"))
    c = c.withColumn("n", n).where("n <= 4")
    return few(c, ["query_id", "chapter_id", "chunk_index"], [F.col("name")]).select("query_id", "chapter_id", "chunk_index", "name", F.lit(0.95).alias("score"))


#: Entities, relations and events of the names in a question, and the neighbours of these names in the graph.
_KNOW = """near AS (SELECT DISTINCT chapter_id, chunk_index FROM mentions WHERE name IN (SELECT name FROM found)), m2 AS (SELECT m.* FROM mentions m JOIN near USING (chapter_id, chunk_index)),
 pp AS (SELECT a.chapter_id, a.chunk_index, a.pos AS i, b.pos AS j, a.name AS source, b.name AS target, least(a.name, b.name) AS lo, greatest(a.name, b.name) AS hi
  FROM m2 a JOIN m2 b ON a.chapter_id = b.chapter_id AND a.chunk_index = b.chunk_index AND a.pos < b.pos AND a.pos < 10 AND a.name <> b.name),
 facts AS (SELECT source, target, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_index, lo, hi ORDER BY i, j) AS k FROM pp) WHERE k = 1 GROUP BY 1, 2),
 entity AS (SELECT query_id, name, name AS key, mention_count AS n, name || ': ' || mention_count AS text FROM found JOIN profiles USING (name)),
 relation AS (SELECT query_id, name, source || ' ' || target AS key, n, source || ' ' || target || ': ' || n AS text FROM found JOIN facts ON name = source OR name = target),
 event AS (SELECT query_id, name, name || ' ' || chapter_id || ' ' || chunk_index AS key, count(*) AS n, name || ' in ' || chapter_id AS text FROM found JOIN m2 USING (name) GROUP BY query_id, name, chapter_id, chunk_index),
 graph AS (SELECT query_id, target AS key, sum(n)::BIGINT AS n, target AS text FROM found JOIN facts ON name = source GROUP BY 1, 2),
 known AS (SELECT DISTINCT query_id, source, ('0x' || left(md5(key), 15))::BIGINT AS id, score, text FROM (
  SELECT query_id, 'entity' AS source, key, 0.5::DOUBLE AS score, text, 5 AS most, row_number() OVER (PARTITION BY query_id, name ORDER BY n DESC, key) AS k FROM entity
  UNION ALL SELECT query_id, 'relation', key, 0.4::DOUBLE, text, 15, row_number() OVER (PARTITION BY query_id, name ORDER BY n DESC, key) FROM relation
  UNION ALL SELECT query_id, 'event', key, 0.3::DOUBLE, text, 8, row_number() OVER (PARTITION BY query_id, name ORDER BY n DESC, key) FROM event) WHERE k <= most),
 hops AS (SELECT query_id, ('0x' || left(md5(key), 15))::BIGINT AS id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, key) AS k FROM graph) WHERE k <= 5)"""


def _structured(spark, d, named):
    """What is known of the names that questions contain: entities, relations, events, neighbours (query_id, key, n, text)."""
    m, found = T.mentions(spark, d), named.select("query_id", "name")
    names = found.select("name").distinct()
    at = ["chapter_id", "chunk_index"]
    near = checkpointed(m.join(m.join(names, "name", "left_semi").select(*at).distinct(), at, "left_semi"))
    facts = checkpointed(rel.cooccurring(near, at).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))
    entity = named.select("query_id", "name", F.col("name").alias("key"), F.col("mention_count").alias("n"), F.concat("name", F.lit(": "), F.col("mention_count").cast("string")).alias("text"))
    ends = facts.withColumn("name", F.explode(F.array("source", "target")))
    both = F.concat_ws(" ", "source", "target")
    relation = found.join(ends, "name").select("query_id", "name", both.alias("key"), "n", F.concat(both, F.lit(": "), F.col("n").cast("string")).alias("text"))
    event = found.join(near, "name").groupBy("query_id", "name", *at).agg(F.count(F.lit(1)).alias("n"))
    event = event.select("query_id", "name", F.concat_ws(" ", "name", *[F.col(c).cast("string") for c in at]).alias("key"), "n", F.concat("name", F.lit(" in "), F.col("chapter_id").cast("string")).alias("text"))
    graph = found.join(facts.withColumnRenamed("source", "name"), "name").groupBy("query_id", F.col("target").alias("key")).agg(F.sum("n").alias("n")).withColumn("text", F.col("key"))
    return entity, relation, event, graph


def _known(entity, relation, event):
    return ret.knowledge([(entity, "entity", 0.5, 5), (relation, "relation", 0.4, 15), (event, "event", 0.3, 8)], "query_id", per=["name"])


@query("knowledge_search", with_views("chunks", "mentions") + f", {_QUESTIONS}, {_PROFILES}, {_NAMES_IN}, {_KNOW} SELECT query_id, source, id, score, text FROM known")
def knowledge_search(spark, d):
    return _known(*_structured(spark, d, _named(spark, d))[:3])


def _hits(spark, d):
    """Ranked lists of hits: exact, lexical (chunks), dense (chapter facts), knowledge (entities, relations, events), graph."""
    named = _named(spark, d)
    *kinds, graph = _structured(spark, d, named)
    row = lambda df, name, source, id_, score: df.select("query_id", F.lit(name).alias("list"), source.alias("source"), id_.alias("id"), score.cast("double").alias("score"))
    hops = ret.knowledge([(graph, "graph", 0.3, 5)], "query_id", extra=["n"])
    lists = (
        row(_exact(spark, d, named), "exact", F.lit("chunk"), F.expr(_CHUNK), F.col("score")),
        row(lexical(spark, d, named), "lexical", F.lit("chunk"), F.expr(_CHUNK), F.col("keywords")),
        row(_dense(spark, d, _question_vectors(spark, d)), "dense", F.lit("chapter_fact"), F.col("id"), F.col("score")),
        row(_known(*kinds), "knowledge", F.col("source"), F.col("id"), F.col("score")),
        row(hops, "graph", F.lit("graph"), F.col("id"), F.col("n")),
    )
    return reduce(lambda a, b: a.unionByName(b), lists)


_LISTS = f"{_QUESTIONS}, {_PROFILES}, {_NAMES_IN}, {_KEYWORDS}, {_LEX}, {_EXACT}, {_KNOW}"
_FUSED = f"""{_QDENSE}, hits AS (SELECT query_id, 'lexical' AS list, 'chunk' AS source, chapter_id * 1000000000 + chunk_index AS id, keywords::DOUBLE AS score FROM lexical UNION ALL SELECT query_id, 'exact', 'chunk', chapter_id * 1000000000 + chunk_index, score FROM exact
  UNION ALL SELECT query_id, 'dense', 'chapter_fact', id, score FROM dense UNION ALL SELECT query_id, 'knowledge', source, id, score FROM known UNION ALL SELECT query_id, 'graph', 'graph', id, n FROM hops),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, source, id) - 1 AS r FROM hits),
 fused AS (SELECT query_id, source, id, round(sum((CASE source WHEN 'chunk' THEN 1.0::DOUBLE WHEN 'chapter_fact' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) / (20.0::DOUBLE + r)), 9) AS score FROM ranked GROUP BY 1, 2, 3),
 topped AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, id) AS INT) AS rank FROM fused) WHERE rank <= 10)"""
_WEIGHTS = {"chunk": 1.0, "chapter_fact": 0.7, "*": 0.5}


@query("rrf_fuse", with_views("chunks", "mentions") + f", {_LISTS}, {_FUSED} SELECT query_id, source, id, score, rank FROM topped")
def rrf_fuse(spark, d):
    return rel.rank_fusion(_hits(spark, d), _WEIGHTS, 20, 10)


_GATED = """a AS (SELECT query_id, count(*) AS n, max(score) FILTER (WHERE rank <= 3) / (1.7::DOUBLE / 20) AS best FROM topped GROUP BY 1),
 g AS (SELECT q.query_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'retry_broader' WHEN n >= 3 AND best >= 0.4 THEN 'pass' WHEN q.query_id % 2 = 0 THEN 'retry_entity' ELSE 'retry_broader' END AS decision FROM questions q LEFT JOIN a USING (query_id))"""


def _gated(fused, q):
    """The gate on fused scores, normalised by the highest that fusion can give."""
    a = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (F.max(F.when(F.col("rank") <= 3, F.col("score"))) / F.lit(1.7 / 20)).alias("best"))
    g = q.join(a, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return g.select("query_id", "n", R.gate("n", "best", F.when(F.col("query_id") % 2 == 0, "known"), F.lit(0)).alias("decision"))


@query("quality_gate", with_views("chunks", "mentions") + f", {_LISTS}, {_FUSED}, {_GATED} SELECT query_id, n, decision FROM g")
def quality_gate(spark, d):
    return _gated(rrf_fuse(spark, d), questions(spark, d))


@query("hybrid_search", with_views("chunks", "mentions") + f""", {_LISTS}, {_FUSED}, {_GATED},
 v AS (SELECT *, CASE source WHEN 'chunk' THEN id // 1000000000 ELSE -id END AS grp FROM topped), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) AS k FROM v),
 x AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k > 2, score DESC, id) AS INT) AS place FROM w)
SELECT x.query_id, x.source, x.id, x.score, place AS rank, g.decision FROM x JOIN g USING (query_id) WHERE place <= 6""")
def hybrid_search(spark, d):
    """Hits of five lists, fused by rank, spread over chapters and gated: all questions in one plan, which fuses once."""
    w = Window.partitionBy("query_id")
    best = F.max(F.when(F.col("rank") <= 3, F.col("score"))).over(w) / F.lit(1.7 / 20)
    fused = rrf_fuse(spark, d).withColumn("best", best).withColumn("n", F.count(F.lit(1)).over(w))
    fused = fused.withColumn("decision", R.gate("n", "best", F.when(F.col("query_id") % 2 == 0, "known"), F.lit(0))).drop("n", "best")
    group = F.when(F.col("source") == "chunk", F.expr("id div 1000000000")).otherwise(-F.col("id"))
    spread = rel.diversify(fused.drop("rank").withColumn("grp", group), "grp", "score", 6)
    return spread.select("query_id", "source", "id", "score", "rank", "decision")


_CONTEXT = """t AS (SELECT 'chunk' AS source, chapter_id * 1000000000 + chunk_index AS id, content AS text FROM chunks UNION ALL SELECT 'chapter_fact', doc_id, text FROM documents),
 c AS (SELECT topped.query_id, source, id, topped.score, left(text, CASE source WHEN 'chunk' THEN 1200 ELSE 600 END) AS text FROM topped JOIN t USING (source, id)), contexts AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, id) AS INT) AS rank FROM c)"""


def _texts(spark, d):
    c = T.chunks(spark, d).select(F.lit("chunk").alias("source"), F.expr(_CHUNK).alias("id"), F.col("content").alias("text"))
    return c.unionByName(table(spark, d, "documents").select(F.lit("chapter_fact").alias("source"), F.col("doc_id").alias("id"), "text"))


def _contexts(spark, d):
    return ret.contexts(rrf_fuse(spark, d), _texts(spark, d), "query_id", {"chunk": 1200, "chapter_fact": 600}, 5)


@query("build_contexts", with_views("chunks", "mentions") + f", {_LISTS}, {_FUSED}, {_CONTEXT} SELECT query_id, source, id, score, text, rank FROM contexts WHERE rank <= 5")
def build_contexts(spark, d):
    return _contexts(spark, d).select("query_id", "source", "id", "score", "text", "rank")


@query("citation_resolve", with_views("chunks", "mentions") + f""", {_LISTS}, {_FUSED}, {_CONTEXT}, k AS (SELECT * FROM contexts WHERE rank <= 5), cites AS (SELECT query_id, 'chunk' AS type, id FROM k WHERE rank = 2 UNION ALL SELECT query_id, 'chunk', 1 FROM questions UNION ALL SELECT query_id, 'chapter_fact', 99 FROM questions)
SELECT c.query_id, c.type, c.id, coalesce(a.source, b.source) AS actual_type, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS actual_id FROM cites c LEFT JOIN k a ON a.query_id = c.query_id AND a.source = c.type AND a.id = c.id LEFT JOIN k b ON b.query_id = c.query_id AND b.rank = c.id""")
def citation_resolve(spark, d):
    k, q = _contexts(spark, d), questions(spark, d)
    cites = k.where("rank = 2").select("query_id", F.lit("chunk").alias("type"), "id").unionByName(q.select("query_id", F.lit("chunk").alias("type"), F.lit(1).cast("long").alias("id"))).unionByName(q.select("query_id", F.lit("chapter_fact").alias("type"), F.lit(99).cast("long").alias("id")))
    return ret.resolve_citations(cites, k, "query_id")


@query("entity_bruteforce", with_views("chunks") + "SELECT part, chapter_id, chunk_index, 0.6::DOUBLE AS score FROM (SELECT part, chapter_id, chunk_index, row_number() OVER (PARTITION BY part ORDER BY chapter_id, chunk_index) AS n FROM (SELECT unnest(['tionable', 'ingth', 'that']) AS part) p JOIN chunks ON contains(lower(content), part)) WHERE n <= 4")
def entity_bruteforce(spark, d):
    parts = [p for p in "tionable,ingth that x".replace(",", " ").split() if len(p) >= 2][:3]
    hits = F.filter(F.array(*[F.when(rel.contains_ci("content", p), F.lit(p)) for p in parts]), lambda x: x.isNotNull())
    c = T.chunks(spark, d).select("chapter_id", "chunk_index", F.explode(hits).alias("part"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("chapter_id", "chunk_index"))
    return c.withColumn("n", n).where("n <= 4").select("part", "chapter_id", "chunk_index", F.lit(0.6).alias("score"))


@query("stat_count", with_views("chunks", "mentions") + "SELECT book, count(DISTINCT name) AS characters, count(DISTINCT chapter_id) AS chapters FROM mentions WHERE name LIKE 'Th%' GROUP BY 1")
def stat_count(spark, d):
    return T.mentions(spark, d).where(F.col("name").startswith("Th")).groupBy("book").agg(F.count_distinct("name").alias("characters"), F.count_distinct("chapter_id").alias("chapters"))


# --- timelines and analyses


@query("timeline", with_views("relations") + """, r AS (SELECT 'relation' AS kind, chapter_id, source || ' ' || type || ' ' || target AS summary FROM relations WHERE source = 'S1' AND target = 'P1' ORDER BY chapter_id, seq LIMIT 10),
 c AS (SELECT 'chunk' AS kind, doc_id AS chapter_id, substring(f, greatest(instr(f, 'with') - 80, 1), instr(f, 'with') + 140 - greatest(instr(f, 'with') - 80, 1)) AS summary FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents) WHERE instr(f, 'with') > 0 ORDER BY doc_id LIMIT 20)
SELECT kind, chapter_id, summary FROM (SELECT * FROM r UNION ALL SELECT * FROM c) ORDER BY chapter_id, summary LIMIT 25""")
def timeline(spark, d):
    r = rel.page(T.relations(spark, d).where("source = 'S1' AND target = 'P1'"), [F.col("chapter_id"), F.col("seq")], 10)
    r = r.select(F.lit("relation").alias("kind"), "chapter_id", F.concat_ws(" ", "source", "type", "target").alias("summary"))
    c = rel.page(table(spark, d, "documents").where(F.col("text").contains("with")).select("doc_id", "text"), [F.col("doc_id")], 20)
    c = c.select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("chapter_id"), ret.excerpt("text", "with").alias("summary"))
    return rel.page(r.unionByName(c), [F.col("chapter_id"), F.col("summary")], 25)


@query("analyze_character", with_views("relations") + "SELECT name, mention_count, target, confidence FROM (SELECT e.name, e.mention_count, r.target, r.confidence, row_number() OVER (PARTITION BY e.name ORDER BY r.confidence DESC, r.chapter_id, r.seq, r.target) AS n FROM (SELECT source AS name, count(*) AS mention_count FROM relations WHERE contains(source, 'S1') GROUP BY 1) e JOIN relations r ON r.source = e.name) WHERE n <= 3")
def analyze_character(spark, d):
    r = T.relations(spark, d)
    e = r.where(F.col("source").contains("S1")).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("mention_count"))
    n = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("confidence"), "chapter_id", "seq", "target"))
    return e.join(r.withColumnRenamed("source", "name"), "name").withColumn("n", n).where("n <= 3").select("name", "mention_count", "target", "confidence")


@query("analyze_relation", with_views("relations") + "SELECT source, target, type, confidence, chapter_id, seq FROM relations WHERE source = 'S2' AND target = 'P3' ORDER BY confidence DESC, chapter_id, seq LIMIT 6")
def analyze_relation(spark, d):
    r = T.relations(spark, d).select("source", "target", "type", "confidence", "chapter_id", "seq")
    return rel.page(r.where(rel.either_pair("S2", "P3")), [F.desc("confidence"), F.col("chapter_id"), F.col("seq")], 6)
