"""Queries of scans, filters, joins, aggregates, windows, upserts and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import folds, graph
from quillspark.operators import relational as rel
from quillspark.registry import query
from quillspark.sources import tables as T
from quillspark.sources.tables import table, with_views

# --- scans


@query("doc_hash_dedup", "SELECT doc_id, sha256(coalesce(text, '')) AS hash, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def doc_hash_dedup(spark, d):
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = table(spark, d, "documents").select("doc_id", h.alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "hash").select("doc_id", "hash", (F.col("doc_id") != F.col("first")).alias("duplicate"))


@query("doc_char_count", "SELECT doc_id, CAST(length(replace(replace(text, ' ', ''), chr(10), '')) AS INT) AS chars FROM documents")
def doc_char_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length(F.translate("text", " \n", "")).alias("chars"))


@query("scan_point", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42")
def scan_point(spark, d):
    return T.scan(table(spark, d, "orders"), F.col("o_custkey") == 42, ["o_orderkey", "o_custkey", "o_totalprice"])


# --- filters


@query("filter_active", "SELECT event_id, ts, value FROM events WHERE user_id = 7 AND event_type = 'view'")
def filter_active(spark, d):
    return table(spark, d, "events").where("user_id = 7 AND event_type = 'view'").select("event_id", "ts", "value")


@query("search_contains", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'bleing')")
def search_contains(spark, d):
    return table(spark, d, "documents").where(rel.contains_ci("text", "BleIng")).select("doc_id", "source")


@query("relation_pair_lookup", with_views("relations") + "SELECT * FROM relations WHERE (source = 'S3' AND target = 'P4') OR (source = 'P4' AND target = 'S3')")
def relation_pair_lookup(spark, d):
    return T.relations(spark, d).where(rel.either_pair("S3", "P4"))


@query("alias_contains", "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'a'))) > 0 AND p_size > 10")
def alias_contains(spark, d):
    return table(spark, d, "part").withColumn("words", F.split("p_name", " ")).where(rel.any_contains("words", "a") & (F.col("p_size") > 10)).select("p_partkey", "p_name")


@query("timeline_range", with_views("tasks") + "SELECT event_id, book, chapter_number FROM tasks WHERE chapter_number BETWEEN 5 AND 12")
def timeline_range(spark, d):
    return T.tasks(spark, d).where(rel.in_bounds("chapter_number", [0, 12, 5, 30])).select("event_id", "book", "chapter_number")


@query("entities_paged", "SELECT o_custkey, count(*) AS mentions, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5)) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 5 ORDER BY mentions DESC, o_custkey LIMIT 20 OFFSET 20")
def entities_paged(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("mentions")).where("mentions >= 5")
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return rel.page(n, [F.desc("mentions"), F.col("o_custkey")], 20, 20).join(F.broadcast(total))


@query("pending_chapters", with_views("tasks") + "SELECT event_id, book, chapter_number, retry_count FROM tasks WHERE status IN ('PENDING', 'FAILED') AND retry_count < 5")
def pending_chapters(spark, d):
    return T.tasks(spark, d).where(F.col("status").isin("PENDING", "FAILED") & (F.col("retry_count") < 5)).select("event_id", "book", "chapter_number", "retry_count")


@query("book_summary", "SELECT doc_id, coalesce(lang, 'unknown') AS lang, left(text, 200) AS preview, CAST(strlen(text) AS INT) AS bytes FROM documents")
def book_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.left("text", F.lit(200)).alias("preview"), F.octet_length("text").alias("bytes"))


@query("empty_summary", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN '' ELSE props END AS s FROM events) WHERE s IS NULL OR s = ''")
def empty_summary(spark, d):
    e = table(spark, d, "events").withColumn("s", F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", "").otherwise(F.col("props")))
    return e.where(rel.blank("s")).select("event_id")


@query("prefix_paged", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_brand, 'Brand#1') ORDER BY p_partkey LIMIT 15 OFFSET 5")
def prefix_paged(spark, d):
    return rel.page(table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name"), [F.col("p_partkey")], 15, 5)


@query("selected_items", "SELECT l_orderkey, count(*) AS selected FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def selected_items(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("selected"))).alias("items"))
    return items.select("l_orderkey", F.size(F.filter("items", lambda i: i["selected"])).cast("long").alias("selected")).where("selected > 0")


# --- joins


@query("chapter_fact_left", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey")
def chapter_fact_left(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query("chapter_chunk_counts", with_views("chapters", "chunks") + "SELECT c.chapter_id, c.book, c.chapter_number, coalesce(n, 0) AS chunks FROM chapters c LEFT JOIN (SELECT chapter_id, count(*) AS n FROM chunks GROUP BY 1) USING (chapter_id)")
def chapter_chunk_counts(spark, d):
    return rel.count_onto(T.chapters(spark, d).select("chapter_id", "book", "chapter_number"), T.chunks(spark, d), ["chapter_id"], "chunks")


@query("patch_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS evidence_count, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS review_count FROM customer")
def patch_counts(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    base = table(spark, d, "customer").select("c_custkey")
    return rel.count_onto(rel.count_onto(base, o.where("o_orderstatus = 'O'"), ["c_custkey"], "evidence_count"), o.where("o_orderstatus = 'F'"), ["c_custkey"], "review_count")


@query("alias_pairs", with_views("chunks", "mentions") + ", n AS (SELECT DISTINCT chapter_id, name FROM mentions) SELECT a.chapter_id, a.name AS name_a, b.name AS name_b FROM n a JOIN n b ON a.chapter_id = b.chapter_id AND a.name < b.name")
def alias_pairs(spark, d):
    return rel.name_pairs(T.mentions(spark, d))


@query("cooccur_pairs", with_views("chunks", "mentions") + """, p AS (SELECT a.chapter_id, a.chunk_index, a.pos AS i, b.pos AS j, a.name AS source, b.name AS target, least(a.name, b.name) AS lo, greatest(a.name, b.name) AS hi
 FROM mentions a JOIN mentions b ON a.chapter_id = b.chapter_id AND a.chunk_index = b.chunk_index AND a.pos < b.pos AND a.pos < 10 AND a.name <> b.name)
SELECT chapter_id, chunk_index, source, target FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_index, lo, hi ORDER BY i, j) AS n FROM p) WHERE n = 1""")
def cooccur_pairs(spark, d):
    return rel.cooccurring(T.mentions(spark, d), ["chapter_id", "chunk_index"])


@query("stage_key_entities", with_views("relations") + """, e AS (SELECT book, source AS name, min(chapter_id % 30) + 1 AS first_chapter, max(chapter_id % 7) + 1 AS last_chapter, count(*) AS mention_count FROM relations GROUP BY 1, 2),
 s AS (SELECT DISTINCT book, i AS stage_index, CASE i WHEN 1 THEN 1 WHEN 2 THEN 11 ELSE 21 END AS start_chapter, CASE i WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 30 END AS end_chapter FROM relations, (SELECT unnest([1, 2, 3]) AS i))
SELECT book, stage_index, name, mention_count, CAST(n AS INT) AS rank FROM (SELECT s.book, stage_index, name, mention_count, row_number() OVER (PARTITION BY s.book, stage_index ORDER BY mention_count DESC, name) AS n FROM s JOIN e ON s.book = e.book AND first_chapter <= end_chapter AND last_chapter >= start_chapter) WHERE n <= 10""")
def stage_key_entities(spark, d):
    r = T.relations(spark, d)
    e = r.groupBy("book", F.col("source").alias("name")).agg((F.min(F.col("chapter_id") % 30) + 1).alias("first_chapter"), (F.max(F.col("chapter_id") % 7) + 1).alias("last_chapter"), F.count(F.lit(1)).alias("mention_count"))
    stages = graph.plot_stages(r.select("book").distinct().withColumn("chapters", F.lit(30)))
    return rel.overlapping(stages, e, ["book"]).select("book", "stage_index", "name", "mention_count", F.col("rank").cast("int").alias("rank"))


@query("resume_anti", with_views("tasks") + "SELECT DISTINCT book, chapter_number FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM tasks x WHERE x.book = t.book AND x.chapter_number = t.chapter_number AND x.status = 'SUCCESS' AND x.phase = 'purchase')")
def resume_anti(spark, d):
    t = T.tasks(spark, d)
    return rel.delete_by(t.select("book", "chapter_number").distinct(), t.where("status = 'SUCCESS' AND phase = 'purchase'"), ["book", "chapter_number"])


@query("semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("delete_by_key_anti", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_key_anti(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rel.delete_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


#: What a run has, by the lines that stand for it.
_TRACE = {"steps": "l_returnflag = 'R'", "model_calls": "l_returnflag = 'A'", "tool_calls": "l_returnflag = 'N'", "retrievals": "l_linestatus = 'F'", "patches": "l_quantity > 40"}


@query("run_trace", "SELECT o_orderkey, " + ", ".join(f"(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND {c}) AS {k}, (SELECT coalesce(list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber), []) FROM lineitem WHERE l_orderkey = o_orderkey AND {c}) AS {k}_list" for k, c in _TRACE.items()) + " FROM orders")
def run_trace(spark, d):
    """A run with its steps, calls, retrievals and patches: their numbers and, in order, which; one pass over the lines."""
    kinds = [F.when(F.expr(c), F.col("l_linenumber").cast("long")) for c in _TRACE.values()]
    aggs = [a for k, x in zip(_TRACE, kinds, strict=True) for a in (F.count(x).alias(k), F.array_sort(F.collect_list(x)).alias(f"{k}_list"))]
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*aggs)
    none = F.array().cast("array<bigint>")
    cols = [c for k in _TRACE for c in (F.coalesce(k, F.lit(0)).alias(k), F.coalesce(f"{k}_list", none).alias(f"{k}_list"))]
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", *cols)


# --- aggregates


@query("book_detail_counts", with_views("chapters", "chunks", "mentions") + """, e AS (SELECT DISTINCT book, name FROM mentions), r AS (SELECT DISTINCT chapter_id, book, name FROM mentions)
SELECT book, count(*) FILTER (WHERE t = 1) AS chapters, count(*) FILTER (WHERE t = 2) AS chunks, count(*) FILTER (WHERE t = 3) AS mentions, count(*) FILTER (WHERE t = 4) AS entities, count(*) FILTER (WHERE t = 5) AS characters, count(*) FILTER (WHERE t = 6) AS documents
 FROM (SELECT book, 1 AS t FROM chapters UNION ALL SELECT book, 2 FROM chunks UNION ALL SELECT book, 3 FROM mentions UNION ALL SELECT book, 4 FROM e UNION ALL SELECT book, 5 FROM r UNION ALL SELECT source, 6 FROM documents) GROUP BY 1""")
def book_detail_counts(spark, d):
    m = T.mentions(spark, d).select("book", "chapter_id", "name")
    documents = table(spark, d, "documents").select(F.col("source").alias("book"))
    return rel.counts_of({"chapters": T.chapters(spark, d), "chunks": T.chunks(spark, d), "mentions": m, "entities": m.select("book", "name").distinct(), "characters": m.distinct(), "documents": documents}, "book")


@query("count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_key(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("checkpoint_summary", with_views("tasks") + "SELECT book, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED' AND retry_count < 5) AS failed, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'FAILED' AND retry_count >= 5) AS permanent_failed FROM tasks GROUP BY 1")
def checkpoint_summary(spark, d):
    s, r = F.col("status"), F.col("retry_count")
    return T.tasks(spark, d).groupBy("book").agg(F.count_if(s == "SUCCESS").alias("success"), F.count_if((s == "FAILED") & (r < 5)).alias("failed"), F.count_if(s == "PENDING").alias("pending"), F.count_if((s == "FAILED") & (r >= 5)).alias("permanent_failed"))


@query("count_distinct_chapters", with_views("chunks", "mentions") + "SELECT name, count(DISTINCT chapter_id) AS chapters FROM mentions GROUP BY 1 HAVING count(DISTINCT chapter_id) >= 3")
def count_distinct_chapters(spark, d):
    return T.mentions(spark, d).groupBy("name").agg(F.count_distinct("chapter_id").alias("chapters")).where("chapters >= 3")


@query("merged_descriptions", """WITH o AS (SELECT o_custkey, o_orderpriority AS text, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS n FROM o)
SELECT o_custkey, string_agg(text, '；' ORDER BY n) AS text FROM r WHERE n <= 5 GROUP BY 1""")
def merged_descriptions(spark, d):
    return folds.first_distinct_joined(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("text")), ["o_custkey"], ["o_orderkey"], "text")


@query("eval_summary", "SELECT count(*) AS total, CAST(sum(quality) AS BIGINT) AS passed, CAST(sum(1 - quality) AS BIGINT) AS failed, round(sum(quality) * 100.0 / count(*), 2)::DOUBLE AS pass_rate FROM labels")
def eval_summary(spark, d):
    q = F.sum("quality").cast("long")
    return table(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), q.alias("passed"), F.sum(1 - F.col("quality")).cast("long").alias("failed"), F.round(q * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("pass_rate"))


@query("eval_compare", """WITH m AS (SELECT toxic AS provider, avg(length(text)) AS len, sum(quality) * 100.0 / count(*) AS pass, avg(n_chars % 7) AS cit FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT provider, round(len, 1)::DOUBLE AS avg_length, round(cit, 2)::DOUBLE AS avg_citations, round(pass, 1)::DOUBLE AS pass_rate, round(round(pass, 1) - first_value(round(pass, 1)) OVER (ORDER BY provider), 1)::DOUBLE AS delta FROM m""")
def eval_compare(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    m = j.groupBy(F.col("toxic").alias("provider")).agg(F.round(F.avg(F.char_length("text")), 1).alias("avg_length"), F.round(F.avg(F.col("n_chars") % 7), 2).alias("avg_citations"), F.round(F.sum("quality") * 100.0 / F.count(F.lit(1)), 1).cast("double").alias("pass_rate"))
    first = F.first("pass_rate").over(Window.partitionBy().orderBy("provider"))  # one row a provider
    return m.withColumn("delta", F.round(F.col("pass_rate") - first, 1))


@query("eval_report", "SELECT source, count(*) AS cases, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS better, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS worse, round(count(*) FILTER (WHERE quality = 1) * 1.0 / count(*), 4)::DOUBLE AS ratio FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def eval_report(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = F.count(F.lit(1))
    return j.groupBy("source").agg(n.alias("cases"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("better"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("worse"), F.round(F.count_if(F.col("quality") == 1) / n, 4).alias("ratio"))


@query("failure_abort", with_views("tasks") + """, i AS (SELECT *, sum(CASE WHEN status = 'FAILED' THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY ts, event_id) AS g FROM tasks),
 r AS (SELECT book, g, count(*) FILTER (WHERE status = 'FAILED') AS run, count(*) AS n FROM i GROUP BY 1, 2)
SELECT book, CAST(max(run) AS BIGINT) AS longest, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(run) AS BIGINT) AS flagged, max(run) >= 5 OR sum(run) > 0.2 * sum(n) AS abort FROM r GROUP BY 1""")
def failure_abort(spark, d):
    t = T.tasks(spark, d).withColumn("failed", F.col("status") == "FAILED")
    return rel.longest_run(t, ["book"], ["ts", "event_id"], "failed").withColumn("abort", (F.col("longest") >= 5) | (F.col("flagged") > 0.2 * F.col("rows")))


@query("session_rollup", "SELECT conv_id, count(*) AS turns, arg_max(text, turn) AS last_text, arg_max(role, turn) AS last_role, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_question FROM conversations GROUP BY 1")
def session_rollup(spark, d):
    last = lambda c, when=None: F.max_by(c, F.col("turn") if when is None else F.when(when, F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), last("text").alias("last_text"), last("role").alias("last_role"), last("text", F.col("role") == "user").alias("last_question"))


# --- windows, limits, sets


@query("resume_chapters", with_views("tasks") + """, s AS (SELECT book, chapter_number, arg_max(status, (ts, event_id)) AS status FROM tasks GROUP BY 1, 2), f AS (SELECT book, min(chapter_number) AS first FROM s WHERE status <> 'SUCCESS' GROUP BY 1)
SELECT s.book, s.chapter_number FROM s JOIN f USING (book) WHERE s.chapter_number >= first - 2""")
def resume_chapters(spark, d):
    s = rel.latest(T.tasks(spark, d).select("book", "chapter_number", "ts", "event_id", "status"), ["book", "chapter_number"], ["ts", "event_id"])
    first = s.where("status <> 'SUCCESS'").groupBy("book").agg(F.min("chapter_number").alias("first"))
    return s.join(first, "book").where("chapter_number >= first - 2").select("book", "chapter_number")


@query("recent_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_messages(spark, d):
    return rel.last_n(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)


@query("multi_turn_query", """WITH p AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, role FROM conversations)
SELECT conv_id, turn, CASE WHEN before IS NULL OR before = text THEN text ELSE '[历史] ' || before || ' [当前] ' || text END AS search FROM p WHERE role = 'user'""")
def multi_turn_query(spark, d):
    c = table(spark, d, "conversations")
    c = c.withColumn("before", rel.previous(c, ["conv_id"], ["turn"], "text", F.col("role") == "user")).where("role = 'user'")
    joined = F.concat(F.lit("[历史] "), "before", F.lit(" [当前] "), "text")
    return c.select("conv_id", "turn", F.when(F.col("before").isNull() | (F.col("before") == F.col("text")), F.col("text")).otherwise(joined).alias("search"))


@query("session_compact", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE c <= 10 OR n <= 5")
def session_compact(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    w = Window.partitionBy("conv_id")
    return c.withColumn("n", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("c", F.count(F.lit(1)).over(w)).where("c <= 10 OR n <= 5").select("conv_id", "turn")


@query("latest_task", with_views("tasks") + "SELECT book, phase, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status FROM tasks GROUP BY 1, 2")
def latest_task(spark, d):
    return rel.latest(T.tasks(spark, d).select("book", "phase", "event_id", "ts", "status"), ["book", "phase"], ["ts", "event_id"]).select("book", "phase", "event_id", "status")


@query("relations_top", with_views("relations") + "SELECT book, source, target, confidence, chapter_id, seq FROM relations ORDER BY confidence DESC, chapter_id, seq LIMIT 50")
def relations_top(spark, d):
    return rel.page(T.relations(spark, d).select("book", "source", "target", "confidence", "chapter_id", "seq"), [F.desc("confidence"), F.col("chapter_id"), F.col("seq")], 50)


@query("dedup_first", with_views("relations") + "SELECT source, target, chapter_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY chapter_id, seq) AS n FROM relations) WHERE n = 1")
def dedup_first(spark, d):
    return rel.first_by(T.relations(spark, d).select("source", "target", "chapter_id", "seq"), ["source", "target"], [F.col("chapter_id"), F.col("seq")])


@query("search_union", "(SELECT 'chunk' AS kind, doc_id AS id, left(text, 200) AS preview, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'bleing') ORDER BY doc_id LIMIT 20) UNION ALL (SELECT 'entity', p_partkey, p_name, 0.0::DOUBLE FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 10)")
def search_union(spark, d):
    docs = table(spark, d, "documents").where(rel.contains_ci("text", "bleing")).select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"), F.left("text", F.lit(200)).alias("preview"), F.lit(0.0).alias("score"))
    parts = table(spark, d, "part").where(rel.contains_ci("p_name", "a")).select(F.lit("entity").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("preview"), F.lit(0.0).alias("score"))
    return rel.page(docs, [F.col("id")], 20).unionByName(rel.page(parts, [F.col("id")], 10))


@query("diversify", """WITH s AS (SELECT user_id % 20 AS query_id, event_id AS id, event_type AS chapter, value AS score FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, chapter ORDER BY score DESC, id) AS n FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, score DESC, id) AS rank FROM a) SELECT query_id, id, chapter, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""")
def diversify(spark, d):
    s = table(spark, d, "events").select((F.col("user_id") % 20).alias("query_id"), F.col("event_id").alias("id"), F.col("event_type").alias("chapter"), F.col("value").alias("score"))
    return rel.diversify(s, "chapter", "score", 8)


# --- upserts and folds


@query("upsert_last_wins", "SELECT l_orderkey, arg_max(l_quantity, (l_linenumber, l_shipdate, l_quantity)) AS l_quantity, arg_max(l_shipdate, (l_linenumber, l_shipdate, l_quantity)) AS l_shipdate, CAST(max(l_linenumber) AS INT) AS l_linenumber FROM lineitem GROUP BY 1")
def upsert_last_wins(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").withColumn("seq", F.struct("l_linenumber", "l_shipdate", "l_quantity"))
    return rel.upsert(li.where("l_linenumber <= 2"), li.where("l_linenumber > 2"), ["l_orderkey"], "seq").drop("seq")


@query("relation_fact_agg", with_views("relations") + """, a AS (SELECT book, source, target, type, list(confidence ORDER BY chapter_id, seq, confidence, polarity) AS c, count(*) AS strength, arg_min(polarity, (chapter_id, seq, confidence, polarity)) AS polarity, arg_min(chapter_id, (chapter_id, seq)) AS first_chapter, max(chapter_id) AS last_chapter FROM relations GROUP BY 1, 2, 3, 4)
SELECT book, source, target, type, strength, polarity, first_chapter, last_chapter, round(list_reduce(c, lambda x, y: (x + y) / 2) + 1e-12, 6) AS confidence FROM a""")
def relation_fact_agg(spark, d):
    return folds.relation_facts(T.relations(spark, d), ["book", "source", "target", "type"], ["chapter_id", "seq", "confidence", "polarity"]).withColumn("confidence", F.round(F.col("confidence") + 1e-12, 6))


@query("entity_profile_agg", "SELECT l_suppkey AS entity, CAST(sum(l_quantity) AS BIGINT) AS mention_count, min(l_orderkey) AS first_chapter, max(l_orderkey) AS last_chapter, arg_max(l_returnflag, (l_orderkey, l_linenumber)) FILTER (WHERE l_linestatus = 'F') AS description FROM lineitem GROUP BY 1")
def entity_profile_agg(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("long").alias("n"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("").alias("description"))
    return folds.entity_profiles(m, ["entity"], ["chapter_id", "seq"])


@query("event_fact_agg", """WITH m AS (SELECT o_custkey % 100 AS book, o_orderstatus AS type, CASE o_orderpriority[1] WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'OTHER' ELSE 'LOW' END AS importance, o_custkey AS participants, o_orderkey AS chapter_id FROM orders)
SELECT book, type, arg_max(importance, (CASE importance WHEN 'LOW' THEN 1 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 2 END, -chapter_id)) AS importance, arg_min(participants, chapter_id) AS participants, min(chapter_id) AS first_chapter, max(chapter_id) AS last_chapter FROM m GROUP BY 1, 2""")
def event_fact_agg(spark, d):
    p = F.left("o_orderpriority", F.lit(1))
    imp = F.when(p == "1", "CRITICAL").when(p == "2", "HIGH").when(p == "3", "MEDIUM").when(p == "4", "OTHER").otherwise("LOW")
    m = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("book"), F.col("o_orderstatus").alias("type"), imp.alias("importance"), F.col("o_custkey").alias("participants"), F.col("o_orderkey").alias("chapter_id"))
    return folds.event_facts(m, ["book", "type"], ["chapter_id"])


@query("citation_nullif", "SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS chunk_id, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS chapter_id FROM events")
def citation_nullif(spark, d):
    return rel.null_if_not_positive(table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("chunk_id"), (F.col("event_id") % 5).alias("chapter_id")), "chunk_id", "chapter_id")


@query("sparse_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer")
def sparse_update(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = base.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return rel.sparse_update(base, delta, ["c_custkey"])


@query("relation_dedup", with_views("relations") + """, e AS (SELECT chapter_id * 10 + seq AS id, book, type, CASE WHEN seq % 2 = 0 THEN source ELSE target END AS source, CASE WHEN seq % 2 = 0 THEN target ELSE source END AS target, confidence, chapter_id FROM relations),
 k AS (SELECT *, row_number() OVER (PARTITION BY book, type, least(source, target), greatest(source, target) ORDER BY confidence DESC, id) AS n FROM e),
 a AS (SELECT book, type, least(source, target) AS lo, greatest(source, target) AS hi, count(DISTINCT chapter_id) AS c FROM e GROUP BY 1, 2, 3, 4)
SELECT k.id, k.book, k.type, k.source, k.target, k.confidence, CASE WHEN n = 1 THEN 'ACTIVE' ELSE 'MERGED' END AS status, CASE WHEN n = 1 THEN c ELSE 1 END AS evidence FROM k JOIN a ON k.book = a.book AND k.type = a.type AND lo = least(source, target) AND hi = greatest(source, target)""")
def relation_dedup(spark, d):
    r = T.relations(spark, d)
    odd = F.col("seq") % 2 == 1
    e = r.select((F.col("chapter_id") * 10 + F.col("seq")).alias("id"), "book", "type", F.when(odd, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(odd, F.col("source")).otherwise(F.col("target")).alias("target"), "confidence", F.array("chapter_id").alias("evidence"))
    return folds.relation_dedup(e, ["book", "type"], "id", "evidence", "confidence").withColumn("evidence", F.size("evidence").cast("long"))


# --- graph

_NODES = ", nodes AS (SELECT book, source AS name, min(chapter_id) AS node_id FROM relations GROUP BY 1, 2 UNION ALL SELECT book, target, min(chapter_id) FROM relations WHERE target < 'P15' GROUP BY 1, 2)"


def _nodes(r):
    s = r.groupBy("book", F.col("source").alias("name")).agg(F.min("chapter_id").alias("node_id"))
    return s.unionByName(r.where("target < 'P15'").groupBy("book", F.col("target").alias("name")).agg(F.min("chapter_id").alias("node_id")))


@query("graph_edges", with_views("relations") + _NODES + ", f AS (SELECT DISTINCT book, source, target, type FROM relations) SELECT f.book, f.source, f.target, f.type, a.node_id AS source_id, b.node_id AS target_id FROM f JOIN nodes a ON a.book = f.book AND a.name = f.source JOIN nodes b ON b.book = f.book AND b.name = f.target")
def graph_edges(spark, d):
    r = T.relations(spark, d)
    return graph.edges(r.select("book", "source", "target", "type").distinct(), _nodes(r))


@query("graph_neighbors", with_views("relations") + "SELECT DISTINCT book, source, type, target FROM relations WHERE source IN ('S1', 'S7') AND book = 1")
def graph_neighbors(spark, d):
    r = T.relations(spark, d)
    starts = spark.createDataFrame([(1, "S1"), (1, "S7")], "book long, name string")
    return graph.neighbours(r.select("book", "source", "type", "target").distinct(), starts)


@query("graph_participation", with_views("relations") + _NODES + ", e AS (SELECT DISTINCT book, chapter_id AS event_id, name FROM (SELECT book, chapter_id, source AS name FROM relations UNION ALL SELECT book, chapter_id, target FROM relations)) SELECT DISTINCT e.book, e.event_id, n.node_id FROM e JOIN nodes n ON n.book = e.book AND n.name = e.name")
def graph_participation(spark, d):
    r = T.relations(spark, d)
    events = r.groupBy("book", F.col("chapter_id").alias("event_id")).agg(F.array_union(F.collect_set("source"), F.collect_set("target")).alias("participants"))
    return graph.participation(events, _nodes(r))


@query("normalize_entity_names", with_views("relations") + ", al AS (SELECT book, 'S' || i AS alias, 'S' || (i % 4) AS name FROM (SELECT DISTINCT book FROM relations), (SELECT unnest(range(4, 20)) AS i)) SELECT DISTINCT r.book, r.chapter_id, r.seq, coalesce(a.name, r.source) AS source, coalesce(b.name, r.target) AS target FROM relations r LEFT JOIN al a ON a.book = r.book AND a.alias = r.source LEFT JOIN al b ON b.book = r.book AND b.alias = r.target")
def normalize_entity_names(spark, d):
    r = T.relations(spark, d).select("book", "chapter_id", "seq", "source", "target").distinct()
    ids = F.explode(F.sequence(F.lit(4), F.lit(19)))
    al = r.select("book").distinct().select("book", ids.alias("i")).select("book", F.concat(F.lit("S"), F.col("i").cast("string")).alias("alias"), F.concat(F.lit("S"), (F.col("i") % 4).cast("string")).alias("name"))
    return graph.canonical_names(r, al).distinct()


@query("plot_stages", with_views("chapters") + """, b AS (SELECT book || '-' || lang AS book, CAST(count(*) AS INT) AS n FROM chapters GROUP BY 1), t AS (SELECT *, greatest(1, n // 3) AS k FROM b)
SELECT book, n AS chapters, 1 AS stage_index, CASE WHEN n <= 3 THEN '全书' ELSE '开端' END AS stage_name, 1 AS start_chapter, CAST(CASE WHEN n <= 3 THEN n ELSE k END AS INT) AS end_chapter FROM t
UNION ALL SELECT book, n, 2, '发展', CAST(k + 1 AS INT), CAST(2 * k AS INT) FROM t WHERE n > 3 UNION ALL SELECT book, n, 3, '结局', CAST(2 * k + 1 AS INT), n FROM t WHERE n > 3""")
def plot_stages(spark, d):
    b = T.chapters(spark, d).groupBy(F.concat_ws("-", "book", "lang").alias("book")).agg(F.count(F.lit(1)).cast("int").alias("chapters"))
    return graph.plot_stages(b)


@query("illegal_transitions", with_views("tasks") + ", t AS (SELECT book, event_id, status, lag(status) OVER (PARTITION BY book ORDER BY ts, event_id) AS before FROM tasks) SELECT book, event_id, before, status FROM t WHERE before IS NOT NULL AND before <> status AND before || '>' || status NOT IN ('PENDING>SUCCESS', 'PENDING>FAILED', 'FAILED>PENDING')")
def illegal_transitions(spark, d):
    t = T.tasks(spark, d).select("book", "event_id", "ts", "status")
    return graph.last_transitions(t, ["book"], ["ts", "event_id"], "status", [("PENDING", "SUCCESS"), ("PENDING", "FAILED"), ("FAILED", "PENDING")]).select("book", "event_id", "before", "status")
