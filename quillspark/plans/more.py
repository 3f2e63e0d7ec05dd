"""Queries of summaries, memory, exports, routing, uploads and index writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import relational as rel
from quillspark.registry import query
from quillspark.sources import sinks
from quillspark.sources import tables as T
from quillspark.sources.tables import table, with_views


@query("append_position", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def append_position(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", (n - 1).cast("long").alias("position"))


@query("book_set_tag", "SELECT lang, string_agg(DISTINCT source, '_' ORDER BY source) AS tag FROM documents GROUP BY 1")
def book_set_tag(spark, d):
    tag = F.array_join(F.array_sort(F.collect_set("source")), "_")
    return table(spark, d, "documents").groupBy("lang").agg(F.when(F.count("source") > 0, tag).alias("tag"))


@query("alias_rest", "SELECT p_partkey, list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x <> string_split(p_name, ' ')[1])) AS aliases FROM part")
def alias_rest(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_except(words, F.array(words[0]))).alias("aliases"))


@query("chapter_summary", with_views("chunks") + "SELECT chapter_id, arg_min(left(content, 100), chunk_index) AS summary FROM chunks WHERE trim(content) <> '' GROUP BY 1")
def chapter_summary(spark, d):
    c = T.chunks(spark, d).where(F.trim("content") != "")
    return c.groupBy("chapter_id").agg(F.min_by(F.left("content", F.lit(100)), "chunk_index").alias("summary"))


@query("prior_hint_candidates", with_views("chunks", "mentions") + """, n AS (SELECT book, name, count(*) AS n FROM mentions GROUP BY 1, 2), h AS (SELECT book, name, row_number() OVER (PARTITION BY book ORDER BY n DESC, name) AS k FROM n),
 c AS (SELECT chapter_id, book, name, min((chunk_index, pos)) AS o FROM mentions GROUP BY 1, 2, 3), r AS (SELECT chapter_id, book, name, row_number() OVER (PARTITION BY chapter_id, book ORDER BY o) AS k FROM c),
 u AS (SELECT x.chapter_id, h.name, h.k FROM (SELECT DISTINCT chapter_id, book FROM mentions) x JOIN h ON h.book = x.book WHERE h.k <= 3 UNION ALL SELECT chapter_id, name, 3 + k FROM r), f AS (SELECT chapter_id, name, min(k) AS k FROM u GROUP BY 1, 2)
SELECT chapter_id, name, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY k) - 1 AS INT) AS place FROM f""")
def prior_hint_candidates(spark, d):
    """Names hinted for a book (its three commonest) before those that a chapter mentions, each once."""
    m = T.mentions(spark, d).where("book IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "name"))
    hints = m.groupBy("book", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("k", n).where("k <= 3")
    hints = hints.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("hints"))
    first = m.groupBy("chapter_id", "book", "name").agg(F.min(F.struct("chunk_index", "pos")).alias("o"))
    names = first.groupBy("chapter_id", "book").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("names"))
    both = F.array_distinct(F.concat("hints", "names"))
    return names.join(hints, "book").select("chapter_id", F.posexplode(both).alias("place", "name"))


@query("raw_fact_dump", with_views("chunks", "mentions") + "SELECT chapter_id, to_json({'chapter_id': chapter_id, 'name': name, 'mentions': count(*)}) AS line FROM mentions GROUP BY chapter_id, name")
def raw_fact_dump(spark, d):
    n = T.mentions(spark, d).groupBy("chapter_id", "name").agg(F.count(F.lit(1)).alias("mentions"))
    return n.select("chapter_id", F.to_json(F.struct("chapter_id", "name", "mentions")).cast("string").alias("line"))


@query("session_memory", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, list(turn ORDER BY turn) AS turns, list(left(text, 80) ORDER BY turn) AS questions, list(role ORDER BY turn) AS roles FROM r WHERE n <= 10 GROUP BY 1""")
def session_memory(spark, d):
    """Saved and restored: the last ten turns, questions of at most 80 characters, through JSON."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = table(spark, d, "conversations").withColumn("n", n).where("n <= 10")
    kind = dict(last.dtypes)["turn"]
    saved = last.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", F.left("text", F.lit(80)).alias("text"), "role")))).alias("memory"))
    back = saved.select("conv_id", F.from_json("memory", f"array<struct<turn:{kind},text:string,role:string>>").alias("m"))
    return back.select("conv_id", F.col("m.turn").alias("turns"), F.col("m.text").alias("questions"), F.col("m.role").alias("roles"))


@query("optional_filters", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view' AND user_id = 3")
def optional_filters(spark, d):
    """Conditions that are given hold, the others are left out."""
    given = {"event_type": "view", "user_id": 3, "props": None}
    asked = [None if value is None else F.col(name) == value for name, value in given.items()]
    return rel.where_all(table(spark, d, "events"), *asked).select("event_id", "user_id", "event_type")


@query("tool_output_merge", """SELECT user_id, arg_max(props, (ts, event_id)) FILTER (WHERE props <> '') AS answer, arg_min(event_id, (ts, event_id)) AS run_id, list(event_type ORDER BY ts, event_id) AS steps FROM events GROUP BY 1""")
def tool_output_merge(spark, d):
    """The last answer that is not empty wins, the first run's id wins, lists are put one after the other."""
    o = F.struct("ts", "event_id")
    answer = F.max_by("props", F.when(F.col("props") != "", o))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, d, "events").groupBy("user_id").agg(answer.alias("answer"), F.min_by("event_id", o).alias("run_id"), steps.alias("steps"))


_ROUTES = {"view": "factual", "click": "relation", "purchase": "timeline", "error": "diagnosis"}


@query("prompt_route", "SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROUTES.items()) + " ELSE 'factual' END AS template FROM events")
def prompt_route(spark, d):
    routes = F.create_map(*[F.lit(x) for kv in _ROUTES.items() for x in kv])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(routes, F.col("event_type")), F.lit("factual")).alias("template"))


@query("rule_merge", """WITH g AS (SELECT r_regionkey AS rule, r_name AS value FROM region), b AS (SELECT n_nationkey AS book, n_nationkey % 7 AS rule, n_name AS value, n_nationkey % 3 = 0 AS replaces FROM nation)
SELECT book, b.rule AS rule, value FROM b UNION ALL SELECT b.book, g.rule, g.value FROM b, g WHERE NOT b.replaces AND b.rule <> g.rule""")
def rule_merge(spark, d):
    """A book's rules over the global ones (a table of few rows, sent along); a book whose mode is replace has its own alone."""
    g = table(spark, d, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("g"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("book"), (F.col("n_nationkey") % 7).alias("rule"), F.col("n_name").alias("value"), (F.col("n_nationkey") % 3 == 0).alias("replaces"))
    kept = F.map_filter("g", lambda k, v: ~F.col("replaces") & (k != F.col("rule")))
    return b.join(F.broadcast(g)).select("book", F.explode(F.map_concat(kept, F.create_map("rule", "value"))).alias("rule", "value"))


@query("src_upload_concat", "SELECT CAST(n_regionkey AS VARCHAR) AS book, string_agg(n_name || chr(10) || chr(10) || chr(10), '' ORDER BY CAST(n_nationkey AS VARCHAR)) AS text FROM nation GROUP BY 1")
def src_upload_concat(spark, d):
    """Nations written as text files, one each, and uploaded again: a book a region, files in order of names."""
    path = f"{sinks.shared_folder(spark)}/upload-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("book"), F.col("n_nationkey").alias("file"), "n_name")
    n.coalesce(1).write.partitionBy("book", "file").text(path)
    return T.upload(spark, f"{path}/*/*", F.regexp_extract("path", "/book=([^/]+)/", 1))


@query("index_upsert", "SELECT source AS book, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS size FROM documents WHERE source IS NOT NULL AND lang IS DISTINCT FROM 'de' GROUP BY 1")
def index_upsert(spark, d):
    """An index partitioned by book: written, written again for all books without one language (delete by filter), read."""
    path = f"{sinks.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    t = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("book"), "doc_id", "lang", "text")
    sinks.rewrite(t, path)
    sinks.rewrite(t.where(~F.col("lang").eqNullSafe("de")), path, of=t)
    sinks.rewrite(t.where(~F.col("lang").eqNullSafe("de")), path, of=t)  # again: nothing changes
    return spark.read.parquet(path).groupBy("book").agg(F.count(F.lit(1)).alias("items"), F.sum(F.char_length("text")).alias("size"))


@query("append_batches", "SELECT conv_id % 2 AS batch, count(*) AS n FROM conversations GROUP BY 1")
def append_batches(spark, d):
    """Rows appended in two batches, read as one table."""
    path = f"{sinks.shared_folder(spark)}/append-{uuid.uuid4().hex}"
    c = table(spark, d, "conversations").withColumn("batch", F.col("conv_id") % 2)
    for k in (0, 1):
        sinks.append(c.where(F.col("batch") == k), path)
    return spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("entity_only_in_book", with_views("chunks", "mentions") + "SELECT book, name FROM (SELECT book, name, count(DISTINCT book) OVER (PARTITION BY name) AS n FROM (SELECT DISTINCT book, name FROM mentions WHERE book IS NOT NULL)) WHERE n = 1")
def entity_only_in_book(spark, d):
    one = T.mentions(spark, d).where("book IS NOT NULL").groupBy("name").agg(F.min("book").alias("book"), F.max("book").alias("other"))
    return one.where("book = other").select("book", "name")
