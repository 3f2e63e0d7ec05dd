"""Queries of governed names, incremental facts, quality stages and reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import folds
from quillspark.operators import governance as gov
from quillspark.plans.text import ALIAS_LISTS, ALIAS_PREFIX, alias_cases
from quillspark.registry import query
from quillspark.sources import keyed, sinks
from quillspark.sources import tables as T
from quillspark.sources.tables import NAME, table, with_views

#: Hints: the first two names of a benchmark item are one, in each book that has the first.
_HINTS = f"hints AS (SELECT DISTINCT book, n[1] AS name, n[2] AS alias FROM (SELECT regexp_extract_all(text, '{NAME}') AS n FROM benchmark) JOIN (SELECT DISTINCT book, name FROM mentions WHERE book IS NOT NULL) m ON m.name = n[1] WHERE len(n) >= 2 AND n[1] <> n[2])"
_GOVERNED = f"""{_HINTS}, h AS (SELECT DISTINCT book, least(name, alias) AS a, greatest(name, alias) AS b FROM hints), m AS (SELECT DISTINCT book, chapter_id, name FROM mentions WHERE book IS NOT NULL),
 t AS (SELECT DISTINCT x.book, x.name AS a, y.name AS b, {ALIAS_LISTS} FROM m x JOIN m y ON x.chapter_id = y.chapter_id AND x.book = y.book AND x.name < y.name), k AS (SELECT *, {ALIAS_PREFIX} FROM t),
 d AS (SELECT k.book, k.a AS name_a, k.b AS name_b, {alias_cases()[0].replace("(a", "(k.a").replace(" b)", " k.b)")} AS by_rule, {alias_cases()[1].replace("(a", "(k.a").replace(" b)", " k.b)")} AS sure FROM k),
 merges AS (SELECT d.book, name_a, name_b, 'MERGE' AS decision, CASE WHEN by_rule <> 'MERGE' THEN greatest(sure, 0.7::DOUBLE) ELSE sure END AS confidence, by_rule, h.a IS NOT NULL AS hinted FROM d LEFT JOIN h ON h.book = d.book AND h.a = name_a AND h.b = name_b WHERE by_rule = 'MERGE' OR h.a IS NOT NULL)"""
_GOVERNED = _GOVERNED.replace("k.a", "a").replace("k.b,", "b,").replace("k.b)", "b)").replace("SELECT k.book, a AS name_a, k.b AS name_b", "SELECT book, a AS name_a, b AS name_b")


def _hints(spark, d):
    n = table(spark, d, "benchmark").select(F.regexp_extract_all("text", F.lit(f"({NAME})"), 1).alias("n")).where("size(n) >= 2 AND n[0] <> n[1]")
    n = n.select(F.col("n")[0].alias("name"), F.col("n")[1].alias("alias")).distinct()
    return T.mentions(spark, d).where("book IS NOT NULL").select("book", "name").distinct().join(n, "name").select("book", "name", "alias")


def _merges(spark, d):
    return gov.decisions(T.mentions(spark, d).where("book IS NOT NULL"), _hints(spark, d))


@query("governed_names", with_views("chunks", "mentions") + f", {_GOVERNED} SELECT * FROM merges")
def governed_names(spark, d):
    """MERGE decisions on the names of chapters, by rules and by hints."""
    return _merges(spark, d)


@query("governed_profiles")
def governed_profiles(spark, d):
    """Profiles of all names by these decisions, greedy in order of names."""
    return gov.profiles(T.mentions(spark, d).where("book IS NOT NULL"), _merges(spark, d))


# --- facts kept up batch by batch

_FACTS = """a AS (SELECT book, source, target, type, list(confidence ORDER BY chapter_id, seq, confidence, polarity) AS c, count(*) AS strength, arg_min(polarity, (chapter_id, seq, confidence, polarity)) AS polarity, min(chapter_id) AS first_chapter, max(chapter_id) AS last_chapter FROM relations GROUP BY 1, 2, 3, 4)"""


@query("relation_facts_by_batch", with_views("relations") + f""", {_FACTS} SELECT book, source, target, type, strength, polarity, first_chapter, last_chapter, round(list_reduce(c, lambda x, y: (x + y) / 2) + 1e-12, 6) AS confidence FROM a""")
def relation_facts_by_batch(spark, d):
    """Relation mentions in three batches by chapter, each added to the facts of those before; one comes twice."""
    r = T.relations(spark, d)
    keys = ["book", "source", "target", "type"]
    schema = r.select(*keys, F.lit(1).cast("long").alias("strength"), "polarity", F.col("chapter_id").alias("first_chapter"), F.col("chapter_id").alias("last_chapter"), "confidence").schema
    for f in schema.fields:
        f.nullable = True
    facts = folds.RelationFacts(keyed.KeyedTable(spark, f"{sinks.shared_folder(spark)}/facts-{uuid.uuid4().hex}", schema, keys, buckets=4), ["chapter_id", "seq", "confidence", "polarity"])
    high = r.agg(F.max("chapter_id")).first()[0] or 0
    for n, (a, b) in enumerate([(0, high // 3), (high // 3, high // 2), (high // 3, high // 2), (high // 2, high + 1)]):
        facts.add(r.where((F.col("chapter_id") > a if a else F.lit(True)) & (F.col("chapter_id") <= b)), number=min(n, 1) if n < 3 else 2)
    return facts.table.read().withColumn("confidence", F.round(F.col("confidence") + 1e-12, 6))


# --- quality stages

_QFACTS = """f0 AS (SELECT book, source, target, type, book * 100000 + CAST(substring(source, 2) AS BIGINT) * 1000 + CAST(substring(target, 2) AS BIGINT) * 10 + instr('RAN', type) AS id, max(confidence) AS confidence, CASE WHEN count(*) % 5 = 0 THEN 'MERGED' ELSE 'ACTIVE' END AS status FROM relations GROUP BY 1, 2, 3, 4),
 ev AS (SELECT event_id AS id, event_type AS type, CASE WHEN user_id % 3 = 0 THEN ' ' || props ELSE '' END AS description, CASE WHEN event_id % 4 > 0 THEN 'told' END AS summary FROM events),
 al AS (SELECT book, n AS alias, left(n, 1) || (CAST(substring(n, 2) AS INT) % 10) AS name FROM (SELECT book, source AS n FROM f0 UNION SELECT book, target FROM f0)),
 nw AS (SELECT f0.*, CASE WHEN status = 'ACTIVE' THEN coalesce(s.name, source) ELSE source END AS s2, CASE WHEN status = 'ACTIVE' THEN coalesce(t.name, target) ELSE target END AS t2 FROM f0 LEFT JOIN al s ON s.book = f0.book AND s.alias = source LEFT JOIN al t ON t.book = f0.book AND t.alias = target),
 st AS (SELECT *, s2 <> source OR t2 <> target AS moved, row_number() OVER (PARTITION BY book, s2, t2, type ORDER BY s2 <> source OR t2 <> target, id) = 1 AS stays FROM nw),
 f1 AS (SELECT id, book, type, confidence, CASE WHEN moved AND stays THEN s2 ELSE source END AS source, CASE WHEN moved AND stays THEN t2 ELSE target END AS target, CASE WHEN moved AND NOT stays THEN 'MERGED' ELSE status END AS status FROM st),
 dd AS (SELECT *, row_number() OVER (PARTITION BY book, type, least(source, target), greatest(source, target) ORDER BY confidence DESC, id) AS n FROM f1 WHERE status = 'ACTIVE')"""


def _quality(spark, d):
    r = T.relations(spark, d)
    f = r.groupBy("book", "source", "target", "type").agg(F.max("confidence").alias("confidence"), F.when(F.count(F.lit(1)) % 5 == 0, "MERGED").otherwise("ACTIVE").alias("status"))
    f = f.withColumn("id", F.expr("book * 100000 + CAST(substring(source, 2) AS BIGINT) * 1000 + CAST(substring(target, 2) AS BIGINT) * 10 + instr('RAN', type)"))
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" "), "props")).otherwise("").alias("description"), F.when(F.col("event_id") % 4 > 0, "told").alias("summary"))
    n = f.select("book", F.explode(F.array("source", "target")).alias("n")).distinct()
    p = n.groupBy("book", F.concat(F.left("n", F.lit(1)), (F.expr("CAST(substring(n, 2) AS INT)") % 10).cast("string")).alias("name")).agg(F.collect_set("n").alias("aliases"))
    root = f"{sinks.shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    made = []
    for name, df in (("facts", f), ("events", e)):
        for field in (schema := df.schema).fields:
            field.nullable = True
        made.append(keyed.KeyedTable(spark, f"{root}/{name}", schema, ["id"], buckets=4))
        made[-1].upsert(df)
    return *made, p


@query("quality_dry_run", with_views("relations") + f""", {_QFACTS}
SELECT 'names' AS stage, 'relation_fact' AS name, id, 'source' AS column, source AS before, s2 AS after FROM st WHERE moved AND stays AND s2 <> source UNION ALL SELECT 'names', 'relation_fact', id, 'target', target, t2 FROM st WHERE moved AND stays AND t2 <> target
UNION ALL SELECT 'names', 'relation_fact', id, 'status', 'ACTIVE', 'MERGED' FROM st WHERE moved AND NOT stays UNION ALL SELECT 'relations', 'relation_fact', id, 'status', 'ACTIVE', 'MERGED' FROM dd WHERE n > 1
UNION ALL SELECT 'summaries', 'event_fact', id, 'summary', summary, coalesce(nullif(left(trim(description), 60), ''), type) FROM ev WHERE coalesce(summary, '') = ''""")
def quality_dry_run(spark, d):
    """What the quality stages would change: names by alias, facts of one pair, empty summaries.  Nothing is written."""
    return gov.quality(*_quality(spark, d), dry_run=True)


@query("quality_applied", with_views("relations") + f""", {_QFACTS} SELECT f1.id, f1.book, f1.type, f1.confidence, f1.source, f1.target, CASE WHEN dd.n > 1 THEN 'MERGED' ELSE f1.status END AS status FROM f1 LEFT JOIN dd ON dd.id = f1.id AND dd.book = f1.book""")
def quality_applied(spark, d):
    """The facts once the stages have run, twice: the second time there is nothing left to change."""
    facts, events, p = _quality(spark, d)
    gov.quality(facts, events, p, dry_run=False)
    again = gov.quality(facts, events, p, dry_run=False)
    if not again.isEmpty():
        raise AssertionError("a second run of the quality stages must change nothing")
    return facts.read()


# --- reviews

#: Patches are users' ids, reviews their events.
_REVIEWS = """pt AS (SELECT DISTINCT user_id AS patch_id, CASE WHEN user_id % 11 = 0 THEN 'MERGED' ELSE 'PENDING_REVIEW' END AS status FROM events WHERE user_id % 10 > 0),
 rv AS (SELECT user_id AS patch_id, event_id, CASE event_type WHEN 'view' THEN 'needs_more_evidence' WHEN 'click' THEN NULL WHEN 'purchase' THEN 'MERGE' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'CANCEL' ELSE 'supersede' END ELSE 'fix' END AS action,
   CASE WHEN event_type IN ('click', 'error') AND event_id % 3 > 0 THEN event_id % 3 = 1 END AS approved FROM events),
 ra AS (SELECT patch_id, event_id, CASE WHEN upper(action) IN ('ACCEPT', 'REJECT', 'NEEDS_MORE_EVIDENCE', 'SUPERSEDE', 'MERGE', 'CANCEL') THEN upper(action) WHEN approved THEN 'ACCEPT' WHEN NOT approved THEN 'REJECT' ELSE 'REVIEW' END AS act, action FROM rv),
 rs AS (SELECT ra.*, status, MAP {'ACCEPT': 'ACCEPTED', 'REJECT': 'REJECTED', 'NEEDS_MORE_EVIDENCE': 'NEEDS_MORE_EVIDENCE', 'SUPERSEDE': 'SUPERSEDED', 'MERGE': 'MERGED', 'CANCEL': 'CANCELED'}[act] AS to_,
   row_number() OVER (PARTITION BY ra.patch_id ORDER BY event_id) AS n FROM ra LEFT JOIN pt ON pt.patch_id = ra.patch_id),
 walk AS (SELECT patch_id, 0::BIGINT AS n, status AS state, NULL::BIGINT AS event_id, NULL::VARCHAR AS act, NULL::VARCHAR AS action, NULL::VARCHAR AS before, NULL::VARCHAR AS to_, false AS ok FROM (SELECT DISTINCT patch_id, status FROM rs)
  UNION ALL SELECT rs.patch_id, rs.n, CASE WHEN rs.to_ IS NOT NULL AND w.state NOT IN ('MERGED', 'CANCELED') AND (rs.act <> 'MERGE' OR w.state = 'ACCEPTED') THEN rs.to_ ELSE w.state END, rs.event_id, rs.act, rs.action, w.state, rs.to_,
   coalesce(rs.to_ IS NOT NULL AND w.state NOT IN ('MERGED', 'CANCELED') AND (rs.act <> 'MERGE' OR w.state = 'ACCEPTED'), false) FROM walk w JOIN rs ON rs.patch_id = w.patch_id AND rs.n = w.n + 1)"""


def _reviews(spark, d):
    e = table(spark, d, "events")
    patches = e.where("user_id % 10 > 0").select(F.col("user_id").alias("patch_id"), F.when(F.col("user_id") % 11 == 0, "MERGED").otherwise("PENDING_REVIEW").alias("status")).distinct()
    kind = F.col("event_type")
    action = F.when(kind == "view", "needs_more_evidence").when(kind == "click", None).when(kind == "purchase", "MERGE").when(kind == "signup", F.when(F.col("event_id") % 5 == 0, "CANCEL").otherwise("supersede")).otherwise("fix")
    vote = F.when(kind.isin("click", "error") & (F.col("event_id") % 3 > 0), F.col("event_id") % 3 == 1)
    return patches, e.select(F.col("user_id").alias("patch_id"), "event_id", action.alias("action"), vote.alias("approved"))


@query("patch_review_log", f"WITH RECURSIVE {_REVIEWS} SELECT patch_id, event_id, act AS action, before AS previous_status, CASE WHEN ok THEN to_ END AS new_status, CASE WHEN ok THEN NULL WHEN to_ IS NULL THEN 'Unknown review action: ' || coalesce(action, '') WHEN before IS NULL THEN 'Patch ' || patch_id || ' not found' WHEN before IN ('MERGED', 'CANCELED') THEN 'Cannot review patch in terminal state ' || before ELSE 'Cannot merge patch in state ' || before END AS error FROM walk WHERE n > 0")
def patch_review_log(spark, d):
    """Every review with the status before and after it, or why it was rejected."""
    return gov.review_log(*_reviews(spark, d), ["event_id"])


@query("patch_review_states", f"WITH RECURSIVE {_REVIEWS} SELECT w.patch_id, arg_max(state, n) AS status, count(*) FILTER (WHERE ok) AS reviews, count(*) FILTER (WHERE n > 0 AND NOT ok) AS rejected FROM walk w JOIN pt ON pt.patch_id = w.patch_id GROUP BY 1")
def patch_review_states(spark, d):
    patches, reviews = _reviews(spark, d)
    return gov.patch_states(patches, gov.review_log(patches, reviews, ["event_id"]), ["event_id"])
