"""Queries of evaluation, patches, gates, plans and exports, and a stream's batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.operators import relational as rel
from quillspark.registry import query
from quillspark.sources import sinks
from quillspark.sources import tables as T
from quillspark.sources.tables import table, with_views
from quillspark.streaming import events as stream


@query("eval_score", "SELECT conv_id, turn, CAST(text <> '' AS INT) AS has_answer, CAST(least(turn, 5) AS INT) AS citation_count, CAST(least(length(text) // 50, 3) AS INT) AS answer_quality, CAST(CAST(text <> '' AS INT) * 3 + least(turn, 5) + least(length(text) // 50, 3) AS INT) AS total, text <> '' AND turn > 0 AS passed FROM conversations WHERE role = 'assistant'")
def eval_score(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in R.eval_scores("text", "turn").items()])


_KINDS = ("alias_add", "entity_merge", "citation_fix", "alias_block", "eval_case_candidate", "entity_split")
_RISKS = ("low", "high", "critical", "medium")


def _patches(spark, d):
    e = table(spark, d, "events")
    pick = lambda ws, c: F.element_at(F.array(*[F.lit(w) for w in ws]), (c % len(ws) + 1).cast("int"))
    return e.select("event_id", "ts", "event_type", pick(_KINDS, F.col("event_id")).alias("kind"), pick(_RISKS, F.col("user_id")).alias("risk"), (F.col("event_id") % 3).alias("evidence"), (F.col("user_id") % 2).alias("target"))


_PATCHES = "patches AS (SELECT event_id, ts, event_type, (['alias_add', 'entity_merge', 'citation_fix', 'alias_block', 'eval_case_candidate', 'entity_split'])[CAST(event_id % 6 AS INT) + 1] AS kind, (['low', 'high', 'critical', 'medium'])[CAST(user_id % 4 AS INT) + 1] AS risk, event_id % 3 AS evidence, user_id % 2 AS target FROM events)"


@query("patch_validate", f"""WITH {_PATCHES}, e AS (SELECT *, list_filter([CASE WHEN evidence < 1 THEN 'evidence missing' END, CASE WHEN kind IN ('alias_add', 'alias_block', 'entity_split', 'entity_merge') AND risk NOT IN ('high', 'critical') THEN 'risk too low: high or critical' END,
 CASE WHEN kind IN ('entity_split', 'entity_merge') AND risk <> 'critical' THEN 'risk too low: critical' END, CASE WHEN kind IN ('entity_split', 'entity_merge') AND target = 0 THEN 'target missing' END], lambda x: x IS NOT NULL) AS errors FROM patches)
SELECT event_id, errors, CASE WHEN len(errors) > 0 THEN 'REJECTED' WHEN kind IN ('entity_split', 'entity_merge') THEN 'PROPOSED' ELSE 'PENDING_REVIEW' END AS status FROM e""")
def patch_validate(spark, d):
    p = _patches(spark, d).withColumn("errors", R.patch_errors("kind", "risk", "evidence", "target"))
    return p.select("event_id", "errors", F.when(F.size("errors") > 0, "REJECTED").when(F.col("kind").isin("entity_split", "entity_merge"), "PROPOSED").otherwise("PENDING_REVIEW").alias("status"))


@query("patch_latest_status", with_views("tasks") + "SELECT chapter_number AS patch_id, arg_max(status, (ts, event_id)) AS status, count(*) AS reviews, coalesce(bool_or(phase = 'purchase'), false) AS terminal FROM tasks GROUP BY 1")
def patch_latest_status(spark, d):
    t = T.tasks(spark, d)
    return t.groupBy(F.col("chapter_number").alias("patch_id")).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("reviews"), F.bool_or(F.col("phase") == "purchase").alias("terminal"))


@query("verify_citations", "SELECT user_id, CAST(sum(CASE WHEN event_type NOT IN ('view', 'click') AND event_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS checked FROM events GROUP BY 1")
def verify_citations(spark, d):
    kind = F.when(F.col("event_type") == "view", "entity").when(F.col("event_type") == "click", "event").otherwise("chunk")
    i = F.array(F.struct(kind.alias("source_type"), (F.col("event_id") % 4).alias("source_id"), F.when(F.col("event_id") % 5 == 0, "").otherwise("x").alias("excerpt")))
    e = table(spark, d, "events").withColumn("items", i)
    return e.groupBy("user_id").agg(F.sum(F.size(R.citation_errors("items"))).cast("long").alias("errors"), F.count(F.lit(1)).alias("checked"))


@query("stage_gate", "SELECT event_id, CASE WHEN event_type = 'view' THEN false WHEN user_id % 4 = 0 OR event_type = 'purchase' THEN true ELSE false END AS allowed FROM events")
def stage_gate(spark, d):
    e = table(spark, d, "events").withColumn("s3", F.when(F.col("event_type") == "view", "SUCCESS").otherwise("PENDING")).withColumn("s2", F.when(F.col("user_id") % 4 == 0, "SUCCESS").otherwise("RUNNING")).withColumn("o", F.col("event_type") == "purchase")
    return e.select("event_id", R.stage_gate("s2", "s3", "o").alias("allowed"))


@query("final_status", "SELECT event_id, CASE WHEN user_id % 3 > 0 AND event_id % 2 = 0 THEN 'FAILED' WHEN event_id % 2 = 0 AND event_id % 5 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'RESPONDED' END AS status FROM events")
def final_status(spark, d):
    return table(spark, d, "events").select("event_id", R.final_status(F.col("user_id") % 3, F.col("event_id") % 2 != 0, F.col("event_id") % 5 != 0).alias("status"))


@query("patch_candidates", "SELECT event_id, list_filter([CASE WHEN event_id % 3 = 0 THEN 'citation_fix' END, CASE WHEN event_type = 'error' OR user_id % 2 = 0 THEN 'eval_case_candidate' END], lambda x: x IS NOT NULL) AS patches FROM events")
def patch_candidates(spark, d):
    fix = F.when(F.col("event_id") % 3 == 0, F.lit("citation_fix"))
    case = F.when((F.col("event_type") == "error") | (F.col("user_id") % 2 == 0), F.lit("eval_case_candidate"))
    return table(spark, d, "events").select("event_id", F.filter(F.array(fix, case), lambda x: x.isNotNull()).alias("patches"))


@query("plan_effects", with_views("chapters", "chunks") + "SELECT c.book, s.step, s.danger, CASE s.step WHEN 'split' THEN c.n ELSE k.n END AS effect FROM (SELECT book, count(*) AS n FROM chapters GROUP BY 1) c JOIN (SELECT book, count(*) AS n FROM chunks GROUP BY 1) k USING (book), (SELECT unnest(['split', 'extract', 'index']) AS step, unnest([false, true, false]) AS danger) s")
def plan_effects(spark, d):
    n = rel.counts_of({"chapters": T.chapters(spark, d), "chunks": T.chunks(spark, d)}, "book")
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(x).alias("danger"), F.col(c).alias("effect")) for s, x, c in (("split", False, "chapters"), ("extract", True, "chunks"), ("index", False, "chunks"))])
    return n.select("book", F.explode(steps).alias("s")).select("book", "s.*")


@query("export_chapter_facts", "SELECT doc_id, 'Extract the facts of ' || source AS instruction, text AS input, lang AS output FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def export_chapter_facts(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return sinks.instructions(table(spark, d, "documents").join(good, "doc_id"), F.concat(F.lit("Extract the facts of "), "source"), F.col("text"), F.col("lang"), ["doc_id"])


@query("export_qa_pairs", """WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, role FROM conversations),
 e AS (SELECT conv_id, string_agg(DISTINCT role, ' ||| ' ORDER BY role) AS evidence FROM conversations GROUP BY 1) SELECT conv_id, turn, text AS question, answer, evidence FROM q LEFT JOIN e USING (conv_id) WHERE role = 'user' AND next = 'assistant'""")
def export_qa_pairs(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = c.withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' AND next = 'assistant'")
    e = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), " ||| ").alias("evidence"))
    return q.join(e, "conv_id", "left").select("conv_id", "turn", F.col("text").alias("question"), "answer", "evidence")


@query("confirm_token", "SELECT DISTINCT event_type, left(sha256('7|' || event_type || '|DONE'), 16) AS token FROM events")
def confirm_token(spark, d):
    return table(spark, d, "events").select("event_type", R.confirm_token(F.lit(7), "event_type", F.lit("DONE")).alias("token")).distinct()


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    return stream.sessions(table(spark, d, "events"))
