"""Names that are one: decisions by rules and hints, profiles; change sets of quality stages; reviews of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions import vocabulary as V
from quillspark.operators import graph
from quillspark.operators import relational as rel
from quillspark.sources.keyed import KeyedTable
from quillspark.sources.sinks import checkpointed


def decisions(mentions: DataFrame, hints: DataFrame, on: str = "book", chapter: str = "chapter_id") -> DataFrame:
    """MERGE decisions on pairs of names of one chapter, by rules, then by hints (book, name, alias) in either direction.

    Only pairs that can be merged are looked at: names an edit apart, a name and the same with a title, hinted pairs.
    A hint turns any other decision into MERGE, at a confidence of at least 0.7.
    """
    m = mentions.select(on, chapter, "name").distinct()
    by_rule = rel.near_pairs(m, chapter).unionByName(rel.titled_pairs(m, list(V.MERGE_TITLES), chapter))
    books = m.select(on, chapter).distinct()
    h = hints.where("name <> alias").select(on, F.least("name", "alias").alias("name_a"), F.greatest("name", "alias").alias("name_b")).distinct().withColumn("hinted", F.lit(True))
    hinted = h.join(m.select(on, chapter, F.col("name").alias("name_a")), [on, "name_a"]).join(m.select(on, chapter, F.col("name").alias("name_b")), [on, chapter, "name_b"])
    pairs = by_rule.join(books, chapter).select(on, "name_a", "name_b").unionByName(hinted.select(on, "name_a", "name_b")).distinct()
    decision, confidence = R.alias_decision("name_a", "name_b")
    said = pairs.withColumn("by_rule", decision).withColumn("sure", confidence).join(h, [on, "name_a", "name_b"], "left").withColumn("hinted", F.coalesce("hinted", F.lit(False)))
    turned = F.col("hinted") & (F.col("by_rule") != "MERGE")
    out = said.where((F.col("by_rule") == "MERGE") | F.col("hinted"))
    return out.select(on, "name_a", "name_b", F.lit("MERGE").alias("decision"), F.when(turned, F.greatest("sure", F.lit(0.7))).otherwise(F.col("sure")).alias("confidence"), "by_rule", "hinted")


def profiles(mentions: DataFrame, merges: DataFrame, on: str = "book", chapter: str = "chapter_id") -> DataFrame:
    """Greedy profiles of all names: canonical name, aliases, chapters, mentions."""
    own = graph.direct_clusters(merges, mentions.select(on, "name"), on)
    m = mentions.groupBy(on, "name").agg(F.count(F.lit(1)).alias("n"), F.min(chapter).alias("low"), F.max(chapter).alias("high")).join(own, [on, "name"])
    p = m.groupBy(on, "canonical").agg(F.array_sort(F.collect_list(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"), F.sum("n").alias("mention_count"), F.min("low").alias("first_chapter"), F.max("high").alias("last_chapter"))
    return p.withColumnRenamed("canonical", "name")


# --- change sets: (stage, table, id, column, before, after), reported or applied


def _changes(rows: DataFrame, stage: str, table: str, column: str, before: Column, after: Column) -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), F.lit(table).alias("name"), F.col("id").cast("long").alias("id"), F.lit(column).alias("column"), before.cast("string").alias("before"), after.cast("string").alias("after"))


def name_changes(facts: DataFrame, profiles_: DataFrame, on: str = "book", skip: tuple = ("", "未知", "无")) -> DataFrame:
    """Ends of active facts (id, book, source, target, type, status) by exact aliases.  Of facts whose key (book, source,
    target, type) would be the same, one that has it already stays, else the smallest id; the others become MERGED and
    keep their names."""
    known = profiles_.select(on, F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "name")
    known = known.where(~F.trim("alias").isin(*skip)).groupBy(on, F.trim("alias").alias("alias")).agg(F.coalesce(F.max(F.when(F.trim("alias") == F.col("name"), F.col("name"))), F.max("name")).alias("name"))
    end = lambda c: known.select(on, F.col("alias").alias(c), F.col("name").alias(f"_{c}"))
    new = facts.join(end("source"), [on, "source"], "left").join(end("target"), [on, "target"], "left")
    active = F.col("status") == "ACTIVE"
    new = new.withColumn("_source", F.when(active, F.coalesce("_source", "source")).otherwise(F.col("source"))).withColumn("_target", F.when(active, F.coalesce("_target", "target")).otherwise(F.col("target")))
    same = (F.col("_source") == F.col("source")) & (F.col("_target") == F.col("target"))
    key = [on, "_source", "_target", "type"]
    stays = new.groupBy(*key).agg(F.min(F.struct((~same).alias("moved"), "id"))["id"].alias("_stays"))
    moved = checkpointed(new.where(~same).join(stays, key).select("id", "source", "target", "_source", "_target", (F.col("_stays") != F.col("id")).alias("clash")))
    parts = [_changes(moved.where(f"NOT clash AND _{c} <> {c}"), "names", "relation_fact", c, F.col(c), F.col(f"_{c}")) for c in ("source", "target")]
    return parts[0].unionByName(parts[1]).unionByName(_changes(moved.where("clash"), "names", "relation_fact", "status", F.lit("ACTIVE"), F.lit("MERGED")))


def dedup_changes(facts: DataFrame, on: str = "book") -> DataFrame:
    """Of active facts of one type between the same two names, in either direction, the most confident stays active."""
    active = facts.where("status = 'ACTIVE'").select("id", "type", on, "confidence", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
    key = [on, "type", "lo", "hi"]
    best = active.groupBy(*key).agg(F.max(F.struct("confidence", (-F.col("id")).alias("minus")))["minus"].alias("minus"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _changes(active.join(best, key).where("id <> -minus"), "relations", "relation_fact", "status", F.lit("ACTIVE"), F.lit("MERGED"))


def summary_changes(events: DataFrame, most: int = 60) -> DataFrame:
    """Events (id, type, description, summary) without a summary get the start of their description, else their type."""
    told = F.coalesce(F.nullif(F.left(F.trim("description"), F.lit(most)), F.lit("")), F.col("type"))
    return _changes(events.where(rel.blank("summary") & told.isNotNull()), "summaries", "event_fact", "summary", F.col("summary"), told)


def changed(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of table that a change set touches, as they are after it."""
    some = changes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("column", "after"))).alias("_after"))
    kinds = dict(table.dtypes)
    j = table.join(some, "id")
    return j.select(*[F.col(c) if c == "id" else F.when(F.map_contains_key("_after", F.lit(c)), F.element_at("_after", F.lit(c)).cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in table.columns])


def quality(facts: KeyedTable, events: KeyedTable, profiles_: DataFrame, dry_run: bool = True) -> DataFrame:
    """The quality stages in order: names, relations, summaries.  A dry run reports the change set and writes nothing;
    the second stage then sees the facts as the first would leave them."""
    named = checkpointed(name_changes(facts.read(), profiles_))
    after = facts.read()
    after = changed(after, named).unionByName(after.join(named.select("id").distinct(), "id", "left_anti").select(*after.columns))
    merged, told = checkpointed(dedup_changes(after)), checkpointed(summary_changes(events.read()))
    if not dry_run:
        for table, set_ in ((facts, named), (facts, merged), (events, told)):
            table.upsert(changed(table.read(), set_))
    return named.unionByName(merged).unionByName(told)


# --- reviews of patches

ACTIONS = {"ACCEPT": "ACCEPTED", "REJECT": "REJECTED", "NEEDS_MORE_EVIDENCE": "NEEDS_MORE_EVIDENCE", "SUPERSEDE": "SUPERSEDED"}
TERMINAL = {"MERGE": "MERGED", "CANCEL": "CANCELED"}


def review_log(patches: DataFrame, reviews: DataFrame, order: list[str]) -> DataFrame:
    """Reviews (patch_id, action, approved, order) of patches (patch_id, status), each with what became of it.

    An action, or without one the vote, sets the status; merging takes an accepted patch, merging and canceling are
    terminal: after them nothing is legal.  Gives action, previous_status, new_status (null where rejected) and error.
    """
    acts = {**ACTIONS, **TERMINAL}
    said = F.upper(F.coalesce("action", F.lit("")))
    action = F.when(said.isin(*acts), said).when(F.col("approved"), "ACCEPT").when(~F.col("approved"), "REJECT").otherwise("REVIEW")
    to = F.element_at(F.create_map(*[F.lit(x) for kv in acts.items() for x in kv]), F.col("act"))
    r = reviews.withColumn("act", action).withColumn("to", F.when(F.col("act").isin(*acts), to))
    r = rel.last_before(r.withColumn("_plain", F.when(F.col("act").isin(*ACTIONS), F.col("to"))), ["patch_id"], order, "_plain", "_last")
    r = r.join(patches.select("patch_id", F.col("status").alias("_start")), "patch_id", "left").withColumn("_before", F.coalesce("_last", "_start"))
    ends = (F.col("act") == "CANCEL") | (F.col("act") == "MERGE") & (F.col("_before") == "ACCEPTED")
    at = F.struct(*order)
    first = r.where(ends & F.col("_start").isNotNull() & ~F.col("_start").isin(*TERMINAL.values())).groupBy("patch_id").agg(F.min(F.struct(at.alias("at"), "to")).alias("_end"))
    r = r.join(first, "patch_id", "left")
    over = F.coalesce(at > F.col("_end.at"), F.lit(False))
    now = F.when(F.col("_start").isin(*TERMINAL.values()), F.col("_start")).when(over, F.col("_end.to")).when(F.col("_start").isNotNull(), F.col("_before"))
    error = (
        F.when(F.col("to").isNull(), F.concat(F.lit("Unknown review action: "), F.coalesce("action", F.lit("")))).when(F.col("_start").isNull(), F.concat(F.lit("Patch "), F.col("patch_id").cast("string"), F.lit(" not found")))
        .when(now.isin(*TERMINAL.values()), F.concat(F.lit("Cannot review patch in terminal state "), now)).when((F.col("act") == "MERGE") & (now != "ACCEPTED"), F.concat(F.lit("Cannot merge patch in state "), now))
    )
    return r.withColumn("error", error).select("patch_id", *order, F.col("act").alias("action"), now.alias("previous_status"), F.when(F.col("error").isNull(), F.col("to")).alias("new_status"), "error")


def patch_states(patches: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """patches with the status that their log leaves, reviews that counted and those rejected."""
    n = log.groupBy("patch_id").agg(F.max_by("new_status", F.when(F.col("new_status").isNotNull(), F.struct(*order))).alias("_new"), F.count("new_status").alias("reviews"), F.count("error").alias("rejected"))
    return patches.join(n, "patch_id", "left").select("patch_id", F.coalesce("_new", "status").alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("reviews", "rejected")])
