"""Rule extraction of whole chunks: candidates with hints, entities, relations, events, and the facts of chapters.

A chunk is one row with its text and at most `MOST` names, so a chunk's names, pairs and events are made in that row: the
text is neither joined nor shuffled again.  Hints are a row a book; candidates meet their chunks by the chunk's key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import vocabulary as V
from quillspark.operators.extract import entity_kind, event_of
from quillspark.sources.sinks import checkpointed

#: Candidates of a chunk that are looked at, names that open a pair, names that have an event, relations kept, participants.
MOST, OPENING, ACTING, RELATIONS, PRESENT = 20, 10, 8, 20, 5
#: What is here of a chunk without candidates, or of a book without hints.
_NONE = "array<string>"


def hints(characters: DataFrame, places: DataFrame, book: str) -> DataFrame:
    """Hints of books, a row each: names, aliases, locations (arrays) and normal (map of an alias or name to its name).

    characters: (book, place, name, aliases array), places: (book, place, name), both in the order of `place`.  Blank and
    null names go; an alias of two names is the first one's, and a name that is an earlier name's alias stays that alias.
    Rows of null book are no hints.  The lists are as long as a book's hints, which a person or a model writes.
    """
    known = lambda c: c.isNotNull() & (c != "")
    c = characters.where(F.col(book).isNotNull() & known(F.col("name")))
    c = c.select(book, F.struct("place", "name", F.filter(F.coalesce("aliases", F.array().cast(_NONE)), known).alias("aliases")).alias("c"))
    c = c.groupBy(book).agg(F.array_sort(F.collect_list("c")).alias("c"))
    c = c.withColumn("pairs", F.flatten(F.transform("c", lambda x: F.concat(F.transform(x["aliases"], lambda a: F.struct(a.alias("key"), x["name"].alias("value"))), F.array(F.struct(x["name"].alias("key"), x["name"].alias("value")))))))
    first = F.filter("pairs", lambda p, i: F.array_position(F.col("pairs.key"), p["key"]) == i + 1)
    c = c.select(book, F.transform("c", lambda x: x["name"]).alias("names"), F.flatten(F.transform("c", lambda x: x["aliases"])).alias("aliases"), F.map_from_entries(first).alias("normal"))
    p = places.where(F.col(book).isNotNull() & known(F.col("name"))).groupBy(book).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("p"))
    return c.join(p.select(book, F.transform("p", lambda x: x["name"]).alias("locations")), book, "full")


def with_hints(cands: str | Column, names: str | Column, aliases: str | Column, locations: str | Column) -> Column:
    """Candidates with a book's hints: names that are none go in front, the last one first, aliases and locations behind.

    A name that is another's alias too stands in front.
    """
    cands, names, aliases, locations = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(_NONE)) for c in (cands, names, aliases, locations))
    return F.array_distinct(F.concat(F.reverse(F.array_except(names, cands)), cands, aliases, locations))


def extracted(chunks: DataFrame, keys: list[str], book: str, text: str, candidates: DataFrame, hint: DataFrame, verbs: Sequence[str] = V.RELATION_VERBS, kinds: dict[str, Sequence[str]] = V.VERB_TYPES, actions: Sequence[str] = V.EVENT_WORDS, focus: str | None = None, **marks: str) -> DataFrame:
    """Chunks (keys) with entities, relations and events, three arrays of structs in the order of the candidates.

    candidates: (keys, term, rank); hint: as `hints` gives.  The first 20 candidates that the text holds are entities.  The
    first ten of their names are paired with every later one, a pair once; 20 relations stay, surer ones first.  The first
    eight names have an event if a word of action stands near.  A null or empty text has three empty arrays, and so has a
    chunk without candidates in a book without hints; a null book has no hints.
    """
    c = candidates.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("_cands"))
    df = chunks.select(*keys, book, F.coalesce(text, F.lit("")).alias("_text")).join(c, keys, "left").join(hint, book, "left")
    found = F.filter(F.slice(with_hints("_cands", "names", "aliases", "locations"), 1, MOST), lambda n: F.contains(F.col("_text"), n))
    df = df.withColumn("_found", found).withColumn("_entities", F.transform("_found", lambda n: _entity(n, focus, marks)))
    df = df.withColumn("_names", F.filter(F.transform("_entities", lambda e: e["name"]), lambda n: F.contains(F.col("_text"), n)))
    df = df.withColumn("_named", F.transform(F.array_distinct("_names"), lambda n: F.struct(n.alias("name"), F.instr(F.col("_text"), n).alias("at"))))
    df = df.withColumn("_relations", _relations("_named", F.size(F.array_distinct(F.slice("_names", 1, OPENING))), "_text", verbs, kinds))
    few = F.when(F.size("_relations") > RELATIONS, F.slice(F.array_sort("_relations"), 1, RELATIONS)).otherwise(F.col("_relations"))
    relations = F.transform(few, lambda r: r.dropFields("less", "at"))
    return df.select(*keys, F.col("_entities").alias("entities"), relations.alias("relations"), _events("_names", "_text", actions).alias("events"))


def _entity(surface: Column, focus: str | None, marks: dict[str, str]) -> Column:
    kind, role, sure = entity_kind(surface, F.coalesce("locations", F.array().cast(_NONE)), focus, **marks)
    normal = F.coalesce(F.when(F.col("normal").isNotNull(), F.try_element_at("normal", surface)), surface)
    return F.struct(surface.alias("surface"), normal.alias("name"), kind.alias("entity_type"), role.alias("role"), sure.cast("double").alias("confidence"))


def _first(words: Sequence[str], text: Column) -> Column:
    return reduce(lambda out, w: F.when(text.contains(w), F.lit(w)).otherwise(out), reversed(words), F.lit(None).cast("string"))


def _relations(named: str, opening: Column, text: str, verbs: Sequence[str], kinds: dict[str, Sequence[str]]) -> Column:
    """A name that occurs twice opens and meets where it occurs first, so pairs are those of distinct names, each once.

    named: the distinct names with their first places; the first `opening` of them open.
    """
    pair = lambda a, i: F.transform(F.slice(named, i + 2, MOST), lambda b: _pair(a, b, F.col(text)))
    pairs = F.flatten(F.transform(F.slice(named, F.lit(1), opening), pair))
    return F.transform(F.transform(pairs, lambda p: p.withField("verb", _first(verbs, p["between"]))), lambda p, i: _relation(p, i, kinds))


def _pair(a: Column, b: Column, text: Column) -> Column:
    return F.struct(a["name"].alias("source"), b["name"].alias("target"), F.substring(text, F.least(a["at"], b["at"]), F.abs(a["at"] - b["at"])).alias("between"))


def _relation(p: Column, at: Column, kinds: dict[str, Sequence[str]]) -> Column:
    kind = reduce(lambda out, kv: F.when(p["verb"].isin(*kv[1]), kv[0]).otherwise(out), kinds.items(), F.lit("RELATED_TO"))
    sure = F.when(p["verb"].isNotNull(), 0.4).otherwise(0.2)
    return F.struct((-sure).alias("less"), at.alias("at"), p["source"].alias("source"), p["target"].alias("target"), kind.alias("relation_type"), sure.alias("confidence"), F.left(p["between"], F.lit(80)).alias("evidence"))


def _events(names: str, text: str, actions: Sequence[str]) -> Column:
    def event(n: Column) -> Column:
        e = event_of(F.col(text), n, actions)
        others = F.filter(F.array_distinct(names), lambda o: (o != n) & F.contains(e["context"], o))
        present = F.slice(F.concat(F.array(n), others), 1, PRESENT)
        return F.struct(F.when(e["action"].isNotNull(), "ACTION").alias("event_type"), n.alias("name"), present.alias("participants"), e["description"].alias("description"), e["evidence"].alias("evidence"), F.lit(0.35).alias("confidence"))

    return F.filter(F.transform(F.slice(names, 1, ACTING), event), lambda e: e["event_type"].isNotNull())


def exploded(x: DataFrame, keys: list[str], part: str, ordinal: str, value: str) -> DataFrame:
    """Rows of an array of `extracted`: keys, ordinal, value.

    The generator is an outer one with a filter behind it: Spark gives an inner one a filter on the array's size, and that
    goes down to the chunks with all of the array's expression, several times over.
    """
    return x.select(*keys, F.posexplode_outer(part).alias(ordinal, value)).where(F.col(ordinal).isNotNull())


def chapter_fact_rows(x: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """Facts of chapters (keys), a row each: (keys, part, chunk, ordinal, name, other, kind, surfaces, text, confidence, evidence_id).

    x: as `extracted` gives, keyed by keys and chunk.  A name's first mention makes its character and the number of its
    evidence, later ones add surfaces, in the order in which they come.  Relations and events are those of all chunks,
    repeats included.  A chapter is rows, not one value, so its length is no bound; surfaces are distinct, partially
    aggregated.
    """
    at, x = [*keys, chunk], checkpointed(x)  # three parts are read from it
    e = exploded(x, at, "entities", "ordinal", "e").select(*at, "ordinal", "e.*")
    seen = e.groupBy(*keys, "name", "surface").agg(F.min(F.struct(chunk, "ordinal", "confidence")).alias("first"))
    c = seen.groupBy(*keys, "name").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "surface"))).alias("s"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first", "name")) - 1
    c = c.withColumn("n", number).select(
        *keys, F.lit("character").alias("part"), F.col(f"first.{chunk}").alias(chunk), F.col("n").alias("ordinal"), "name", F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("kind"),
        F.transform("s", lambda v: v["surface"]).alias("surfaces"), F.lit(None).cast("string").alias("text"), F.col("first.confidence").alias("confidence"), F.concat(F.lit("ev_"), F.col(f"first.{chunk}").cast("string"), F.lit("_"), F.col("n").cast("string")).alias("evidence_id"),
    )
    r = exploded(x, at, "relations", "ordinal", "r").select(
        *keys, F.lit("relation").alias("part"), chunk, "ordinal", F.col("r.source").alias("name"), F.col("r.target").alias("other"), F.col("r.relation_type").alias("kind"),
        F.lit(None).cast(_NONE).alias("surfaces"), F.col("r.evidence").alias("text"), F.col("r.confidence").alias("confidence"), F.lit(None).cast("string").alias("evidence_id"),
    )
    v = exploded(x, at, "events", "ordinal", "v").select(
        *keys, F.lit("event").alias("part"), chunk, "ordinal", F.col("v.name").alias("name"), F.lit(None).cast("string").alias("other"), F.col("v.event_type").alias("kind"),
        F.col("v.participants").alias("surfaces"), F.col("v.description").alias("text"), F.col("v.confidence").alias("confidence"), F.lit(None).cast("string").alias("evidence_id"),
    )
    return c.unionByName(r).unionByName(v)
