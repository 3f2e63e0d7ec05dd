"""Candidates, rule extraction and chapter facts, by column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions import vocabulary as V


def term_frequency(df: DataFrame, keys: list[str], text: str, word: str, least: int = 2, top: int = 20) -> DataFrame:
    """Words of each key that occur often, most frequent first."""
    return frequent(df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(f"({word})"), 1)).alias("term")), keys, "term", least, top)


def frequent(df: DataFrame, keys: list[str], term: str, least: int = 2, top: int = 20) -> DataFrame:
    t = df.groupBy(*keys, F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return t.withColumn("rank", n.cast("int")).where(F.col("rank") <= top)


def candidates(df: DataFrame, keys: list[str], text: str, word: str, suffixes: Sequence[str] = V.ENTITY_SUFFIXES, dialogue: Sequence[str] = V.DIALOGUE_PATTERNS, chars: str = "一-鿿", most: int = 30, words: DataFrame | None = None) -> DataFrame:
    """Candidate names of each chunk: frequent words, names with a title, speakers; by frequency, then code point.

    words: (keys, word) of texts without blanks, as segmentation gives them; without it words are matches of `word`.
    """
    found = [F.regexp_extract_all(text, F.lit(f"([{chars}]{{1,4}}(?:{'|'.join(suffixes)}))"), 1)] if suffixes else []
    found += [F.regexp_extract_all(text, F.lit(p), 1) for p in dialogue]
    other = df.select(*keys, F.explode(F.concat(*found)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n")) if found else None
    every = (frequent(words.where(F.char_length("word") >= 2), keys, "word") if words is not None else term_frequency(df, keys, text, word)).select(*keys, "term", "n")
    every = every.unionByName(other) if other is not None else every
    best = every.groupBy(*keys, "term").agg(F.max("n").alias("n"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return best.withColumn("rank", n.cast("int")).where(F.col("rank") <= most)


def entity_kind(name: str | Column, locations: Sequence[str] | Column = (), focus: str | None = None, place_marks: str = "山河洞国寺谷岭海湖岛州城", item_marks: str = "棒杖刀剑枪鞭环索扇旗幡珠瓶塔") -> tuple[Column, Column, Column]:
    """(type, role, confidence) of a candidate name; locations: a list, or an array column."""
    n = F.col(name) if isinstance(name, str) else name
    place = n.rlike(f"[{place_marks}]") if focus == "place" else F.lit(False)
    item = n.rlike(f"[{item_marks}]") if focus == "item" else F.lit(False)
    key = F.array_contains(locations, n) if isinstance(locations, Column) else n.isin(*locations) if locations else F.lit(False)
    kind = F.when(key | place, "LOCATION").when(item, "ITEM").otherwise("CHARACTER")
    return kind, F.when(key | place | item, "CANONICAL").otherwise("UNCERTAIN"), F.when(key, 0.6).when(place | item, 0.5).otherwise(0.3)


def relation_of(text: str, source: str, target: str, verbs: Sequence[str] = V.RELATION_VERBS, kinds: dict[str, Sequence[str]] = V.VERB_TYPES) -> dict[str, Column]:
    """Relation of two names of a text by the first verb, in list order, between their first places."""
    i, j = F.instr(F.col(text), F.col(source)), F.instr(F.col(text), F.col(target))
    between = F.substring(F.col(text), F.least(i, j), F.abs(i - j))
    verb = R.first_found(between, verbs)
    kind = F.lit("RELATED_TO")
    for name, words in kinds.items():
        kind = F.when(verb.isin(*words), name).otherwise(kind)
    return {"relation_type": F.coalesce(kind, F.lit("RELATED_TO")), "confidence": F.when(verb.isNotNull(), 0.4).otherwise(0.2), "evidence": F.left(between, F.lit(80))}


def event_of(text: str | Column, name: str | Column, words: Sequence[str] = V.EVENT_WORDS, reach: int = 60) -> dict[str, Column]:
    """Event around a name's first place: the first word of action in its context."""
    text, name = (F.col(c) if isinstance(c, str) else c for c in (text, name))
    at = F.instr(text, name)
    start = F.greatest(at - reach, F.lit(1))
    context = F.substring(text, start, at + F.char_length(name) + reach - start)
    return {"action": R.first_found(context, words), "context": context, "description": F.concat(F.left(context, F.lit(100)), F.when(F.char_length(context) > 100, "…").otherwise("")), "evidence": F.left(context, F.lit(120))}


def chapter_facts(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Characters of a chapter (mentions: name, surface, chunk_index, confidence): the first mention makes the record
    and its evidence id, later ones add surfaces."""
    first = F.min_by(F.struct("chunk_index", "confidence"), F.struct(*order))
    c = m.groupBy(*keys, "name").agg(first.alias("f"), F.min(F.struct(*order)).alias("o"), F.array_sort(F.collect_set("surface")).alias("surfaces"), F.count(F.lit(1)).alias("mentions"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("o")) - 1
    return c.withColumn("evidence_id", F.concat(F.lit("ev_"), F.col("f.chunk_index").cast("string"), F.lit("_"), n.cast("string"))).select(*keys, "name", "surfaces", "mentions", F.col("f.confidence").alias("confidence"), "evidence_id")


def fact_text(summary: str, events: str, names: str, most: int = 1000) -> Column:
    """Text to embed for a fact: its summary, five events, eight names."""
    return F.left(F.concat_ws(" ", F.when(F.col(summary) != "", F.col(summary)), F.concat_ws(" ", F.slice(events, 1, 5)), F.concat_ws(" ", F.slice(names, 1, 8))), F.lit(most))


def index_items(df: DataFrame, key: str, text: str, most: int = 50_000, keep: Sequence[str] = ()) -> DataFrame:
    """Items of a vector index: texts over `most` characters in segments, point ids that keep the chunk's."""
    from quillspark.operators.split import smart_split

    parts = smart_split(df, text, most, keep=[key, *keep])
    return parts.select(key, *keep, (F.col(key) * 10_000 + F.col("split_index")).alias("point_id"), "split_index", F.left("content", F.lit(200)).alias("preview"), F.char_length("content").alias("size"))
