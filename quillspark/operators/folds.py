"""Accumulating upserts as folds over ordered mentions: recomputed, so running them again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.keyed import KeyedTable

IMPORTANCE = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def importance_rank(col: str) -> Column:
    """Unknown importance ranks as MEDIUM."""
    out = F.lit(2)
    for i, name in enumerate(IMPORTANCE, 1):
        out = F.when(F.col(col) == name, F.lit(i)).otherwise(out)
    return out


#: Rows further back than this weigh nothing in a double: 2**-1100 is 0.
DEEP = 1100


def halvings(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The step of the fold (acc + x) / 2 over a key's rows, in order, as one map acc -> acc / 2**n + b.

    Gives keys, n (DEEP at most: beyond, acc weighs nothing), b and the first value.  Each row weighs half of the one
    after it, so only the last DEEP of a key count: the window drops the others before anything is shuffled.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    deep = df.withColumn("_back", back).where(F.col("_back") <= DEEP)
    return deep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.pow(F.lit(0.5), "_back")).alias("b"), F.max_by(value, "_back").alias("first"))


def halved(before: Column, n: str = "n", b: str = "b", first: str = "first") -> Column:
    """A map of `halvings` applied to the value before; where there is none the first value is the start."""
    left = F.pow(F.lit(0.5), F.col(n))
    return F.when(F.col(n) >= DEEP, F.col(b)).otherwise(F.col(b) + F.coalesce(before, F.col(first)) * left)


def halving_average(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The fold (acc + x) / 2 over rows in order, from the first row on."""
    return halvings(df, keys, order, value).select(*keys, halved(F.lit(None).cast("double")).alias(value))


class RelationFacts:
    """Relation facts kept up batch by batch, as accumulating upserts do: strength adds up, confidence is halved towards
    each new mention, polarity and first chapter stay, the last chapter moves on.

    A batch's mentions of a key become one map, whatever their number; a batch with a number is counted once.
    """

    def __init__(self, table: KeyedTable, order: list[str]):
        self.table, self.order = table, order

    def add(self, mentions: DataFrame, number: int | None = None) -> bool:
        keys = self.table.keys
        step = _spans(mentions, keys, self.order).join(halvings(mentions, keys, self.order, "confidence"), keys)
        old = self.table.read().select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("strength", "polarity", "first_chapter", "last_chapter", "confidence")])
        new = step.join(old, keys, "left").select(
            *keys, (F.coalesce("o_strength", F.lit(0)) + F.col("strength")).alias("strength"), F.coalesce("o_polarity", "polarity").alias("polarity"),
            F.coalesce("o_first_chapter", "first_chapter").alias("first_chapter"), F.greatest("o_last_chapter", "last_chapter").alias("last_chapter"), halved(F.col("o_confidence")).alias("confidence"),
        )
        return self.table.upsert(new, number=number)


def _spans(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    first = F.struct(*order)
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("strength"), F.min_by("polarity", first).alias("polarity"), F.min_by("chapter_id", first).alias("first_chapter"), F.max("chapter_id").alias("last_chapter"))


def relation_facts(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Relation mentions to facts: strength counts, confidence folds, polarity is the first, chapters span."""
    return _spans(m, keys, order).join(halving_average(m, keys, order, "confidence"), keys)


def entity_profiles(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Mentions (chapter_id, n, description) to profiles: counts add, chapters span, the last non-empty description."""
    last = F.max_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.struct(*order)))
    return m.groupBy(*keys).agg(F.sum("n").alias("mention_count"), F.min("chapter_id").alias("first_chapter"), F.max("chapter_id").alias("last_chapter"), last.alias("description"))


def event_facts(m: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Event mentions to facts: highest importance (the first of equals), first participants, chapters span."""
    top = F.max_by("importance", F.struct(importance_rank("importance"), *[-F.col(c) for c in order]))
    return m.groupBy(*keys).agg(top.alias("importance"), F.min_by("participants", F.struct(*order)).alias("participants"), F.min("chapter_id").alias("first_chapter"), F.max("chapter_id").alias("last_chapter"))


def first_distinct_joined(df: DataFrame, keys: list[str], order: list[str], text: str, n: int = 5, sep: str = "；") -> DataFrame:
    """The first n different texts of each key in order, joined: cut to n before they are gathered."""
    once = df.groupBy(*keys, text).agg(F.min(F.struct(*order)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
    few = once.withColumn("_r", rank).where(F.col("_r") <= n)
    return few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]), sep).alias(text))


def relation_dedup(df: DataFrame, keys: list[str], id_col: str, evidence: str, confidence: str) -> DataFrame:
    """Symmetric duplicates: of each (keys, sorted pair) the most confident stays with all evidence, others MERGED."""
    pair = [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]
    d = df.select("*", *pair)
    w = Window.partitionBy(*keys, "lo", "hi")
    n = F.row_number().over(w.orderBy(F.desc(confidence), id_col))
    all_evidence = d.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias("_all"))
    out = d.withColumn("_n", n).join(all_evidence, [*keys, "lo", "hi"])
    return out.withColumn("status", F.when(F.col("_n") == 1, "ACTIVE").otherwise("MERGED")).withColumn(evidence, F.when(F.col("_n") == 1, F.col("_all")).otherwise(F.col(evidence))).drop("_n", "_all", "lo", "hi")
