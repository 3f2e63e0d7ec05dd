"""Filters, joins, aggregates, windows and set operations of the knowledge base, over all books at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.sinks import checkpointed


# --- predicates


def contains_ci(col: str, word: str) -> Column:
    """Substring test without regard to case; the word is taken literally."""
    return F.lower(F.col(col)).contains(word.lower())


def any_contains(array: str, word: str) -> Column:
    return F.exists(array, lambda a: a.contains(F.lit(word)))


def either_pair(a: str, b: str, left: str = "source", right: str = "target") -> Column:
    """A pair in either direction."""
    return ((F.col(left) == a) & (F.col(right) == b)) | ((F.col(left) == b) & (F.col(right) == a))


def bounds(values: list) -> tuple[int, int] | None:
    """Chapter bounds: positive integers only; one is a point, of more the first two count."""
    good = [v for v in values if isinstance(v, int) and v > 0][:2]
    return (min(good), max(good)) if good else None


def in_bounds(col: str, values: list) -> Column:
    b = bounds(values)
    return F.lit(True) if b is None else F.col(col).between(*b)


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Optional filters: those that are None are not asked for."""
    return reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def blank(col: str) -> Column:
    return F.col(col).isNull() | (F.col(col) == "")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


# --- keep-first, keep-best, last n


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order (a window, so that the order decides)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# --- writes as functions of tables


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """base and delta with the last row of each key by seq."""
    return latest(base.unionByName(delta), keys, [seq])


def sparse_update(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that delta has and that are not null there replace those of base."""
    changed = [c for c in delta.columns if c not in keys]
    d = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in changed])
    return base.join(d, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def delete_by(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def null_if_not_positive(df: DataFrame, *cols: str) -> DataFrame:
    """Foreign keys of 0 and less are no keys."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in cols})


# --- joins


def count_onto(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left with the number of right's rows of its key, 0 where there are none: counted before the join."""
    n = right.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    return left.join(n, on, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def name_pairs(mentions: DataFrame, group: str = "chapter_id", name: str = "name") -> DataFrame:
    """Unordered pairs of different names of one group."""
    d = mentions.select(group, name).distinct()
    return d.select(group, F.col(name).alias("name_a")).join(d.select(group, F.col(name).alias("name_b")), group).where("name_a < name_b")


def near_pairs(mentions: DataFrame, group: str = "chapter_id", name: str = "name") -> DataFrame:
    """The pairs of name_pairs at an edit distance of at most 1, without comparing every two names.

    Such names are equal once each has lost at most one letter, so they meet in an equi-join; what meets is verified.
    """
    n = F.col("name")
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(n), F.lit(1))), lambda i: F.concat(F.left(n, i - 1), F.substring(n, i + 1, F.char_length(n))))
    d = mentions.select(group, F.col(name).alias("name")).distinct().select(group, "name", F.explode(F.array_distinct(F.array_append(short, n))).alias("_k"))
    met = d.select(group, "_k", F.col("name").alias("name_a")).join(d.select(group, "_k", F.col("name").alias("name_b")), [group, "_k"])
    return met.where("name_a < name_b").select(group, "name_a", "name_b").distinct().where(F.levenshtein("name_a", "name_b", 1) >= 0)


def titled_pairs(mentions: DataFrame, titles: list[str], group: str = "chapter_id", name: str = "name") -> DataFrame:
    """The pairs of name_pairs of which one holds the other and ends in a title where the other's length ends.

    A name with a title holds at most len(title) + 1 stems of that length; stems meet names in an equi-join.
    """
    d = mentions.select(group, F.col(name).alias("name")).distinct()
    n = F.char_length("name")

    def stems(t: str):
        parts = F.transform(F.sequence(F.lit(1), F.lit(len(t) + 1)), lambda i: F.substring(F.col("name"), i, n - len(t)))
        return F.when(F.col("name").endswith(t) & (n > len(t)), parts)

    long_ = d.select(group, F.col("name").alias("_long"), F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*map(stems, titles)))))).alias("name"))
    met = long_.join(d, [group, "name"]).where("name <> _long")
    return met.select(group, F.least("name", "_long").alias("name_a"), F.greatest("name", "_long").alias("name_b")).distinct()


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the last value (not null) before each row of its key, in order; a key may hold all rows.

    Rows are dealt by ranges of (keys, order) and kept so in a table; a window works within a range, and what a range
    leaves to the next of the same key, one row a range, is sent along.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tails = ranged.groupBy(*keys, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(across)).where("_carry IS NOT NULL")
    carried = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_carry")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = ranged.withColumn("_near", F.last(value, ignorenulls=True).over(inside)).join(F.broadcast(carried), same, "left")  # a key and range: at most two keys a range
    return both.select(*df.columns, F.coalesce("_near", "_carry").alias(out))


def cooccurring(mentions: DataFrame, group: list[str], first: int = 10) -> DataFrame:
    """Pairs of names of one chunk: each of the first names with every later one, each unordered pair once."""
    a = mentions.where(F.col("pos") < first).select(*group, F.col("pos").alias("i"), F.col("name").alias("source"))
    b = mentions.select(*group, F.col("pos").alias("j"), F.col("name").alias("target"))
    p = a.join(b, group).where("i < j AND source <> target").withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    best = p.groupBy(*group, "lo", "hi").agg(F.min(F.struct("i", "j", "source", "target")).alias("p"))
    return best.select(*group, "p.source", "p.target")


def overlapping(stages: DataFrame, entities: DataFrame, on: list[str], most: int = 10) -> DataFrame:
    """Entities whose span of chapters meets a stage's, the most mentioned of each stage."""
    j = stages.join(entities, on).where("first_chapter <= end_chapter AND last_chapter >= start_chapter")
    n = F.row_number().over(Window.partitionBy(*on, "stage_index").orderBy(F.desc("mention_count"), "name"))
    return j.withColumn("rank", n).where(F.col("rank") <= most)


# --- windows


def rank_fusion(hits: DataFrame, weights: dict[str, float], k: int, top: int, query: str = "query_id") -> DataFrame:
    """Weighted reciprocal rank fusion of hits (query, list, source, id, score): score = sum of w(source) / (k + rank)."""
    rank = F.row_number().over(Window.partitionBy(query, "list").orderBy(F.desc("score"), "source", "id")) - 1
    default = weights.get("*", 0.5)
    w = reduce(lambda c, kv: F.when(F.col("source") == kv[0], F.lit(kv[1])).otherwise(c), [x for x in weights.items() if x[0] != "*"], F.lit(default))
    fused = hits.withColumn("part", w / (F.lit(float(k)) + rank)).groupBy(query, "source", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    n = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "source", "id"))
    return fused.withColumn("rank", n.cast("int")).where(F.col("rank") <= top)


def diversify(df: DataFrame, group: str, score: str, top: int, per_group: int = 2, query: str = "query_id", tie: str = "id") -> DataFrame:
    """At most per_group of each group in score order; what is over fills up to top."""
    n = F.row_number().over(Window.partitionBy(query, group).orderBy(F.desc(score), tie))
    r = F.row_number().over(Window.partitionBy(query).orderBy(F.col("_n") > per_group, F.desc(score), tie))
    return df.withColumn("_n", n).withColumn("rank", r.cast("int")).where(F.col("rank") <= top).drop("_n")


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Gaps and islands: of each key the longest run of rows that have the flag, rows and flagged rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_i", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    runs = marked.groupBy(*keys, "_i").agg(F.sum(F.col(flag).cast("long")).alias("_run"), F.count(F.lit(1)).alias("_rows"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest"), F.sum("_rows").alias("rows"), F.sum("_run").alias("flagged"))


def previous(df: DataFrame, keys: list[str], order: list[str], col: str, when: Column) -> Column:
    """The last value before the row, of rows where `when` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(when, F.col(col)), ignorenulls=True).over(w)


def counts_of(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with the number of its rows in each table, 0 where it has none."""
    tagged = [t.select(F.col(key), F.lit(n).alias("_t")) for n, t in tables.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy(key).agg(*[F.count(F.when(F.col("_t") == n, 1)).alias(n) for n in tables])
