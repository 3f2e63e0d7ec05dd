"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

size of a document: its words [^\\x20\\x09-\\x0D]+ (0 for null).  Sources by code point, null last, have the weights
WEIGHTS in turn and share SHARE of all sizes.  A source's target stops at CAP times its size; what is above is
shared by weight among the others until none is above.  That end is found in closed form: sources sorted by
cap / weight, the clamped ones come first, and the first source whose level fits ends them.

Sampling: with r = target / source size, each document is taken floor(r) times whole.  The rest of the target is one
more repetition of the first documents in a seeded order; only the document on the boundary is taken in part (its
first words), so a source's taken words differ from its target by rounding alone and no document exceeds CAP times
its size.  The boundary is found in two steps, so no task orders a whole source: sums by 16**BUCKET_DIGITS hash ranges, then
the running sum inside the one range that holds the boundary.  Reruns agree: order is a hash of seed and row.

Repeated rows count once each; ties in the seeded order are broken by id and size.  Documents without words take 0.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Cuts

WEIGHTS, SHARE, CAP, SEED, BUCKET_DIGITS = (3, 1, 2), 1.5, 2.0, 17, 3
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with its target: one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    w = w.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("end", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return w.select("source", "source_size", F.when(F.col("end").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("end") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' rows as (id, size, source_size, target, taken, *keep); taken: words the mix takes, repeats counted."""
    cuts = Cuts(docs.sparkSession)
    kept = [f"k_{c}" for c in keep]
    rows = docs.select(F.col(id_col).alias("_id"), n_words(text_col).alias("size"), F.col(source_col).alias("source"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    sized = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    sized = sized.withColumn("bucket", F.conv(F.substring("h", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    if not keep:
        sized = cuts.cut(sized)  # read again below: words are counted once
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = cuts.cut(sums)
    goal = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("long"))
    goal = goal.withColumn("extra", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))
    goal = cuts.cut(goal)
    few = goal.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda x: x)
    g = lambda: goal.select(F.col("source").alias("g_source"), *[c for c in goal.columns if c != "source"])
    run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    edges = sums.withColumn("before", run).join(small(g()), F.col("source").eqNullSafe(F.col("g_source")))
    edge = edges.where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("n") > F.col("extra"))).select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), F.col("before").alias("e_before"))
    goal = cuts.cut(g().join(edge, F.col("g_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"))
    at = sized.join(small(goal), F.col("source").eqNullSafe(F.col("g_source")))
    # the running sum inside the one range of each source that holds the boundary
    inside = at.where(F.col("bucket") == F.col("e_bucket"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("h", "_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    part = inside.withColumn("before", F.col("e_before") + F.coalesce(running, F.lit(0)))
    part = part.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("before"))))
    rest = at.where(~F.col("bucket").eqNullSafe(F.col("e_bucket"))).withColumn("more", F.when(F.col("e_bucket").isNull() | (F.col("bucket") < F.col("e_bucket")), F.col("size")).otherwise(F.lit(0)))
    rest = rest.withColumn("more", F.when(F.col("extra") > 0, F.col("more")).otherwise(F.lit(0)))
    cols = ["_id", "size", "source_size", "target", "whole", "more", *kept]
    out = rest.select(*cols, "source").unionByName(part.select(*cols, "source"))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"), F.col("source").alias("mix_source"), F.col("whole").alias("whole_repeats"), F.col("more").cast("long").alias("part_words"), *kept)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """docs' rows as often as the mix takes them, all columns kept; the part of a repetition is the text's first words."""
    cols = docs.columns
    m = mix(docs, id_col, text_col, source_col, keep=tuple(cols), **kw)
    whole = F.when(F.col("whole_repeats") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col("whole_repeats").cast("int"))).otherwise(F.array().cast("array<long>"))
    more = F.when(F.col("part_words") >= F.greatest("size", F.lit(1)), F.array(F.lit(-1).cast("long"))).when(F.col("part_words") > 0, F.array("part_words")).otherwise(F.array().cast("array<long>"))
    rows = m.withColumn("_part", F.explode(F.concat(whole, more)))
    text = F.col(f"k_{text_col}")
    first = F.array_join(F.slice(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != ""), F.lit(1), F.col("_part").cast("int")), " ")
    return rows.select(*[F.when(F.col("_part") > 0, first).otherwise(text).alias(c) if c == text_col else F.col(f"k_{c}").alias(c) for c in cols])
