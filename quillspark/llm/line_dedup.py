"""Line dedup in DataFrame functions alone: range-partitioned line hashes, streamed, give keep bitmaps of documents.

A text (null or empty: one empty line) is split at \\n.  A line's key is the line without [\\x20\\x09-\\x0D] at both ends,
A-Z lower-cased.  Keys of at least MIN_CHARS code points that stand in at least MIN_DOCS documents lose all their lines
but those of the largest id that holds them; every other line stays.

`keep_bitmaps`: only hashes travel.  Lines of long keys become (hash, id, position), partitioned by ranges of the hash and
sorted in each range by hash, id from the largest, and position.  One pass over a range sees a key's first document,
which stays, and numbers the later ones; where there are enough of these, their lines go.  What goes is gathered as
64-line words of a bitmap: a bit that is set stays, words without a loss are not stored, nor documents without one.
A hash that holds much of the table (HOT of a range in a sample of documents, at most 1/HOT keys a range, whatever the
data) is cut into as many runs as there are ranges, by id: each run gives its count of documents and its largest id,
their sum and maximum come back by broadcast to the runs.  The sample decides where rows lie, never what becomes of them.
`line_dedup` lays the bitmaps on the texts.

Hashes are 128 bits wide.  A document is its id: rows of one id count as one document, a missing id is one as well and is
smaller than every other.  Bitmaps are by id and text, so rows of one id may differ, and repeated rows get the same.
An empty table gives an empty result; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Cuts, partitions

MIN_CHARS, MIN_DOCS = 40, 5
#: A key is hot from this share of an average range on; it is looked for in one of SAMPLE documents.
HOT, SAMPLE = 0.25, 32
BLANKS = " \t\n\x0b\x0c\r"
_NONE = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _identity(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("_id"), F.xxhash64(text).alias("_text")]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_id, _text, words array<struct<word int, keep long>>, n_dropped) of the documents that lose lines."""
    cuts, ranges = Cuts(docs.sparkSession), partitions(docs.sparkSession)
    line = docs.select(*_identity(id_col, text_col), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = line.select("_id", "_text", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    rows = cuts.cut(key.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "_id", "_text", "pos"))

    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(SAMPLE)) == 0)
    often = drawn.count() * HOT / ranges
    hot = drawn.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(often, min_docs)).select("h1", "h2", F.lit(True).alias("hot"))
    hot = F.broadcast(cuts.cut(hot))  # at most ranges / HOT keys
    placed = rows.join(hot, ["h1", "h2"], "left").withColumn("run", F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(4), "_id"), F.lit(ranges)).cast("int")).otherwise(F.lit(-1)))
    ranged = placed.drop("hot").repartitionByRange(ranges, "h1", "h2", "run").sortWithinPartitions("h1", "h2", "run", F.col("_id").desc(), "pos")

    order = Window.partitionBy("h1", "h2", "run").orderBy(F.col("_id").desc())
    seen = ranged.withColumn("nth", F.dense_rank().over(order)).withColumn("first", F.first("_id").over(order))
    seen = seen.withColumn("docs", F.last("nth").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seen = cuts.cut(seen.where((F.col("run") >= 0) | (F.col("nth") > 1) & (F.col("docs") >= min_docs)))
    cuts.drop(rows)
    of_hot = seen.where("run >= 0")
    runs = of_hot.groupBy("h1", "h2", "run").agg(F.max("docs").alias("docs"), F.max("first").alias("first"))
    keys = runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("first").alias("top")).where(F.col("docs") >= min_docs).select("h1", "h2", "top")
    keys = F.broadcast(keys)  # no more than hot keys
    at = ["_id", "_text", "pos"]
    gone = seen.where("run < 0").select(*at).unionByName(of_hot.join(keys, ["h1", "h2"]).where("_id < top").select(*at))

    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("_id", "_text", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("lost"))
    return words.groupBy("_id", "_text").agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("keep")))).alias("words"), F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row a document: id, n_lines (before), n_dropped, kept_text; the bitmaps laid on the texts."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.col(id_col).alias("_own"), *_identity(id_col, text_col), lines_of(F.col(text_col)).alias("lines"))
    both = rows.join(maps, ["_id", "_text"], "left").withColumn("n_lines", F.size("lines").cast("long"))
    lost = F.flatten(F.transform("words", lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w["keep"], b) == 0), lambda b: w["word"] * 64 + b)))
    both = both.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), lost))
    text = F.array_join(F.when(F.col("words").isNull(), F.col("lines")).otherwise(F.transform("kept", lambda i: F.get("lines", i))), "\n")
    return both.select(F.col("_own").alias(id_col), "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))
