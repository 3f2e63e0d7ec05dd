"""Reading tables and uploads, and the corpus views that the queries run on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(df: DataFrame, keys: Column, columns: list[str]) -> DataFrame:
    """Point or foreign-key lookup: the filter and the columns reach the Parquet scan."""
    return df.where(keys).select(*columns)


def _decode(raw: bytes) -> str:
    for encoding in ("utf-8", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("gbk", "replace")


@F.pandas_udf(StringType())
def decode_text(raw: pd.Series) -> pd.Series:
    """UTF-8, else GB18030, else GBK with replacement characters."""
    return raw.map(_decode)


def upload(spark: SparkSession, path: str, book: Column | None = None) -> DataFrame:
    """Files of a folder as one text a book: sorted by name, decoded, a blank line after each.

    book: from the column `path` (default: all files are one book).
    """
    files = spark.read.format("binaryFile").load(path).select("path", decode_text("content").alias("text"))
    files = files.withColumn("book", book if book is not None else F.lit("book"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "text")))
    return files.groupBy("book").agg(F.concat_ws("", F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n\n")))).alias("text"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the chapters of their sources."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("book"), number.alias("chapter_number"), "text", "lang")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("book"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


NAME = "[A-Z][a-z]{4,}"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of five letters and more as the names that chunks mention."""
    c = chunks(spark, sf_dir)
    return c.select("chapter_id", "book", "chunk_index", F.posexplode(F.regexp_extract_all("content", F.lit(f"({NAME})"), 1)).alias("pos", "name"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as relation mentions of suppliers and parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 5).alias("book"), F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("source"), F.concat(F.lit("P"), (F.col("l_partkey") % 20).cast("string")).alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("polarity"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").alias("seq"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the runs of pipeline tasks: the kind of event is the status."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "PENDING").otherwise("SUCCESS")
    return e.select("event_id", (F.col("user_id") % 50).alias("book"), (F.col("event_id") % 40).cast("int").alias("chapter_number"), (F.col("user_id") % 7).cast("int").alias("retry_count"), F.col("event_type").alias("phase"), status.alias("status"), "ts", "value")


#: The same views for the queries' SQL.
SQL = {
    "chapters": "chapters AS (SELECT doc_id AS chapter_id, source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS chapter_number, text, lang FROM documents)",
    "chunks": "chunks AS (SELECT chapter_id, book, CAST(i - 1 AS BIGINT) AS chunk_index, l[i] AS content FROM (SELECT doc_id AS chapter_id, source AS book, string_split(text, chr(10)) AS l FROM documents) s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))",
    "mentions": f"mentions AS (SELECT chapter_id, book, chunk_index, CAST(i - 1 AS INT) AS pos, n[i] AS name FROM (SELECT chapter_id, book, chunk_index, regexp_extract_all(content, '{NAME}') AS n FROM chunks) s, LATERAL (SELECT unnest(range(1, len(n) + 1)) AS i))",
    "relations": "relations AS (SELECT l_suppkey % 5 AS book, 'S' || (l_suppkey % 20) AS source, 'P' || (l_partkey % 20) AS target, l_returnflag AS type, l_linestatus AS polarity, l_discount AS confidence, l_orderkey AS chapter_id, l_linenumber AS seq FROM lineitem)",
    "tasks": "tasks AS (SELECT event_id, user_id % 50 AS book, CAST(event_id % 40 AS INT) AS chapter_number, CAST(user_id % 7 AS INT) AS retry_count, event_type AS phase, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'click' THEN 'PENDING' ELSE 'SUCCESS' END AS status, ts, value FROM events)",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
