"""Corpus pipeline: documents in, token ids of the mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  A
stage works on all that its predecessor kept.  run() writes each stage's result as Parquet to the shared folder and
reads it again as the next one's docs.

Null texts and texts without a letter are no language and go with language ID; a null language or source is a value like
others; rows may repeat, with one id or without any, and are told apart in each stage; an empty table gives an empty
result in every stage; other columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, Cuts, table
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.langid import identify
from quillspark.llm.mixing import mixed_documents
from quillspark.llm.queries import PIECES
from quillspark.llm.sentencepieces import encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence stay; null texts and texts without a letter go."""
    cols = docs.columns
    got = identify(docs, keep=tuple(cols))
    return got.where(~F.col("rejected")).select(*[F.col(f"k_{c}").alias(c) for c in cols])


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with an id that no two rows share, and that column's name: doc_id, but for missing and repeated ids.

    Rows of these get numbers from the end of all numbers on, so they come after the others; a table is written then,
    since such numbers must not change.
    """
    row, mark = _fresh(docs, "_row"), _fresh(docs, "_many")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    many = docs.select(key.alias(row)).groupBy(row).agg(F.count(F.lit(1)).alias(mark)).where((F.col(mark) > 1) | (F.col(row) == NO_ID)).select(row)
    keyed = docs.withColumn(row, key)
    if many.isEmpty():
        return keyed, row
    cuts = Cuts(docs.sparkSession)
    many = cuts.cut(many.withColumn(mark, F.lit(True)))
    few = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    return cuts.cut(keyed.join(few, row, "left").withColumn(row, F.when(F.col(mark), NO_ID - 1 - F.monotonically_increasing_id()).otherwise(F.col(row))).drop(mark)), row


def _only(rows: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """Of rows those that kept has, without their number."""
    return rows.join(kept.select(row), row, "left_semi").drop(row)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one stays: that of most characters, of these the smallest id."""
    rows, row = _rows(docs)
    return _only(rows, exact_dedup(rows.select(row, "text"), id_col=row).where("kept"), row).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8) the document of smallest id stays."""
    rows, row = _rows(docs)
    kept = jaccard_components(rows.select(row, "text"), id_col=row, k=5, percent=80)
    return _only(rows, kept.where(F.col(row) == F.col("component_id")), row).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part of a repetition is its first words (the mix asks for so many)."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again to see that nothing is lost."""
    return encode(docs, PIECES)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mixing), ("SentencePiece encoding and decoding", sentencepiece)]

#: Missing and repeated ids up to which they are broadcast; beyond, rows meet them by shuffle.
BROADCAST_IDS = 500_000
#: Language ID and SentencePiece cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cuts.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
