"""Writing tables: JSON lines for training, indexes partitioned by book, appends and idempotent rewrites."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; an own one only in local mode, where one machine has it all."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def instructions(df: DataFrame, instruction: Column, input_: Column, output: Column, keep: list[str]) -> DataFrame:
    """Instruction rows: instruction, input, output and the columns kept as metadata."""
    return df.select(*keep, instruction.alias("instruction"), input_.alias("input"), output.alias("output"))


def write_jsonl(df: DataFrame, path: str, metadata: list[str] = ()) -> None:
    """One JSON object a line; columns of `metadata` go into one object."""
    rest = [c for c in df.columns if c not in metadata]
    df.select(*rest, *([F.struct(*metadata).alias("metadata")] if metadata else [])).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite(df: DataFrame, path: str, by: str = "book", of: DataFrame | None = None) -> None:
    """Replaces the partitions that df has: running it again changes nothing.

    `of` names (in its column `by`) all partitions that are replaced: those that df no longer has are deleted.
    """
    gone = [] if of is None else [r[0] for r in of.select(by).distinct().join(df.select(by).distinct(), by, "left_anti").collect()]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if gone:
        from quillspark.sources.keyed import Files

        files = Files(df.sparkSession, path)
        at = df.sparkSession.read.parquet(path).where(F.col(by).isin(gone)).select(F.regexp_extract(F.input_file_name(), f"/({by}=[^/]*)/[^/]*$", 1)).distinct()
        for r in at.collect():  # folders of partitions
            files.fs.delete(files.jvm.org.apache.hadoop.fs.Path(files.jvm.java.net.URI(f"{path}/{r[0]}")), True)
