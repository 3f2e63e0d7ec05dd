"""Work on chapters as a stream: polled folders, a record of every chapter, resuming after a failure.

Files that arrive in a folder are the queue; each micro-batch works the chapters that are not done yet.  A batch's results
go to a folder of its own, overwritten if the batch runs again, and count only once the record of its chapters, a table
in key partitions, has taken that batch's number.  So a run that is killed anywhere can start again with the same
checkpoint: the table is the same, and no chapter that was recorded is worked a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.keyed import KeyedTable
from quillspark.sources.sinks import checkpointed

RETRIES = 3


class Work:
    """work(chapters) returns results with the keys; chapters it returns nothing for, or that `failed` tells of, are FAILED.

    FAILED chapters are tried again when they are offered again, RETRIES times in all.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], key_ddl: str, work: Callable[[DataFrame], DataFrame], failed: Column | None = None, retries: int = RETRIES, buckets: int = 64):
        self.spark, self.path, self.keys, self.work, self.failed, self.retries = spark, path.rstrip("/"), keys, work, failed, retries
        self.record = KeyedTable(spark, f"{self.path}/record", f"{key_ddl}, status string, tries int, batch long", keys, buckets)

    def todo(self, chapters: DataFrame) -> DataFrame:
        """Chapters without a record, and failed ones with tries left."""
        known = self.record.read().select(*self.keys, "status", "tries")
        rows = chapters.dropDuplicates(self.keys).join(known, self.keys, "left")
        return rows.where(F.col("status").isNull() | (F.col("status") == "FAILED") & (F.col("tries") < self.retries)).withColumn("tries", F.coalesce("tries", F.lit(0)) + 1).drop("status")

    def batch(self, chapters: DataFrame, number: int) -> None:
        if self.record._applied(number):
            return
        todo = checkpointed(self.todo(chapters))
        out = f"{self.path}/results/batch={number}"
        self.work(todo.drop("tries")).write.mode("overwrite").parquet(out)
        got = self.spark.read.parquet(out)
        good = (got if self.failed is None else got.where(~self.failed)).select(*self.keys).distinct().withColumn("ok", F.lit(True))
        status = F.when(F.col("ok"), "SUCCESS").otherwise("FAILED")
        done = todo.select(*self.keys, "tries").join(good, self.keys, "left").select(*self.keys, status.alias("status"), "tries", F.lit(number).cast("long").alias("batch"))
        self.record.upsert(done, number=number)

    def results(self) -> DataFrame:
        """Results of the chapters that are done, each from the batch that its record names."""
        good = self.record.read().where("status = 'SUCCESS'").select(*self.keys, "batch")
        if good.isEmpty():
            return self.spark.createDataFrame([], self.record.schema).drop("status", "tries").limit(0)
        batches = sorted(r["batch"] for r in good.select("batch").distinct().collect())
        rows = self.spark.read.option("basePath", f"{self.path}/results").parquet(*[f"{self.path}/results/batch={b}" for b in batches])
        return rows.withColumn("batch", F.col("batch").cast("long")).join(good, [*self.keys, "batch"]).drop("batch")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Runs over a stream of chapters: all that is there (default), or polling with processingTime='5 seconds'."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def poll(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A folder as a queue: so many new files a batch, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
