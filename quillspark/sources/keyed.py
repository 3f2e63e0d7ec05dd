"""Tables in hash partitions of their keys: an upsert or a delete rewrites the partitions it touches and no others.

New partitions are written beside the table first; once all are there, a note says which partitions they replace, and
they are renamed into place.  Whoever opens the table next ends a change whose note is there and drops one without, so
a change that was cut off is either whole or not there.  A change with a number (a micro-batch) is applied once.
One writer at a time; a reader during a change may have to read again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKET = "kb"


class Files:
    """The few calls on files that a table needs, on whatever store Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} was not renamed to {b}")

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def write(self, p: str, text: str) -> None:
        """Written under another name, then renamed: it is there whole or not at all."""
        draft = f"{p}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(p)
        self.rename(draft, p)

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength() if self.exists(p) else 0


class KeyedTable:
    """One row a key.  `buckets` is fixed when the table is first written: about table size / 128 MB."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, self.path)
        self._finish()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        at = f"{self.path}/data"
        if not self.files.names(at):
            return self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(at)

    def upsert(self, rows: DataFrame, order: list[str] = (), number: int | None = None) -> bool:
        """Rows replace those of their keys; with `order`, of each key the last of old and new stays (else any new one).
        False if this number was applied before."""
        if self._applied(number):
            return False
        new = rows.select(*self.schema.names)
        buckets = self._touched(new)
        old = self._stored().where(F.col(BUCKET).isin(buckets)).drop(BUCKET)
        if order:
            both = old.unionByName(new)
            whole = F.max_by(F.struct(*both.columns), F.struct(*order))
        else:
            both = old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new)
            whole = F.max(F.struct(*both.columns))
        merged = both.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)]).agg(whole.alias("r")).select("r.*")
        return self._replace(merged, buckets, number)

    def delete(self, keys: DataFrame, number: int | None = None) -> bool:
        """Rows whose keys are there go."""
        if self._applied(number):
            return False
        gone = keys.select(*self.keys).distinct()
        buckets = self._touched(gone)
        left = self._stored().where(F.col(BUCKET).isin(buckets)).drop(BUCKET).join(gone, self.keys, "left_anti")
        return self._replace(left, buckets, number)

    def delete_where(self, condition: Column, number: int | None = None) -> bool:
        """Delete by filter; a partition that loses all its rows goes as well."""
        return self.delete(self.read().where(condition), number)

    def update(self, change) -> None:
        """All partitions anew, through change(DataFrame)."""
        self._replace(change(self.read()).select(*self.schema.names), list(range(self.buckets)), None)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most `buckets`

    def _applied(self, number: int | None) -> bool:
        return number is not None and self.files.exists(f"{self.path}/applied/{number}")

    def _replace(self, rows: DataFrame, buckets: list[int], number: int | None) -> bool:
        if buckets:
            stage = f"{self.path}/stage"
            self.files.delete(stage)
            # a bucket of many rows is written by several tasks, so no task grows with the table
            rows.select("*", self.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{stage}/data")
            written = {n for n in self.files.names(f"{stage}/data") if n.startswith(BUCKET)}
            empty = [f"{BUCKET}={b}" for b in buckets if f"{BUCKET}={b}" not in written]
            self.files.write(f"{stage}/note", json.dumps({"empty": empty, "number": number}))
        elif number is not None:
            self.files.write(f"{self.path}/applied/{number}", "")
        self._finish()
        return True

    def _finish(self) -> None:
        """Renames what a change has written into place; what a change without a note has written is dropped."""
        stage = f"{self.path}/stage"
        if self.files.exists(f"{stage}/note"):
            note = json.loads(self.files.read(f"{stage}/note"))
            self.files.fs.mkdirs(self.files.path(f"{self.path}/data"))
            for name in note["empty"]:
                self.files.delete(f"{self.path}/data/{name}")
            for name in self.files.names(f"{stage}/data"):
                if name.startswith(BUCKET):
                    self.files.delete(f"{self.path}/data/{name}")
                    self.files.rename(f"{stage}/data/{name}", f"{self.path}/data/{name}")
            if note["number"] is not None:
                self.files.write(f"{self.path}/applied/{note['number']}", "")
        self.files.delete(stage)


class Key:
    """A foreign key: rows of `child` belong to rows of `parent`."""

    def __init__(self, child: str, columns: list[str], parent: str, parent_columns: list[str] | None = None):
        self.child, self.columns, self.parent, self.parent_columns = child, columns, parent, parent_columns or columns


def cascade(tables: dict[str, KeyedTable], keys: list[Key], root: str, condition: Column) -> dict[str, int]:
    """Deletes rows of `root` and all that belongs to them, down the graph of foreign keys, children first.

    Key sets go down by semi-joins; each table's are written before anything is deleted, so that a cascade cut off
    midway can be run again: parents are still there to say what is left.  Returns the rows deleted of each table.
    """
    from quillspark.sources.sinks import checkpointed

    order: list[str] = []

    def down(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"foreign keys go round: {' > '.join((*path, name))}")
        for k in keys:
            if k.parent == name:
                down(k.child, (*path, name))
        if name not in order:
            order.append(name)

    down(root, ())
    doomed: dict[str, DataFrame] = {root: checkpointed(tables[root].read().where(condition))}
    for name in reversed(order):
        if name == root:
            continue
        rows = tables[name].read()
        parts = [rows.join(doomed[k.parent].select(*[F.col(p).alias(c) for c, p in zip(k.columns, k.parent_columns, strict=True)]).distinct(), k.columns, "left_semi").select(*rows.columns) for k in keys if k.child == name and k.parent in doomed]
        doomed[name] = checkpointed(reduce(DataFrame.unionByName, parts).distinct())
    out = {}
    for name in order:
        out[name] = doomed[name].count()
        tables[name].delete(doomed[name])
    return out
