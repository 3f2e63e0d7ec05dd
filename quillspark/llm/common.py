"""What the training-data operators share: tables that cut lineage, hot keys, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing integer id inside an operator: it sorts after every other id.
NO_ID = 2**63 - 1
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); an own one only where that is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        where = _own_dir[0]
    return where.rstrip("/")


class Cuts:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quill-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            if path := self.paths.pop(id(df), None):
                jvm = self.spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lookup_join(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """rows left join groups (one row a key), safe against hot keys.

    A group that holds at least 1/share of all grouped rows is hot; there are at most `share` of these,
    so that much and no more is broadcast.  Rows of hot keys get a key of their own for the shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    value = [c for c in groups.columns if c != key]
    if not total:
        return rows.join(groups, key, "left")
    hot = groups.where(F.col(size) * share >= total).select(F.col(key).alias("_hk"), F.struct(*value).alias("_hot"))
    cold = groups.select(F.col(key).alias("_ck"), F.struct(*value).alias("_cold"))
    kind = rows.schema[key].dataType
    spread = F.when(F.col("_hk").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")).cast(kind)) if kind.simpleString() in ("string", "binary") else F.when(F.col("_hk").isNull(), F.col(key)).otherwise(-1 - F.monotonically_increasing_id())
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn("_jk", spread)
    out = marked.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return out.select(*rows.columns, *[F.when(F.col("_hk").isNotNull(), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in value])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node but the smallest ones: a spanning forest of stars."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    kept = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[kept], nodes[label[kept]]


def _local_forest(batches):
    """Folds a partition's edges into a forest, 200,000 at a time: never more than nodes + one batch in memory."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting, n = [], 0
    for df in batches:
        waiting.append(df)
        n += len(df)
        if n >= max(200_000, len(a)):
            a, b = forest(np.concatenate([a, *(x.a.to_numpy() for x in waiting)]), np.concatenate([b, *(x.b.to_numpy() for x in waiting)]))
            waiting, n = [], 0
            if len(a) > 1_000_000:  # this much goes out as it is, the rest starts anew
                yield pd.DataFrame({"a": a, "b": b})
                a, b = a[:0], b[:0]
    if waiting:
        a, b = forest(np.concatenate([a, *(x.a.to_numpy() for x in waiting)]), np.concatenate([b, *(x.b.to_numpy() for x in waiting)]))
    if len(a):
        yield pd.DataFrame({"a": a, "b": b})


def components(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a long, b long): component is the smallest id reachable.

    Contraction: each node hooks onto its smallest smaller neighbour, pointers jump to the roots, the edges
    are renamed to the roots and the round repeats until no edge is left.  Partitions first shrink their own
    edges to a forest.  Nodes without an edge are not returned.
    """
    spark = cuts.spark
    e = cuts.cut(edges.where("a <> b").select("a", "b").mapInPandas(_local_forest, "a long, b long"))
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        f = cuts.cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")))
        while True:
            up = f.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
            jumped = f.join(up, F.col("root") == F.col("_id")).select("id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved"))
            g = cuts.cut(jumped)
            cuts.drop(f)
            f = g.select("id", "root")
            cuts.paths[id(f)] = cuts.paths.pop(id(g))
            if g.where("moved").isEmpty():
                break
        maps.append(f)
        ra, rb = f.select(F.col("id").alias("a"), F.col("root").alias("ra")), f.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        left = e.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = cuts.cut(left)
        cuts.drop(e)
        e = nxt
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps[0]
    for m in maps[1:]:
        m = m.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        out = out.join(m, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    return out.withColumnRenamed("root", "component")
