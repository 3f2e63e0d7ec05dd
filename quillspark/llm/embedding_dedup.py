"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors are compared only where labels are equal and not null (and their lengths are).  A vector that is null, empty,
zero or holds null or non-finite components links with nothing and is its own component.  Two vectors link when their
cosine, in double precision, is at least the threshold.

Equal vectors are one class.  The classes of a label are dealt by hash to blocks of about BLOCK, and each pair of
blocks is a tile, so a label of any size becomes more tiles, none larger.  In a tile unit vectors are quantised,
u = s q + r with q of int8: |u.v - s t (q.p)| <= |r| + (1 + |r|) |r'|, where the residuals' norms are those measured.
The integer products are exact (in float32 lanes, at most 1024 components at a time).  Only pairs whose product plus
bound reaches the threshold are recomputed in double precision.  A tile emits one row for each class with a link: the
number of vectors it links with there and the smallest class of its component, never pairs.

Repeated rows are vectors of one class; the empty table gives an empty result; a missing id sorts after every other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, Cuts, components, forest, lookup_join

BLOCK = 2048
#: Covers rounding in the bound itself: far above that of double sums, far below the bound.
SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and norm of the residual of each row."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    r = u - s[:, None] * q
    return q.astype(np.int8), s, np.sqrt((r * r).sum(axis=1))


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: every partial sum fits the 24 bits of a float32."""
    total = None
    for k in range(0, p.shape[1], 1024):
        part = (p[:, k : k + 1024].astype(np.float32) @ q[:, k : k + 1024].astype(np.float32).T).astype(np.float64)
        total = part if total is None else total + part
    return total


def tile(u: np.ndarray, v: np.ndarray, threshold: float, same: bool, step: int = 512):
    """Linked positions (i, j) of two blocks, those with i < j if they are the same; yields arrays."""
    p, s, r = quantise(u)
    q, t, e = (p, s, r) if same else quantise(v)
    for a in range(0, len(u), step):
        b = a if same else 0
        near = products(p[a : a + step], q[b:]) * s[a : a + step, None] * t[None, b:]
        near += r[a : a + step, None] + (1 + r[a : a + step, None]) * e[None, b:]
        i, j = np.nonzero(near >= threshold - SLACK)
        i, j = i + a, j + b
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            yes = (u[x] * v[y]).sum(axis=1) >= threshold
            yield x[yes], y[yes]


def _tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = int(pdf["b1"].iloc[0]) == int(pdf["b2"].iloc[0])
        one = pdf if same else pdf[pdf["side"] == 0]
        two = one if same else pdf[pdf["side"] == 1]
        out = pd.DataFrame({"cid": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if not len(one) or not len(two):
            return out
        u = unit(np.stack([np.asarray(x, np.float64) for x in one["vec"]]))
        v = u if same else unit(np.stack([np.asarray(x, np.float64) for x in two["vec"]]))
        m, n = one["n"].to_numpy(), two["n"].to_numpy()
        ids1, ids2 = one["cid"].to_numpy(), two["cid"].to_numpy()
        count1, count2 = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
        a, root = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, j in tile(u, v, threshold, same):
            np.add.at(count1, i, n[j])
            np.add.at(count1 if same else count2, j, m[i])
            if len(i):
                a, root = forest(np.concatenate([a, ids1[i]]), np.concatenate([root, ids2[j]]))
        ids = ids1 if same else np.concatenate([ids1, ids2])
        count = count1 if same else np.concatenate([count1, count2])
        at = pd.Series(root, index=a)
        some = count > 0
        return pd.DataFrame({"cid": ids[some], "links": count[some], "root": at.reindex(ids[some]).fillna(pd.Series(ids[some], index=ids[some])).astype(np.int64).to_numpy()})

    return run


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable by links, itself included), kept."""
    cuts = Cuts(rows.sparkSession)
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    good = F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
    key = F.concat_ws(":", F.xxhash64(F.lit(1), F.col(vec_col)), F.xxhash64(F.lit(2), F.col(vec_col)), F.col(label_col).cast("string"))
    base = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.when(good, key).otherwise(F.concat(F.lit("!"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"), good.alias("good"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    ids = cuts.cut(base.select("_id", "key"))
    classes = base.where("good").groupBy("key").agg(F.min("_id").alias("cid"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = cuts.cut(classes.withColumn("dim", F.size("vec")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    sides = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("label", "dim", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), (F.col("b") > F.col("o")).cast("int").alias("side"), "cid", "n", "vec")
    found = cuts.cut(sides.groupBy("label", "dim", "b1", "b2").applyInPandas(_tile(threshold), "cid long, links long, root long"))
    comp = components(cuts, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = classes.select("key", "cid", "n").join(linked, "cid", "left").join(comp, F.col("cid") == F.col("id"), "left")
    of_class = cuts.cut(of_class.select("key", F.col("n").alias("size"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    out = lookup_join(ids, of_class, "key", "size").withColumn("component", F.coalesce("component", "_id"))
    nul = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(nul("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), nul("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))
