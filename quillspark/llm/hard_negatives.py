"""Hard negatives by anchor-clustered shared lists: candidates sorted once a cluster by an upper bound of their scores.

Rows with a null label, a null vector or a null or non-finite component take no part.  Where the id is divisible by
SHIFT, the label first becomes (label + 1) % 10.  Components x become floor(256 x), x as double; the score of two rows is
their integer inner product.  Higher scores come first, ties by smaller id.  Anchors are rows with an id divisible by
EVERY.  An anchor's positives are its first K other rows of its label; to each of these belong the first K rows of other
labels with LOW * positive <= 100 * score <= 100 * positive.

Anchors are clustered by direction (k-means of a bounded sample of anchors, CLUSTERS centroids).  With b the widest angle
between a centroid c and an anchor of its cluster, a row i scores at most |anchor| |i| cos(max(0, angle(i, c) - b)) with
each of them.  A cluster's list has the rows by that bound, highest first; it is dealt to sub-lists of about BLOCK rows,
and clusters to pieces of about BLOCK anchors, so neither a large cluster nor a common vector makes a large task.  In a
tile (piece and sub-list) the sub-list is sorted once, every anchor walks it, and leaves it when the next bound is below
all that it still needs.  Three walks: a first sub-list, for a floor of each anchor's K-th positive; the others, with
these floors (rows below a cluster's lowest floor are not sent); then negatives, whose floor is known from the positives.
Products and bounds of blocks are numpy; a tile returns at most K rows an anchor, or K for each of its positives.

Components beyond 2**24 are taken as 2**24 (x of 65,536).  Vectors score with those of equal length alone.  Of repeated
anchor ids the smallest (label, vector) is the anchor; other repeated rows are listed as often as they are there.  A
missing id is a row like others, never an anchor, and the last of a tie.  Rows of an anchor's own id are never listed
for it.  Empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, Cuts

K, LOW, EVERY, SHIFT = 5, 80, 100, 7
CLUSTERS, SAMPLE, BLOCK, STEP = 8, 20_000, 4096, 512
LIMIT = 2**24


def _ints(v: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int32) for x in v]).astype(np.float64) if len(v) else np.zeros((0, 0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every partial sum fits 53 bits, else in 64-bit integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _quantised(batches):
    for p in batches:
        q = [np.clip(np.floor(256 * np.asarray(v, np.float64)), -LIMIT, LIMIT).astype(np.int32) for v in p["vec"]]
        yield pd.DataFrame({"id": p["id"], "label": p["label"], "dim": [len(x) for x in q], "q": [x.tobytes() for x in q]})


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows; the first centroids are rows far from one another."""
    c = x[:1]
    near = x @ c[0]
    for _ in range(min(k, len(x)) - 1):
        c = np.vstack([c, x[near.argmin()]])
        near = np.maximum(near, x @ c[-1])
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        n = np.sqrt((s * s).sum(axis=1, keepdims=True))
        c = np.where(n > 0, s / np.where(n > 0, n, 1), c)
    return c


def angles(q: np.ndarray, norm: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((q @ c.T) / np.where(norm > 0, norm, 1)[:, None], -1, 1))


def bounds(angle: np.ndarray, norm: np.ndarray, wide) -> np.ndarray:
    """Upper bounds of the scores with a unit anchor within `wide` of the centroid, rounding covered."""
    b = norm * np.cos(np.maximum(0, angle - wide))
    return b + np.abs(norm) * 1e-9


def first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k first by (score, smaller id)."""
    order = np.lexsort((ids, -score, row))
    r = row[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    nth = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[nth < k]


def _tops(row: np.ndarray, score: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Each row's k-th best score of those given (at most k a row), lowest where there are fewer."""
    out = np.full(rows, np.iinfo(np.int64).min)
    n = np.bincount(row, minlength=rows)
    low = np.full(rows, np.iinfo(np.int64).max)
    np.minimum.at(low, row, score)
    out[n >= k] = low[n >= k]
    return out


def walk(a: pd.DataFrame, c: pd.DataFrame, k: int, low: int, negatives: bool) -> pd.DataFrame:
    """Anchors a (id, label, q, floor, positives) along candidates c (id, label, q, bound): each anchor's hits.

    Hits are (anchor, nth, id, score): nth is the positive's number for negatives, else 0.
    """
    out = {"anchor": [], "nth": [], "id": [], "score": []}
    if not len(a) or not len(c):
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in out})
    c = c.sort_values("bound", ascending=False, kind="stable")  # the list, sorted once for all members
    x, y, bound = _ints(a["q"]), _ints(c["q"]), c["bound"].to_numpy()
    norm = np.sqrt((x * x).sum(axis=1))
    ids, labels, own, mine = c["id"].to_numpy(), c["label"].to_numpy(), a["id"].to_numpy(), a["label"].to_numpy()
    need = a["floor"].to_numpy().astype(np.int64).copy()
    pos = np.stack([np.r_[np.asarray(p, np.int64), np.full(k - len(p), -1)] for p in a["positives"]]) if negatives else None
    least = np.where(pos >= 0, -((-low * pos) // 100), np.iinfo(np.int64).max) if negatives else None  # ceil(low * positive / 100)
    width = k if negatives else 1
    row, score, hit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(y), STEP):
        live = np.flatnonzero(norm * bound[at] + 1e-6 >= need)
        if not len(live):
            break  # certified: nothing further on reaches what any member needs
        s = _scores(x[live], y[at : at + STEP])
        same = mine[live][:, None] == labels[None, at : at + STEP]
        ok = (s >= need[live][:, None]) & (own[live][:, None] != ids[None, at : at + STEP]) & (~same if negatives else same)
        i, j = np.nonzero(ok)
        v, m, w = s[i, j], live[i], ids[at + j]
        if negatives:
            fits = (v[:, None] >= least[m]) & (v[:, None] <= pos[m])
            e, nth = np.nonzero(fits)
            v, m, w = v[e], m[e] * k + nth, w[e]
        row, score, hit = np.r_[row, m], np.r_[score, v], np.r_[hit, w]
        keep = first(row, score, hit, k)
        row, score, hit = row[keep], score[keep], hit[keep]
        kth = _tops(row, score, len(x) * width, k)
        if negatives:  # what an anchor needs is what the neediest of its positives does
            kth = np.where(pos >= 0, np.maximum(kth.reshape(-1, k), least), np.iinfo(np.int64).max).min(axis=1)
        need = np.maximum(need, kth)
    return pd.DataFrame({"anchor": own[row // width], "nth": row % width, "id": hit, "score": score})


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", k: int = K, low: int = LOW, every: int = EVERY, shift: int = SHIFT, block: int = BLOCK, clusters: int = CLUSTERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors and their positives."""
    spark = rows.sparkSession
    cuts = Cuts(spark)
    good = F.col(label_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    vid = F.col(id_col).cast("long")
    label = F.when(vid % shift == 0, (F.col(label_col).cast("long") + 1) % 10).otherwise(F.col(label_col).cast("long"))
    valid = rows.where(good).select(F.coalesce(vid, F.lit(NO_ID)).alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    all_ = cuts.cut(valid.mapInPandas(_quantised, "id long, label long, dim int, q binary"))
    anchors = all_.where((F.col("id") % every == 0) & (F.col("id") != NO_ID)).groupBy("id").agg(F.min(F.struct("label", "dim", "q")).alias("s")).select("id", "s.*")
    anchors = cuts.cut(anchors)
    parts = [r["dim"] for r in anchors.select("dim").distinct().collect()]  # lengths of vectors: one as a rule
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = None
    for dim in parts:
        got = _mine(cuts, all_.where(F.col("dim") == dim), anchors.where(F.col("dim") == dim), k, low, block, clusters)
        out = got if out is None else out.unionByName(got)
    nul = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", nul("positive_id"), "rank", nul("negative_id"), "positive_score", "negative_score")


def _mine(cuts: Cuts, all_: DataFrame, anchors: DataFrame, k: int, low: int, block: int, clusters: int) -> DataFrame:
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("q").toPandas()
    x = _ints(sample["q"])
    norm = np.sqrt((x * x).sum(axis=1))
    x = x[norm > 0] / norm[norm > 0][:, None]
    c = centroids(x, clusters) if len(x) else np.zeros((1, _ints(sample["q"]).shape[1]))

    def place(batches):
        for p in batches:
            q = _ints(p["q"])
            n = np.sqrt((q * q).sum(axis=1))
            t = angles(q, n, c)
            at = t.argmin(axis=1)
            yield pd.DataFrame({"id": p["id"], "label": p["label"], "q": p["q"], "c": at.astype(np.int32), "angle": np.where(n > 0, t[np.arange(len(q)), at], 0.0), "norm": n})

    members = cuts.cut(anchors.select("id", "label", "q").mapInPandas(place, "id long, label long, q binary, c int, angle double, norm double"))
    many = {r["c"]: (r["n"], r["wide"]) for r in members.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("wide")).collect()}
    lists = -(-all_.count() // block)
    wide = np.array([many.get(i, (0, 0.0))[1] for i in range(len(c))])
    pieces = np.array([-(-many.get(i, (0, 0.0))[0] // block) for i in range(len(c))])
    n_pieces = F.element_at(F.array(*[F.lit(int(p)) for p in pieces]), F.col("c") + 1)
    placed = members.withColumn("piece", F.pmod(F.xxhash64("id"), n_pieces).cast("int"))
    listed = all_.withColumn("sub", F.pmod(F.xxhash64("id", "q"), F.lit(lists)).cast("int"))
    none = F.array().cast("array<long>")

    def sent(least: dict[int, float]):
        """Rows with their bound in each cluster's list, once a piece; those below all that a cluster needs stay away."""
        floor = np.array([least.get(i, np.inf) for i in range(len(c))])

        def run(batches):
            for p in batches:
                q = _ints(p["q"])
                n = np.sqrt((q * q).sum(axis=1))
                t = angles(q, n, c)
                for i in np.flatnonzero(pieces):
                    b = bounds(t[:, i], n, wide[i])
                    some = p[b >= floor[i]].assign(c=np.int32(i), bound=b[b >= floor[i]])
                    for piece in range(pieces[i]):
                        yield some.assign(piece=np.int32(piece))[["c", "piece", "sub", "id", "label", "q", "bound"]]

        return run

    def walked(members_: DataFrame, rows: DataFrame, subs, negatives: bool) -> DataFrame:
        """Tiles of pieces and sub-lists.  A bound is a score's over the anchor's norm, so is what clusters need."""
        need = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm") - 1e-6).otherwise(F.lit(float("-inf")))
        least = {r["c"]: r["least"] for r in members_.groupBy("c").agg(F.min(need).alias("least")).collect()}
        right = rows.select("id", "label", "q", "sub").mapInPandas(sent(least), "c int, piece int, sub int, id long, label long, q binary, bound double")
        left = members_.select("c", "piece", "id", "label", "q", "floor", "positives").withColumn("sub", F.explode(F.sequence(F.lit(subs[0]), F.lit(subs[1]))))
        keys = ("c", "piece", "sub")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: walk(a, b, k, low, negatives), "anchor long, nth int, id long, score long")

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    lowest = -(2**63) + 1
    start = placed.withColumn("floor", F.lit(lowest)).withColumn("positives", none)
    hits = cuts.cut(walked(start, listed.where("sub = 0"), (0, 0), False))
    if lists > 1:
        floors = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select(F.col("anchor").alias("id"), "low")
        known = cuts.cut(start.drop("floor").join(floors, "id", "left").withColumn("floor", F.coalesce("low", F.lit(lowest))).drop("low"))
        hits = hits.unionByName(walked(known, listed.where("sub > 0"), (1, lists - 1), False))
    positives = cuts.cut(best(hits).select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    lists_of = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    # a negative score of a positive has no negatives: the range is empty
    asked = placed.join(lists_of.withColumnRenamed("anchor", "id"), "id").withColumn("least", F.array_min(F.filter("positives", lambda p: p >= 0))).where("least IS NOT NULL")
    asked = cuts.cut(asked.withColumn("floor", F.ceil(F.col("least") * low / 100).cast("long") - 1).drop("least"))
    found = best(walked(asked, listed, (0, lists - 1), True))
    found = found.select("anchor", (F.col("nth") + 1).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = found.join(positives.withColumnRenamed("rank", "p"), ["anchor", "p"])
    return both.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
