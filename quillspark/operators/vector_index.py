"""An inverted-file index of vectors with payload: centroids, lists by cell and book, tombstones.

Centroids come from k-means of a bounded sample (SAMPLE rows, chosen by hash).  A vector lies in the list of its nearest
centroid; lists are partitioned by cell and by a hash of the book, sorted by book, so a search within a book reads that
book's shelf alone.  Every write is a commit: rows of unchanged vectors are not written again, changed and deleted ones
get a tombstone in the shelf where the old row lies, and a commit counts only once its mark is there.  `compact`
rewrites the lists without the dead.

Search goes through the `probes` cells nearest to each query, as matrix products of query blocks and Arrow batches.  With
exact=True a second walk visits every cell that can still hold a better vector: with c its centroid and r the widest
angle of a vector in it, a cosine is at most cos(max(0, angle(q, c) - r)).  Cells are split by hash into pieces of about
PIECE rows, so a cell of equal vectors is no large task.  Null and zero vectors are not indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.keyed import Files, KeyedTable
from quillspark.sources.sinks import checkpointed

SAMPLE, SHELVES, PIECE = 20_000, 16, 16_384
#: Queries of a tile, and those that are multiplied at once: a tile's scores are AT_ONCE x PIECE numbers.
QUERIES, AT_ONCE = 8_192, 64


def unit_rows(v) -> np.ndarray:
    x = np.stack([np.asarray(a, np.float64) for a in v]) if len(v) else np.zeros((0, 1))
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        n = np.sqrt((s * s).sum(axis=1, keepdims=True))
        c = np.where(n > 0, s / np.where(n > 0, n, 1), c)
    return c


def usable(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


class VectorIndex:
    """Rows (id long, book, vector array<float or double>, payload columns); `payload` is their DDL."""

    def __init__(self, spark: SparkSession, path: str, book: str = "int", payload: str = "", shelves: int = SHELVES, buckets: int = 64):
        self.shelves = shelves  # fixed, as are the buckets, when the index is first written
        self.spark, self.path, self.book = spark, path.rstrip("/"), book
        self.files = Files(spark, self.path)
        self.columns = ["id", "book", "vector", *[p.split()[0] for p in payload.split(",") if p.strip()]]
        self.ddl = f"id long, book {book}, vector array<double>" + (f", {payload}" if payload else "")
        self.ids = KeyedTable(spark, f"{self.path}/ids", f"id long, book {book}, cell int, shelf int, commit int, hash long", ["id"], buckets)
        self.centroids = np.array(spark.read.parquet(f"{self.path}/centroids").orderBy("cell").toPandas()["c"].tolist()) if self.files.exists(f"{self.path}/centroids/_SUCCESS") else None
        for commit in self._commits():  # what was cut off between a commit and its note
            if not self.files.exists(f"{self.path}/ids/applied/{2 * commit + 1}"):
                self._note(commit)

    # --- writing

    def fit(self, rows: DataFrame, cells: int) -> None:
        some = rows.where(usable("vector")).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        c = kmeans(unit_rows(some["vector"]), cells)
        self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        self.centroids = c

    def _commits(self) -> list[int]:
        all_ = sorted(int(n) for n in self.files.names(f"{self.path}/commits") if n.isdigit())
        whole = int(self.files.read(f"{self.path}/whole")) if self.files.exists(f"{self.path}/whole") else 0
        return [n for n in all_ if n >= whole] if whole in all_ else all_

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of their ids (the ids of rows must differ); returns how many rows were written."""
        commit, c = max(self._commits(), default=0) + 1, self.centroids
        shelf = F.pmod(F.xxhash64("book"), F.lit(self.shelves)).cast("int")
        new = rows.where(usable("vector")).select(*[F.col(n).cast("array<double>").alias(n) if n == "vector" else F.col(n) for n in self.columns]).withColumn("hash", F.xxhash64(*self.columns))
        known = self.ids.read().select("id", F.col("book").alias("o_book"), F.col("cell").alias("o_cell"), F.col("shelf").alias("o_shelf"), F.col("commit").alias("o_commit"), F.col("hash").alias("o_hash"))
        moved = new.join(known, "id", "left").where(~F.col("hash").eqNullSafe(F.col("o_hash"))).withColumn("shelf", shelf)

        def near(batches):
            for p in batches:
                cos = unit_rows(p["vector"]) @ c.T
                p["cell"] = cos.argmax(axis=1).astype(np.int32)
                p["angle"] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
                yield p

        at = ", ".join(f"{n} {t}" for n, t in moved.dtypes)
        placed = checkpointed(moved.mapInPandas(near, f"{at}, cell int, angle double"))
        live = placed.select(*self.columns, "hash", "angle", "cell", "shelf")
        self._write(live, "lists", commit)
        dead = placed.where("o_commit IS NOT NULL").select("id", F.col("o_commit").alias("dead"), F.col("o_cell").alias("cell"), F.col("o_shelf").alias("shelf"))
        self._write(dead, "dead", commit)
        self.files.write(f"{self.path}/commits/{commit}", "")
        self._note(commit)
        return placed.count()

    def delete(self, condition: Column) -> int:
        """Delete by filter on id, book and where a row lies; returns how many rows went."""
        commit = max(self._commits(), default=0) + 1
        gone = checkpointed(self.ids.read().where(condition))
        self._write(gone.select("id", F.col("commit").alias("dead"), "cell", "shelf"), "dead", commit)
        self.files.write(f"{self.path}/commits/{commit}", "")
        self._note(commit)
        return gone.count()

    def _note(self, commit: int) -> None:
        """The table of ids follows a commit, once: the dead leave, the new and changed come."""
        dead = self._stored("dead", "id long, dead int", [commit]).select("id", F.col("dead").alias("commit"))
        self.ids.delete(self.ids.read().join(dead, ["id", "commit"], "left_semi"), number=2 * commit)
        self.ids.upsert(self._stored("lists", f"{self.ddl}, hash long, angle double", [commit]), number=2 * commit + 1)

    def _write(self, rows: DataFrame, what: str, commit: int) -> None:
        """A commit that runs again overwrites what it had left."""
        order = ["cell", "shelf", *(["book"] if "book" in rows.columns else []), "id"]
        rows.repartition("cell", "shelf").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("cell", "shelf").parquet(f"{self.path}/{what}/commit={commit}")

    def _stored(self, what: str, ddl: str, commits: list[int] | None = None) -> DataFrame:
        there = [f"{self.path}/{what}/commit={n}" for n in (self._commits() if commits is None else commits) if any("=" in x for x in self.files.names(f"{self.path}/{what}/commit={n}"))]
        schema = f"{ddl}, commit int, cell int, shelf int"
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*there)

    def rows(self) -> DataFrame:
        """Live rows with angle, commit, cell and shelf: those without a tombstone in their shelf."""
        dead = self._stored("dead", "id long, dead int").select("cell", "shelf", "id", F.col("dead").alias("commit"))
        return self._stored("lists", f"{self.ddl}, hash long, angle double").join(dead, ["cell", "shelf", "id", "commit"], "left_anti")

    def compact(self) -> None:
        """All live rows as one commit; the commits before are no longer read, then deleted."""
        old = self._commits()
        commit = max(old, default=0) + 1
        live = self.rows().select(*self.columns, "hash", "angle", "cell", "shelf")
        self._write(live, "lists", commit)
        self.files.write(f"{self.path}/whole", str(commit))  # from here on the commits before it are not read
        self.files.write(f"{self.path}/commits/{commit}", "")
        self._note(commit)
        for n in old:
            self.files.delete(f"{self.path}/commits/{n}")
            self.files.delete(f"{self.path}/lists/commit={n}")
            self.files.delete(f"{self.path}/dead/commit={n}")

    # --- searching

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """queries (query_id long, vector, optionally book: null or absent is no filter) -> (query_id, id, score, rank)."""
        c = self.centroids
        q = queries.where(usable("vector")).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q"), (F.col("book") if "book" in queries.columns else F.lit(None)).cast(self.book).alias("q_book"))
        live = self.rows()
        cells = {r["cell"]: (r["n"], r["wide"]) for r in live.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("wide")).collect()}  # one row a cell
        wide = np.array([cells.get(i, (0, 0.0))[1] for i in range(len(c))])
        pieces = np.array([-(-cells.get(i, (0, 0.0))[0] // PIECE) for i in range(len(c))])

        def route(batches, first: bool):
            """Each query's cells: the nearest ones first, then those whose bound reaches its k-th score so far."""
            for p in batches:
                cos = unit_rows(p["q"]) @ c.T
                order = np.argsort(-cos, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(c))[None, :].repeat(len(p), 0), axis=1)
                near = rank < probes
                if not first:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - wide)) + 1e-6
                    near = ~near & (bound >= p["floor"].to_numpy()[:, None])
                i, j = np.nonzero(near & (pieces > 0)[None, :])
                some = max(1, 10_000 // max(1, pieces.max()))
                for a in range(0, len(i), some):
                    x, y = np.repeat(i[a : a + some], pieces[j[a : a + some]]), np.repeat(j[a : a + some], pieces[j[a : a + some]])
                    part = np.concatenate([np.arange(n) for n in pieces[j[a : a + some]]]) if len(x) else x
                    yield pd.DataFrame({"cell": y.astype(np.int32), "piece": part.astype(np.int32), "query_id": p["query_id"].to_numpy()[x], "q": p["q"].to_numpy()[x], "q_book": p["q_book"].to_numpy()[x]})

        sent = f"cell int, piece int, query_id long, q array<double>, q_book {self.book}"
        n_pieces = F.element_at(F.array(*[F.lit(int(max(1, n))) for n in pieces]), F.col("cell") + 1)
        lists = live.select("cell", F.pmod(F.xxhash64("id"), n_pieces).cast("int").alias("piece"), "id", "book", "vector")

        def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return best_pairs(a["query_id"], a["q"], a["q_book"], b["id"], b["vector"], b["book"], k)

        shares = max(1, -(-q.count() // QUERIES))
        share = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share")
        every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
        keys = ["cell", "piece", "share"]

        def visit(asked: DataFrame) -> DataFrame:
            tiles = asked.select("*", share).groupBy(*keys).cogroup(lists.select("*", every).groupBy(*keys))
            return tiles.applyInPandas(tile, "query_id long, id long, score double")

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
        best = lambda hits: hits.withColumn("rank", rank).where(F.col("rank") <= k)
        hits = best(visit(q.mapInPandas(lambda b: route(b, True), sent)))
        if not exact:
            return hits
        hits = checkpointed(hits)
        floor = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        more = q.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        return best(hits.drop("rank").unionByName(visit(more.mapInPandas(lambda b: route(b, False), sent))))


def best_pairs(q_ids: pd.Series, q: pd.Series, q_books: pd.Series | None, ids: pd.Series, v: pd.Series, books: pd.Series | None, k: int) -> pd.DataFrame:
    """Each query's k best of a tile's vectors (query_id, id, score): by cosine rounded to 6 places, then id."""
    out = [pd.DataFrame({"query_id": q_ids.iloc[:0], "id": ids.iloc[:0], "score": np.zeros(0)})]
    if len(q_ids) and len(ids):
        u, v, q_ids, ids = unit_rows(q), unit_rows(v), q_ids.to_numpy(), ids.to_numpy()
        for at in range(0, len(u), AT_ONCE):
            s = u[at : at + AT_ONCE] @ v.T
            if q_books is not None:
                asked = q_books.to_numpy()[at : at + AT_ONCE]
                s[~pd.isna(asked)[:, None] & (asked[:, None] != books.to_numpy()[None, :])] = -np.inf
            i, j, score = top_rows(s, ids, k)
            out.append(pd.DataFrame({"query_id": q_ids[at + i], "id": ids[j], "score": score}))
    return pd.concat(out)


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k best scores rounded to 6 places, ties by id.

    A row's candidates are those within two millionths of its k-th score as it is; only these are rounded.
    """
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1] - 2e-6 if score.shape[1] > k else np.full(len(score), -np.inf)
    row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    s = np.round(score[row, col], 6)
    order = np.lexsort((ids[col], -s, row))
    row, col, s = row[order], col[order], s[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
    return row[keep], col[keep], s[keep]


def exact_topk(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, k: int, block: int) -> DataFrame:
    """The k items nearest to each query by cosine (rounded to 6 places, ties by id), without an index.

    Queries are dealt by hash into blocks of about `block` numbers, items into pieces of about PIECE; a task multiplies a
    block with a piece, AT_ONCE queries at a time, and passes on the k best of each query.  Neither side passes through
    the driver or is whole in a task; items are sent once a block, queries once a piece.
    """
    q = queries.where(usable(vector)).select(F.col(query_id).alias("q"), F.col(vector).alias("u"))
    v = items.where(usable(vector)).select(F.col(item_id).alias("i"), F.col(vector).alias("v"))
    size, n = q.agg(F.coalesce(F.sum(F.size("u")), F.lit(0))).first()[0], v.count()
    blocks, pieces = max(1, -(-size // block)), max(1, -(-n // PIECE))
    kinds = dict(queries.dtypes)[query_id], dict(items.dtypes)[item_id]

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(a["q"], a["u"], None, b["i"], b["v"], None, k)

    tiles = dealt(q, "q", "block", blocks, "piece", pieces).groupBy("block", "piece").cogroup(dealt(v, "i", "piece", pieces, "block", blocks).groupBy("block", "piece"))
    out = tiles.applyInPandas(tile, f"query_id {kinds[0]}, id {kinds[1]}, score double").select(F.col("query_id").alias(query_id), F.col("id").alias(item_id), "score")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), item_id))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
