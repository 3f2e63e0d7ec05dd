"""Ranked lexical search over a length-stratified index.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, only A-Z lower-cased; a null text has none.
N counts the documents with a term, L all terms, n one document's.  With tf occurrences in a document of normaliser
m = 100 - 25 + ((25 n N) div L), a term of an item adds w * ((1000000000 tf) div (1000 tf + 12 m)), repeats in the item
included, where w = floor(1000 ln((2 N + 2) / (2 df + 1))) and df counts the documents holding it.

`build_index`: documents of equal m are a stratum; a stratum is cut by hash into shelves of about POSTINGS postings and
DOCS documents, so a group of copies makes many shelves, not a large one.  A shelf is one row: its documents, and its
postings by (term, tf).  All documents of an entry have the same m and tf, so its impact is computed once, there.
The index holds every term of every document and is a table: it serves any number of searches.

`search`: for each item a shelf's bound is the sum over its terms of weight times the term's highest impact there.  The
TOP shelves of each item by bound are visited first and give the floor of its TOP-th score; then every shelf is visited
by the items whose bound reaches their floor.  A visit adds up impacts term by term and returns at most TOP documents an
item, those at or above the floor.  Sums stay below 2**53, so doubles hold them exactly.  Items are worked in blocks
of about ITEMS (and about TERMS distinct terms) that go to the tasks whole; whatever the number of items, no more is sent.

Documents with equal scores come by ascending id, a missing id last; each row is a document of its own, repeated ones
too.  Items are by id: of several rows of one id the smallest text counts; an item without terms has no result.  Empty
tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, Cuts

TOP, POSTINGS, DOCS, ITEMS, TERMS = 20, 200_000, 1024, 512, 200_000
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: In UTF-8 every byte of a character beyond ASCII is at least 0x80, so bytes do for characters.
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_TABLE = bytes(0x20 if b in _SEPARATORS else _TABLE[b] + 32 * (0x41 <= b <= 0x5A) for b in range(256))
SHELF = "m int, shelf int, ids array<long>, terms array<string>, term array<int>, tf array<int>, impact array<long>, start array<int>, at array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _counted(batches):
    """(id, text) to (id, n, terms, tfs): a document's distinct terms and how often each is there."""
    for b in batches:
        n, flat, tfs, offsets = [], [], [], [0]
        for text in b.column(1):
            c = Counter(terms_of(text.as_py()))
            n.append(sum(c.values()))
            flat.extend(c)
            tfs.extend(c.values())
            offsets.append(len(flat))
        o = pa.array(offsets, pa.int32())
        terms = pa.ListArray.from_arrays(o, pa.array(flat, pa.binary()).cast(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), terms, pa.ListArray.from_arrays(o, pa.array(tfs, pa.int32()))], names=["id", "n", "terms", "tfs"])


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "id long, n long, terms array<string>, tfs array<int>")


def _shelve(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    m = int(key[0])
    p = p.sort_values("id", kind="stable")
    code, terms = pd.factorize(np.concatenate(p["terms"].to_numpy()))
    tf = np.concatenate(p["tfs"].to_numpy()).astype(np.int64)
    doc = np.repeat(np.arange(len(p)), p["terms"].map(len).to_numpy())
    order = np.lexsort((doc, tf, code))
    code, tf, doc = code[order], tf[order], doc[order]
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
    impact = (1_000_000_000 * tf[start]) // (1000 * tf[start] + 12 * m)  # once for all documents of the entry
    row = {"m": m, "shelf": int(key[1]), "ids": p["id"].to_numpy(), "terms": terms, "term": code[start].astype(np.int32), "tf": tf[start].astype(np.int32), "impact": impact, "start": np.r_[start, len(doc)].astype(np.int32), "at": doc.astype(np.int32)}
    return pd.DataFrame({k: [v] for k, v in row.items()})


class Index:
    """Shelves as a table, and the number of documents with a term (N)."""

    def __init__(self, shelves: DataFrame, n_docs: int):
        self.shelves, self.n_docs = shelves, n_docs


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: Cuts | None = None) -> Index:
    spark = docs.sparkSession
    cuts = cuts or Cuts(spark)
    rows = cuts.cut(counted(docs, id_col, text_col))
    total = rows.agg(F.sum(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")).first()
    if not total["L"]:
        return Index(spark.createDataFrame([], SHELF), 0)
    m = F.expr(f"CAST(75 + (25 * n * {total['N']}L) DIV {total['L']}L AS INT)")
    placed = rows.where("n > 0").withColumn("m", m)
    strata = placed.groupBy("m").agg(F.greatest(F.ceil(F.sum(F.size("terms")) / POSTINGS), F.ceil(F.count(F.lit(1)) / DOCS)).cast("int").alias("shelves"))
    # k strata need documents of k lengths, so L >= 25 N: never more than about sqrt(50 N) strata
    shelf = F.pmod(F.xxhash64("id", "n", F.monotonically_increasing_id()), F.col("shelves")).cast("int")
    shelves = placed.join(F.broadcast(strata), "m").select("m", shelf.alias("shelf"), "id", "terms", "tfs").groupBy("m", "shelf").applyInPandas(_shelve, SHELF)
    out = cuts.cut(shelves)
    cuts.drop(rows)
    return Index(out, total["N"])


class _Block:
    """A block of items in the tasks: their terms' weights, one item after the other."""

    def __init__(self, items: pd.DataFrame):
        self.terms = {t: i for i, t in enumerate(items["term"].unique())}
        items = items.sort_values("item", kind="stable")
        self.ids, self.start = np.unique(items["item"].to_numpy(), return_index=True)
        self.end = np.r_[self.start[1:], len(items)]
        self.term = items["term"].map(self.terms).to_numpy(np.int64)
        self.weight = items["weight"].to_numpy(np.float64)

    def local(self, s) -> np.ndarray:
        """The block's number of each of the shelf's terms, -1 where no item has it."""
        return np.fromiter((self.terms.get(t, -1) for t in s.terms), np.int64, len(s.terms))

    def bounds(self, s, local: np.ndarray) -> np.ndarray:
        most = np.zeros(len(self.terms) + 1)
        np.maximum.at(most, local[s.term], np.asarray(s.impact, np.float64))
        return np.add.reduceat(most[self.term] * self.weight, self.start)

    def visit(self, s, local: np.ndarray, which: np.ndarray, floor: np.ndarray, top: int):
        """(item, id, score) of the shelf's first documents for the items `which`, at or above their floors."""
        spans = {}
        first = np.flatnonzero(np.r_[True, s.term[1:] != s.term[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(s.term)], strict=True):
            if local[s.term[a]] >= 0:
                x, y = s.start[a], s.start[b]
                spans[local[s.term[a]]] = (s.at[x:y], np.repeat(np.asarray(s.impact[a:b], np.float64), np.diff(s.start[a : b + 1])))
        ids = np.asarray(s.ids)
        for i in which:
            score = np.zeros(len(ids))
            for t, w in zip(self.term[self.start[i] : self.end[i]], self.weight[self.start[i] : self.end[i]], strict=True):
                if t in spans:
                    at, impact = spans[t]
                    score[at] += impact * w  # a document is once in a term's entries
            good = np.flatnonzero((score > 0) & (score >= floor[i]))
            if len(good) > top:
                good = good[score[good] >= -np.partition(-score[good], top - 1)[top - 1]]
                good = good[np.lexsort((ids[good], -score[good]))[:top]]
            if len(good):
                yield pd.DataFrame({"item": np.full(len(good), self.ids[i]), "id": ids[good], "score": score[good].astype(np.int64)})


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, cuts: Cuts | None = None, doc_col: str = "doc_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents with a score above 0."""
    spark = items.sparkSession
    cuts = cuts or Cuts(spark)
    asked = items.groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    asked = counted(asked, "id", "text").select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("qtf"))
    asked = cuts.cut(asked)
    counts = asked.agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("terms")).first()
    result = "item long, rank int, id long, score long"
    out = spark.createDataFrame([], result)
    if counts["items"] and index.n_docs:
        vocabulary = asked.select("term").distinct()
        entries = index.shelves.select("terms", "term", F.expr("transform(sequence(1, size(start) - 1), i -> start[i] - start[i - 1])").alias("n"))
        entries = entries.select("terms", F.explode(F.arrays_zip("term", "n")).alias("e")).select(F.expr("terms[e.term]").alias("term"), F.col("e.n").alias("n"))
        small = F.broadcast if counts["terms"] <= TERMS else (lambda x: x)
        df = entries.join(small(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        w = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
        blocks = max(-(-counts["items"] // ITEMS), -(-counts["terms"] // TERMS))
        weighted = cuts.cut(asked.join(df, "term").select("item", "term", (F.col("qtf") * w).alias("weight"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).where("weight > 0"))
        found = [_searched(cuts, index.shelves, _Block(p), top) for b in range(blocks) if len(p := weighted.where(F.col("block") == b).select("item", "term", "weight").toPandas())]
        for f in found:
            out = out.unionByName(f)
    nul = lambda c, to: F.when(F.col(c) != NO_ID, F.col(c)).alias(to)
    return out.select(nul("item", id_col), "rank", nul("id", doc_col), "score")


def _ranked(df: DataFrame, order, top: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)).cast("int")).where(F.col("rank") <= top)


def _searched(cuts: Cuts, shelves: DataFrame, block: _Block, top: int) -> DataFrame:
    spark = shelves.sparkSession
    sent = spark.sparkContext.broadcast(block)
    # shelves of highest bound: each has a document with a score, so `top` of them give a floor
    def best(batches):
        at = sent.value
        rows = []
        for p in batches:
            for s in p.itertuples():
                b = at.bounds(s, at.local(s))
                some = np.flatnonzero(b > 0)
                rows.append(pd.DataFrame({"item": at.ids[some], "m": s.m, "shelf": s.shelf, "bound": b[some]}))
                if len(rows) > 64:
                    rows = [pd.concat(rows).sort_values("bound", ascending=False).groupby("item").head(top)]
        if rows:
            yield pd.concat(rows).sort_values("bound", ascending=False).groupby("item").head(top).astype({"m": np.int32, "shelf": np.int32})

    entry = shelves.select("m", "shelf", "terms", "term", "impact")
    visits = _ranked(entry.mapInPandas(best, "item long, m int, shelf int, bound double"), [F.desc("bound"), "m", "shelf"], top)
    visits = visits.groupBy("m", "shelf").agg(F.collect_list("item").alias("items"))

    def visit(batches):
        at = sent.value
        none = np.zeros(len(at.ids))
        for p in batches:
            for s in p.itertuples():
                yield from at.visit(s, at.local(s), np.searchsorted(at.ids, np.asarray(s.items)), none, top)

    hits = "item long, id long, score long"
    first = shelves.join(F.broadcast(visits), ["m", "shelf"]).mapInPandas(visit, hits)  # at most `top` shelves an item of the block
    lows = _ranked(first, [F.desc("score"), "id"], top).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= top)
    floor = np.zeros(len(block.ids))
    for r in lows.collect():  # one number an item of the block
        floor[np.searchsorted(block.ids, r["item"])] = r["low"]

    def rest(batches):
        at = sent.value
        for p in batches:
            for s in p.itertuples():
                local = at.local(s)
                b = at.bounds(s, local)
                yield from at.visit(s, local, np.flatnonzero((b > 0) & (b >= floor)), floor, top)

    return cuts.cut(_ranked(shelves.mapInPandas(rest, hits), [F.desc("score"), "id"], top).select("item", "rank", "id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    cuts = Cuts(docs.sparkSession)
    return search(build_index(docs, doc_col, text_col, cuts), items, item_col, text_col, top, cuts, doc_col)
