"""Substring dedup by a log-structured index of window hashes.

A window is `window` consecutive words [^\\x20\\x09-\\x0D]+ of one document.  A word goes if a window that covers it has
a word sequence that also starts in a document with a smaller id; windows are judged on the input, not on what is
left.  A null text has no words; a missing id sorts after every other; rows repeated with one id don't remove each
other, those of one id and other texts are judged each by itself; the empty table gives an empty result.

1. Each document's word sequence is hashed.  A document whose whole sequence occurs under a smaller id goes whole (if
   it has a window at all), and its windows need no look: those of the smaller id stand for them.
2. Anchors: of the hashes of ANCHOR words (a third of the window at most), the smallest in any window.  Two equal windows have an equal anchor, at the
   same place, so windows without an anchor that another document has cannot repeat and never reach the index.
3. The index: sorted immutable runs (hash, check hash, first id) of the windows of history.  Documents come in batches
   by id.  A batch's windows are merge-joined with each run by the hash, verified by the independent check hash, and
   then appended as a run of their own; more than MAX_RUNS runs are compacted into one.
4. Covered words are dropped from the whole text.

Hashes have 64 bits and the check hash as many more.  A passage that any number of documents share is one row a
window and task before it is dealt; its rows stay where they are, and what the index tells of it is broadcast to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.common import NO_ID, Cuts, lookup_join, partitions

ANCHOR, MAX_RUNS, BATCHES = 16, 1, 4
#: Ids of documents with something to look at, up to which they are broadcast.
BROADCAST_IDS = 500_000
_CHECK = 0xA0761D6478BD642F


def _slide(x: np.ndarray, n: int, how) -> np.ndarray:
    """how (minimum or maximum) of each n neighbours."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = how(x[:-step], x[step:])
        done += step
    return x


def anchors(w: tk.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (words) and hashes of anchors of the texts of w."""
    h = w.windows(k)
    span = window - k + 1
    if len(h) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = _slide(h, span, np.minimum)
    low = np.where(w.inside(window), low, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), span, np.maximum) == h)
    at = at[h[at] > 0]
    return at, h[at]


def _documents(window: int, k: int):
    """Each document: words, hash of its sequence (two lanes), anchors with their positions."""

    def run(batches):
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for i, j in tk.pieces(offs):
                w = tk.Words(data, offs[i : j + 1])
                at, h = anchors(w, window, k)
                n = np.diff(w.first)
                doc = np.searchsorted(w.first, at, "right") - 1
                order = np.lexsort((at, h, doc))  # an anchor that repeats in a text is one row with its positions
                at, h, doc = at[order], h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                sizes = np.bincount(doc[new], minlength=j - i)
                each = np.diff(np.append(np.flatnonzero(new), len(h)))
                inner = tk.lists((at - w.first[doc]).astype(np.int32), each, pa.int32())
                outer = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(w.whole().view(np.int64)), pa.array(w.whole(_CHECK).view(np.int64)), tk.lists(h[new].view(np.int64), sizes, pa.int64()), pa.ListArray.from_arrays(outer, inner)],
                    names=["_id", "n_words", "s1", "s2", "h", "pos"],
                )

    return run


def _marks(batch: pa.RecordBatch, i: int, j: int, s1: np.ndarray) -> list[tuple[int, bool, np.ndarray]]:
    """(text, whole, positions) of those texts i..j whose marks are for the very text (ids may repeat)."""
    marks = batch.column(2)
    out = []
    for d in range(i, j):
        if marks[d].is_valid:
            for m in marks[d].as_py():
                if m["s1"] == int(s1[d - i]):
                    out.append((d - i, bool(m["gone"]), np.array(m["pos"] or [], np.int64)))
                    break
    return out


def _windows(window: int, k: int):
    """The windows around live anchors: hash, check hash, id, position."""

    def run(batches):
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in tk.pieces(offs):
                w = tk.Words(data, offs[i : j + 1])
                inside = w.inside(window)
                step = np.zeros(len(w.hash) + 1, np.int32)
                for d, _, pos in _marks(batch, i, j, w.whole().view(np.int64)):
                    base = w.first[d]
                    np.add.at(step, base + np.maximum(pos - (window - k), 0), 1)
                    np.add.at(step, base + pos + 1, -1)
                at = np.flatnonzero((np.cumsum(step[:-1])[: len(inside)] > 0) & inside)
                if len(at):
                    d = np.searchsorted(w.first, at, "right") - 1
                    yield pa.record_batch(
                        [pa.array(w.windows(window)[at].view(np.int64)), pa.array(w.windows(window, _CHECK)[at].view(np.int64)), pa.array(ids[i + d]), pa.array(w.whole()[d].view(np.int64)), pa.array((at - w.first[d]).astype(np.int32))],
                        names=["h1", "h2", "_id", "s1", "pos"],
                    )

    return run


def _removal(window: int, digest: bool):
    """Drops covered words: the result's rows, with the kept text or its SHA-256."""

    def run(batches):
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for i, j in tk.pieces(offs):
                w = tk.Words(data, offs[i : j + 1])
                n = np.diff(w.first)
                step = np.zeros(len(w.hash) + 1, np.int32)
                for d, gone, pos in _marks(batch, i, j, w.whole().view(np.int64)):
                    base = w.first[d]
                    if gone:
                        pos = np.arange(n[d] - window + 1)
                    np.add.at(step, base + pos, 1)
                    np.add.at(step, base + pos + window, -1)
                covered = np.cumsum(step[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(covered)])
                cut = total[w.first[1:]] - total[w.first[:-1]]
                raw, kept = w.data.tobytes(), []
                edge = offs[i : j + 1] - offs[i]
                for d in range(j - i):
                    if cut[d]:
                        at = w.first[d] + np.flatnonzero(~covered[w.first[d] : w.first[d + 1]])
                        kept.append(b" ".join([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
                    else:
                        kept.append(b" ".join(raw[edge[d] : edge[d + 1]].split()))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(cut.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept] if digest else kept, pa.string() if digest else pa.binary())], names=["_id", "n_words", "n_removed", "kept"])

    return run


class WindowIndex:
    """Sorted immutable runs (h1, h2, first) of the windows of all batches so far."""

    def __init__(self, cuts: Cuts):
        self.cuts, self.runs = cuts, []

    def firsts(self, batch: DataFrame) -> DataFrame:
        """The windows of a batch (h1, h2), each once: the smallest id that has it (first) and how many rows (n)."""
        return self.cuts.cut(batch.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")))

    def match(self, batch: DataFrame, firsts: DataFrame) -> DataFrame:
        """The rows of batch (h1, h2, _id, ...) whose window a smaller id has, in the batch or in any run.

        Windows are aggregated before they are dealt and merge-joined with each run; what they find goes back to the
        rows by h1, windows with many rows apart.
        """
        out = firsts.withColumn("low", F.col("first"))
        for run in self.runs:
            old = run.select("h1", F.struct("h2", F.col("first").alias("id")).alias("_old"))
            out = out.hint("merge").join(old, "h1", "left")
            # verified by the check hash; a run has a row for each check hash of a hash
            hit = F.when(F.col("h2") == F.col("_old.h2"), F.col("_old.id"))
            out = out.withColumn("low", F.least("low", hit)).drop("_old")
        seen = out.where((F.col("n") > 1) | (F.col("low") < F.col("first"))).groupBy("h1").agg(F.collect_set(F.struct("h2", "low")).alias("w"), F.sum("n").alias("n"))
        rows = lookup_join(batch, self.cuts.cut(seen), "h1", "n").where("w IS NOT NULL")
        return rows.where(F.exists("w", lambda x: (x["h2"] == F.col("h2")) & (x["low"] < F.col("_id")))).drop("w", "n")

    def append(self, firsts: DataFrame) -> None:
        """firsts (h1, h2, first), one row a window, as a run of its own."""
        self.runs.append(self.cuts.cut(firsts.repartition(partitions(self.cuts.spark), "h1").sortWithinPartitions("h1", "h2")))

    def compact(self) -> None:
        if len(self.runs) > MAX_RUNS:
            every = self.runs[0]
            for run in self.runs[1:]:
                every = every.unionByName(run)
            old, self.runs = self.runs, []
            self.append(every.groupBy("h1", "h2").agg(F.min("first").alias("first")))
            self.cuts.drop(*old)


def _marked(texts: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """texts with their marks, and the texts without any; marks is a table that is cut.

    Of up to BROADCAST_IDS ids, the ids are sent to the texts, and only texts with marks are shuffled; with more, all
    texts are (those without marks then stand in the first table, marks null).
    """
    ids = marks.select("_id")
    if ids.count() > BROADCAST_IDS:
        return texts.join(marks, "_id", "left"), None
    return texts.join(F.broadcast(ids), "_id", "left_semi").join(marks, "_id"), texts.join(F.broadcast(ids), "_id", "left_anti")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = BATCHES, texts_too: bool = False) -> DataFrame:
    """One row a document: id, n_words, n_removed and kept_sha256, or the kept text itself with texts_too."""
    cuts, k = Cuts(docs.sparkSession), min(ANCHOR, max(1, window // 3))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    info = cuts.cut(texts.mapInArrow(_documents(window, k), "_id long, n_words long, s1 long, s2 long, h array<long>, pos array<array<int>>"))
    rep = info.where(F.col("n_words") >= window).groupBy("s1", "s2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copied = cuts.cut(rep.where("n > 1"))
    # a copy goes whole; of sequences that occur once nothing is joined
    keyed = info.select("_id", "n_words", "s1", "s2", F.concat_ws(":", "s1", "s2").alias("s"))
    known = lookup_join(keyed, copied.select(F.concat_ws(":", "s1", "s2").alias("s"), "rep", "n"), "s", "n")
    gone = cuts.cut(known.where((F.col("n_words") >= window) & (F.col("_id") > F.col("rep"))).select("_id", "s1").distinct())
    spots = info.join(gone, ["_id", "s1"], "left_anti").select("_id", "s1", F.explode(F.arrays_zip("h", "pos")).alias("a")).select("_id", "s1", F.col("a.h").alias("h"), F.col("a.pos").alias("pos"))
    spread = F.count(F.lit(1)).alias("n")
    live = cuts.cut(spots.groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), spread).where("lo < hi").select("h", "n"))
    around = lookup_join(spots, live, "h", "n").where("n IS NOT NULL").groupBy("_id", "s1").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    marks = lambda df: df.groupBy("_id").agg(F.collect_list(F.struct("s1", "gone", "pos")).alias("marks"))
    around = cuts.cut(marks(around.withColumn("gone", F.lit(False))))
    found = _marked(texts, around)[0].select("_id", "_t", "marks")
    found = cuts.cut(found.mapInArrow(_windows(window, k), "h1 long, h2 long, _id long, s1 long, pos int"))
    cuts.drop(info)

    index, covered = WindowIndex(cuts), None
    edges = found.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)] or [1.0], 1000).alias("q")).first()["q"] or []
    edges = sorted(set(edges)) if batches > 1 else []
    edges = [None, *edges, None]
    for low, high in zip(edges, edges[1:], strict=False):
        batch = found if low is None else found.where(F.col("_id") > low)
        batch = batch if high is None else batch.where(F.col("_id") <= high)
        firsts = index.firsts(batch)
        hit = cuts.cut(index.match(batch, firsts).select("_id", "s1", "pos"))
        covered = hit if covered is None else covered.unionByName(hit)
        if high is not None:
            index.append(firsts.select("h1", "h2", "first"))
            index.compact()
        cuts.drop(firsts)
    where = covered.groupBy("_id", "s1").agg(F.collect_list("pos").alias("pos")).withColumn("gone", F.lit(False))
    where = where.unionByName(gone.withColumn("gone", F.lit(True)).withColumn("pos", F.array().cast("array<int>")))
    some, others = _marked(texts, cuts.cut(marks(where)))
    out = some.select("_id", "_t", "marks")
    if others is not None:
        out = out.unionByName(others.select("_id", "_t", F.lit(None).cast(some.schema["marks"].dataType).alias("marks")))
    out = out.mapInArrow(_removal(window, not texts_too), f"_id long, n_words long, n_removed long, kept {'binary' if texts_too else 'string'}")
    first = F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col)
    return out.select(first, "n_words", "n_removed", F.col("kept").cast("string").alias(text_col if texts_too else "kept_sha256"))
