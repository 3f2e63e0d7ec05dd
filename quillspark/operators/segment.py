"""Words of texts that have no blanks: best paths through the lattice of known words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillspark.sources.sinks import checkpointed

#: Costs are whole millionths, so equal paths are equal however they are summed.
UNIT = 1_000_000
#: Words of a dictionary that is sent to the tasks (as hashes and costs, 20 bytes each), words of a slice of it and of a piece
#: that the driver gets, and characters whose paths are sought together (some 150 bytes each).
BROADCAST_WORDS, SLICE, PIECE, PLACES = 32_000_000, 2_000_000, 250_000, 250_000


def lexicon(df: DataFrame, text: str, word: str = r"\p{L}+", least: int = 1) -> DataFrame:
    """Words of a corpus that occur often enough, with their cost ln(all / n): word, n, cost."""
    n = df.select(F.explode(F.regexp_extract_all(text, F.lit(f"({word})"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return costs(n)


def costs(words: DataFrame) -> DataFrame:
    """A dictionary (word, n) with the costs of its words; words without a count or letters are left out."""
    w = words.where("n > 0 AND word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    total = w.agg(F.sum("n").alias("total"))
    return w.crossJoin(F.broadcast(total)).select("word", "n", F.round(UNIT * F.ln(F.col("total") / F.col("n"))).cast("long").alias("cost"))


def best_path(size: int, edges: list[tuple[int, int, int]], unknown: int) -> list[int]:
    """Where the words of the cheapest path end; edges are (at, length, cost), any one character costs `unknown`.

    Of equal paths the one whose first words are longer.
    """
    at: dict[int, list[tuple[int, int]]] = {}
    for i, n, cost in edges:
        at.setdefault(i, []).append((n, cost))
    best, step = [0] * (size + 1), [0] * size
    for i in range(size - 1, -1, -1):
        best[i], step[i] = unknown + best[i + 1], 1
        for n, cost in at.get(i, ()):
            c = cost + best[i + n]
            if c < best[i] or (c == best[i] and n > step[i]):
                best[i], step[i] = c, n
    out, i = [], 0
    while i < size:
        i += step[i]
        out.append(i)
    return out


#: Two odd multipliers: a word is known by 64 bits of one polynomial of its code points and 32 of another.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FAR = np.int64(1) << 60


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def windows(codes: np.ndarray, longest: int):
    """For n from 1 to longest: the hashes of the n code points from each place on (fewer places as n grows)."""
    a, b = codes * _A, codes * _B
    for n in range(1, longest + 1):
        if n > 1:
            a, b = a[:-1] * _B + codes[n - 1 :], b[:-1] * _A + codes[n - 1 :]
        yield n, _mixed(a), (_mixed(b) >> np.uint64(32)).astype(np.uint32)


@F.pandas_udf(StructType([StructField("h", LongType()), StructField("g", LongType())]))
def _hashed(words: pd.Series) -> pd.DataFrame:
    h, g = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    size = words.str.len().to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        codes = _codes(words.iloc[at].tolist()).reshape(len(at), n).T
        a, b = codes[0] * _A, codes[0] * _B
        for c in codes[1:]:
            a, b = a * _B + c, b * _A + c
        h[at], g[at] = _mixed(a), _mixed(b) >> np.uint64(32)
    return pd.DataFrame({"h": h.view(np.int64), "g": g})


class Table:
    """Costs of words by their hashes, in slices of sorted arrays: 16 bytes a word and a bitmap of 16 to 32 bits a word."""

    def __init__(self, slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """Slice i of p holds the hashes whose top bits are i, as (hash, second hash, cost) sorted by hash."""
        self.slices = slices
        self.shift = np.uint64(64 - (len(slices) - 1).bit_length())
        most = max((len(h) for h, _, _ in slices), default=0)
        self.bits = max(10, (16 * most).bit_length())
        self.low = np.uint64((1 << self.bits) - 1)
        self.maps = []
        for h, _, _ in slices:
            m = np.zeros(1 << (self.bits - 3), np.uint8)
            x = h & self.low
            np.bitwise_or.at(m, x >> np.uint64(3), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
            self.maps.append(m)

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are words, and their costs."""
        places, found = [], []
        for i, ((hs, gs, costs), m) in enumerate(zip(self.slices, self.maps, strict=True)):
            if not len(hs):
                continue
            at = np.arange(len(h)) if len(self.slices) == 1 else np.flatnonzero(h >> self.shift == i)
            x = h[at] & self.low
            at = at[(m[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            k = np.minimum(np.searchsorted(hs, h[at]), len(hs) - 1)
            for _ in range(2):  # two words may share the first hash
                hit = (hs[k] == h[at]) & (gs[k] == g[at])
                places.append(at[hit])
                found.append(costs[k[hit]])
                at, k = at[~hit], np.minimum(k[~hit] + 1, len(hs) - 1)
                still = hs[k] == h[at]
                at, k = at[still], k[still]
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def best_paths(runs: list[str], table: Table, longest: int, unknown: int) -> list[np.ndarray]:
    """Where the words of each run's cheapest path end, for all runs together: from their ends backwards, a place of each
    run at a step.  Equal to `best_path` run by run."""
    size = np.array([len(r) for r in runs], np.int64)
    ends = np.cumsum(size)
    total, codes = int(ends[-1]), _codes(runs)
    left = np.repeat(ends, size) - np.arange(total)  # places to the end of the run
    cost = np.full((longest, total), _FAR)  # row 0 has the longest words, so that of equal costs they come first
    cost[longest - 1] = unknown
    for n, h, g in windows(codes, min(longest, total)):
        inside = np.flatnonzero(left[: len(h)] >= n)
        at, c = table.find(h[inside], g[inside])
        cost[longest - n, inside[at]] = c
    order = np.argsort(-size, kind="stable")
    first, many = ends[order], np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), side="right")
    base = np.arange(len(runs))[order] * (longest + 1)  # a ring of the best costs behind each run's place
    ring, step = np.full(len(runs) * (longest + 1), _FAR), np.zeros(total, np.int8)
    ring[base] = 0
    for t, active in enumerate(many.tolist(), 1):
        p, b = first[:active] - t, base[:active]
        behind = np.array([(t - n) % (longest + 1) for n in range(longest, 0, -1)])
        reach = cost[:, p] + ring[b[None, :] + behind[:, None]]
        how = reach.argmin(axis=0)
        step[p] = longest - how
        ring[b + t % (longest + 1)] = reach[how, np.arange(active)]
    out, step = [], step.tolist()
    for e, n in zip(ends.tolist(), size.tolist(), strict=True):
        begin, i, path = e - n, e - n, []
        while i < e:
            i += step[i]
            path.append(i - begin)
        out.append(path)
    return out


def _packed(kind: type):
    """Of the words of a piece (hashes and costs) one row: their arrays as bytes, sorted by hash."""

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        h, g, cost = p["h"].to_numpy(np.int64).view(np.uint64), p["g"].to_numpy(np.int64).astype(np.uint32), p["cost"].to_numpy(kind)
        at = np.lexsort((g, h))
        return pd.DataFrame({"piece": p["piece"].iloc[:1], "h": [h[at].tobytes()], "g": [g[at].tobytes()], "cost": [cost[at].tobytes()]})

    return pack


def _sent(known: DataFrame, count: int, kind: type) -> list[Broadcast]:
    """The dictionary's hashes and costs, a slice at a time through the driver.

    Tasks sort and pack pieces of some PIECE words; the driver gets their bytes, a few pieces at a time, and no rows of words.
    """
    parts = pieces = 1
    while count / parts > SLICE:
        parts *= 2
    while count / pieces > min(SLICE, PIECE):
        pieces *= 2
    piece = F.shiftrightunsigned("h", 64 - (pieces - 1).bit_length()) if pieces > 1 else F.lit(0).cast("long")
    rows = known.select(_hashed("word").alias("x"), "cost").select("x.*", "cost").withColumn("piece", piece)
    packed = checkpointed(rows.groupBy("piece").applyInPandas(_packed(kind), "piece long, h binary, g binary, cost binary"))
    got, out = packed.sort("piece").toLocalIterator(), []
    row = next(got, None)
    for i in range(parts):
        h, g, cost = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, kind)]
        while row is not None and row["piece"] * parts // pieces == i:
            for x, name in ((h, "h"), (g, "g"), (cost, "cost")):
                x.append(np.frombuffer(row[name], x[0].dtype))
            row = next(got, None)
        out.append(known.sparkSession.sparkContext.broadcast(tuple(map(np.concatenate, (h, g, cost)))))
    return out


def _ends(words: list[Broadcast], longest: int, unknown: int):
    """UDF from runs to where their words end, with the dictionary at hand; at most PLACES characters at a time, or one run."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Table([w.value for w in words])
        for runs in batches:
            part = (runs.str.len().cumsum() // PLACES).to_numpy()
            cut = [runs.iloc[a].tolist() for a in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(part)) + 1)] if len(runs) else []
            yield pd.Series([e for c in cut for e in best_paths(c, table, longest, unknown)], dtype=object)

    return ends


def _joined(runs: DataFrame, known: DataFrame, longest: int, unknown: int) -> DataFrame:
    """The same for a dictionary that is too large to send: distinct runs, their substrings joined with it."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ends(run: pd.Series, at: pd.Series, n: pd.Series, cost: pd.Series) -> pd.Series:
        none = lambda x: () if x is None else x
        return pd.Series([best_path(len(r), list(zip(*(map(int, none(c)) for c in e), strict=True)), unknown) for r, *e in zip(run, at, n, cost, strict=True)], dtype=object)

    # a run becomes many rows, so they carry its hashes and not its text; as many partitions as shuffles have
    once = runs.select("_run").repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_run").distinct()
    key = F.struct(F.xxhash64("_run").alias("a"), F.xxhash64(F.lit(1), F.col("_run")).alias("b"), F.char_length("_run").alias("size"))
    at = once.select(key.alias("_k"), "_run", F.explode(F.sequence(F.lit(0), F.char_length("_run") - 1)).alias("at"))
    at = at.select("_k", "at", F.substring(F.col("_run"), F.col("at") + 1, F.lit(longest)).alias("w"))
    parts = at.select("_k", "at", "w", F.explode(F.sequence(F.lit(1), F.char_length("w"))).alias("n")).select("_k", "at", "n", F.left("w", F.col("n")).alias("word"))
    edges = parts.join(known, "word").groupBy("_k").agg(F.collect_list(F.struct("at", "n", "cost")).alias("e"))
    path = once.withColumn("_k", key).join(edges, "_k", "left").select("_run", ends("_run", "e.at", "e.n", "e.cost").alias("ends"))
    return runs.join(path, "_run")


def segment(df: DataFrame, keys: list[str], text: str, words: DataFrame, longest: int = 8, run: str = r"\p{L}+") -> DataFrame:
    """Words of each run of letters: keys, run (from 0), pos (from 0), word.

    words: a dictionary with costs.  Its words of at most `longest` characters are counted: up to BROADCAST_WORDS are
    sent to the tasks as 96 bits of hash and a cost, more are joined with the substrings of the distinct runs.  A run that
    occurs often is cut once.  A character that no word covers is a
    word of one character and costs more than any known word.  Rows whose text is null or has no letters give no words.
    """
    runs = df.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(f"({run})"), 1)).alias("run", "_run"))
    known = words.where(F.char_length("word").between(1, longest)).select("word", "cost")
    unknown = (words.agg(F.max("cost")).first()[0] or 0) + UNIT
    count = known.count()
    if not count:
        path = runs.withColumn("ends", F.sequence(F.lit(1), F.char_length("_run")))
    elif count <= BROADCAST_WORDS:
        once = runs.select("_run").distinct()
        path = runs.join(once.select("_run", _ends(_sent(known, count, np.int32 if unknown < 1 << 31 else np.int64), longest, unknown)("_run").alias("ends")), "_run")
    else:
        path = _joined(runs, known, longest, unknown)
    begin = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
    cut = F.transform("ends", lambda e, i: F.substring(F.col("_run"), begin(i) + 1, e - begin(i)))
    return path.select(*keys, "run", F.posexplode(cut).alias("pos", "word"))
