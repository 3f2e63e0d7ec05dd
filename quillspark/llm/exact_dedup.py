"""Exact dedup behind a minimal perfect hash over the distinct digests of history.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D].  A null text counts as empty,
so all null and blank texts are one group.  Of equal texts the one with most code points in the original stays,
then the smallest id; rows repeated with the same id are rows of their own in group_size, and the id that stays is
kept in each of them.  A missing id sorts after every other.  An empty table gives an empty result.

History is an index of distinct digests: buckets of about BUCKET digests by digest prefix, in each a minimal perfect
hash (levels of collision-free bits, ranks by counting them) whose slots hold the full digest, the locator of the
winner and the group's size.  A lookup hashes to a slot and compares all 32 bytes; rows of members are settled by the
slot, the others group among themselves.  Only digests travel, one row a distinct digest after partial aggregation,
so a text with any number of copies is one row of one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.common import NO_ID, Cuts, lookup_join

#: Distinct digests a bucket holds on average (48 bytes each).
BUCKET = 40_000
_SLOT = np.dtype([("digest", "S32"), ("points", "<i8"), ("id", "<i8"), ("size", "<i8")])
DIGESTS = "_id long, digest binary, points long"
_BLANKS = b" \t\n\v\f\r"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = tk.buffers(batch.column(1))
        raw = data.tobytes()
        out = [hashlib.sha256(raw[a:b].translate(None, _BLANKS)).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["_id", "digest", "points"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, digest of the normalised text, code points of the original) a document."""
    got = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    return got.select("_id", "_t", F.length("_t").cast("long").alias("points")).mapInArrow(_digest_batches, DIGESTS)


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row a digest: its winner and how many rows have it (partial aggregation first)."""
    best = F.max(F.struct("points", (-F.col("_id")).alias("neg")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("size")).select("digest", F.col("b.points").alias("points"), (-F.col("b.neg")).alias("id"), "size")


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.frombuffer(digest.tobytes(), "<u8").reshape(-1, 4)
    return q[:, 1], q[:, 2]


class PerfectHash:
    """Minimal perfect hash of n distinct 32-byte digests to 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) for x in levels]

    @staticmethod
    def at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tk.mix(a + np.uint64(level) * (b | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digest: np.ndarray) -> PerfectHash:
        a, b = _words(digest)
        levels = []
        while len(a):
            size = 2 * len(a)
            at = cls.at(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            if len(levels) > 64 and left.any():
                raise ValueError("digests are not distinct")
            a, b = a[left], b[left]
        return cls(levels)

    def slot(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each digest; of digests that are not in the set, any slot or -1."""
        a, b = _words(digest)
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for k, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = self.at(a[todo], b[todo], k, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.before[k] + self.ranks[k][at[hit]] - 1
            todo = todo[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            m = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, m, at), count=n).astype(bool))
            at += m
        return cls(levels)


def _fixed(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), "S32") if len(col) else np.empty(0, "S32")


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    digest = np.array(_fixed(pdf["digest"]))
    mph = PerfectHash.build(digest)
    slots = np.zeros(len(digest), _SLOT)
    at = mph.slot(digest)
    for k, v in (("digest", digest), ("points", pdf["points"].to_numpy()), ("id", pdf["id"].to_numpy()), ("size", pdf["size"].to_numpy())):
        slots[k][at] = v
    sizes, bits = mph.dump()
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "levels": [sizes], "bits": [bits], "slots": [slots.tobytes()]})


def _look_up(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Rows of one bucket: each distinct digest of the batch, with what history knows of it; history's own rest."""
    digest = np.array(_fixed(batch["digest"]))
    known = np.zeros(len(digest), bool)
    out = {"digest": list(batch["digest"]), "points": batch["points"].to_numpy(), "id": batch["id"].to_numpy(), "size": batch["size"].to_numpy()}
    if not len(index):
        return pd.DataFrame(out | {"member": known})
    mph = PerfectHash.load(list(index["levels"].iloc[0]), index["bits"].iloc[0])
    slots = np.frombuffer(index["slots"].iloc[0], _SLOT)
    at = mph.slot(digest)
    known = at >= 0
    known[known] = slots["digest"][at[known]] == digest[known]
    s = slots[at[known]]
    mine, theirs = (out["points"][known], -out["id"][known]), (s["points"], -s["id"])
    old = (theirs[0] > mine[0]) | (theirs[0] == mine[0]) & (theirs[1] > mine[1])
    out = {k: np.array(v) if k != "digest" else v for k, v in out.items()}
    out["points"][known] = np.where(old, s["points"], mine[0])
    out["id"][known] = np.where(old, s["id"], -mine[1])
    out["size"][known] += s["size"]
    free = np.ones(len(slots), bool)
    free[at[known]] = False
    rest, raw, w = slots[free], slots.tobytes(), _SLOT.itemsize
    full = [raw[i : i + 32] for i in (np.flatnonzero(free) * w).tolist()]  # not by the array: its bytes drop trailing zeros
    return pd.concat([pd.DataFrame(out | {"member": known}), pd.DataFrame({"digest": full, "points": rest["points"], "id": rest["id"], "size": rest["size"], "member": np.zeros(len(rest), bool)})], ignore_index=True)


def _bucket(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(n)).cast("int")


class DigestIndex:
    """Distinct digests of all rows so far."""

    def __init__(self, cuts: Cuts, buckets: int):
        self.cuts, self.buckets, self.table = cuts, buckets, None

    def build(self, distinct: DataFrame) -> None:
        """(Re)builds the index from rows (digest, points, id, size)."""
        built = distinct.withColumn("bucket", _bucket(self.buckets)).groupBy("bucket").applyInPandas(_build_bucket, "bucket int, levels array<int>, bits binary, slots binary")
        new = self.cuts.cut(built)
        if self.table is not None:
            self.cuts.drop(self.table)
        self.table = new

    def merge(self, distinct: DataFrame) -> DataFrame:
        """Groups of history and the batch together; member: known to both.  Byte-checked lookups, then the rest."""
        batch = distinct.withColumn("bucket", _bucket(self.buckets)).groupBy("bucket")
        return batch.cogroup(self.table.groupBy("bucket")).applyInPandas(_look_up, "digest binary, points long, id long, size long, member boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Rows come in as `batches` batches by id; each batch is looked up in the index of those before it.
    """
    cuts = Cuts(docs.sparkSession)
    rows = cuts.cut(digests(docs, id_col, text_col))
    part = F.pmod(F.xxhash64("_id"), F.lit(batches))
    index = DigestIndex(cuts, max(1, -(-rows.count() // BUCKET)))
    groups = None
    for k in range(batches):
        new = distinct_digests(rows.where(part == k))
        if k:
            index.build(groups)
            new = index.merge(new)
        made = cuts.cut(new.select("digest", "points", "id", "size"))
        if groups is not None:
            cuts.drop(groups)
        groups = made
    out = lookup_join(rows, groups.select("digest", F.col("id").alias("keep_id"), "size"), "digest", "size")
    nul = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(nul("_id").alias(id_col), nul("keep_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
