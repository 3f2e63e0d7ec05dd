"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the 3-byte sequences of the whole text (A-Z lower-cased, white space as one kind of blank) that hold
letters and blanks only, hashed to 2**BUCKET_BITS embeddings.  A text is the mean of its subwords' embeddings, and a
softmax layer reads it.  Both are trained by stochastic gradient descent in numpy, on a bounded sample: of each language
about TRAIN_PER_LANG labelled documents, fewer where all languages together would have more than TRAIN_ROWS (a language
keeps one at least), picked by a hash of id and text, with SUBWORDS subwords drawn from anywhere in each text by a
generator of that hash.  So the model does not depend on how the table is dealt.  After training the mean of (embedding x
layer) is the logit, so prediction reads one small table; every subword of a text counts.

Calibration, on a fifth of the sample that training does not see: logits are scaled by a * n / (n + n0), n being the
number of subwords, with a and n0 of least log loss over whole and shortened texts; the rejection threshold is the
score that all but REJECT of the rightly told calibration documents reach, at most one half.

Null texts and texts without a letter are `und` with score 0 and rejected.  Texts with letters but no subword get the
commonest language with its share as score.  Without any labelled document everything is `und`.  Repeated rows are
predicted alike; of equal scores the language of smaller code points is told; a missing id is never held out and is
returned as null; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk

BUCKET_BITS, DIM, SUBWORDS, TRAIN_PER_LANG, TRAIN_ROWS, REJECT = 15, 16, 512, 1500, 20_000, 0.001
EPOCHS, RATE, BATCH, SEED = 6, 0.5, 32, 11

_CLASS = np.zeros(256, np.uint8)  # of a byte: itself lower-cased if a letter or above ASCII, a blank, or 0
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0x20


def subwords(data: np.ndarray) -> np.ndarray:
    """Bucket of the 3 bytes from each byte, 0 where they are not letters and blanks (or two blanks)."""
    b = _CLASS[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(len(b), np.uint32)
    x, y, z = b[:-2], b[1:-1], b[2:]
    good = (x > 0) & (y > 32) & (z > 0)
    h = ((x | y << 8 | z << 16) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    out = np.zeros(len(b), np.uint32)
    out[:-2] = np.where(good, np.maximum(h, 1), 0)
    return out


@dataclass
class Model:
    langs: list[str]
    share: np.ndarray
    table: np.ndarray
    bias: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.0

    def scores(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities from sums of table rows and numbers of subwords."""
        m = np.maximum(n, 1)[:, None]
        z = (sums / m + self.bias) * (self.scale[0] * m / (m + self.scale[1]))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return np.where(n[:, None] > 0, p, self.share)


def _draw(per_doc: int):
    def run(batches):
        for batch in batches:
            data, at = tk.buffers(batch.column(1))
            out = []
            for a, b, seed in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(3).to_pylist(), strict=True):
                s = subwords(data[a:b])[:-2]
                s = s[s > 0]
                out.append((np.random.default_rng([SEED, seed]).choice(s, per_doc) if len(s) > per_doc else s).astype(np.int32))
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.list_(pa.int32()))], names=["_id", "lang", "pick", "subwords"])

    return run


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and non-null language of the documents that are not held out."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_lang"))
    counts = known.groupBy("_lang").count().orderBy("_lang").collect()  # as many as the model has outputs
    if not counts:
        return Model([], np.zeros(0), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    langs, share = [r["_lang"] for r in counts], {r["_lang"]: r["count"] for r in counts}
    each = max(1, min(TRAIN_PER_LANG, TRAIN_ROWS // len(langs)))
    spark = docs.sparkSession
    limits = spark.createDataFrame([(k, int(min(1.0, each / n) * (1 << 30))) for k, n in share.items()], "_lang string, _limit long")
    known = known.withColumn("pick", F.pmod(F.xxhash64(F.lit(SEED), "_id", "_t"), F.lit(1 << 30)))
    chosen = known.join(F.broadcast(limits) if len(langs) <= 100_000 else limits, "_lang").where("pick < _limit").select("_id", "_t", "_lang", "pick")
    rows = chosen.mapInArrow(_draw(SUBWORDS), "_id long, lang string, pick long, subwords array<int>").toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, [("_id", "ascending"), ("lang", "ascending"), ("pick", "ascending")])) if rows.num_rows else rows
    at = {x: i for i, x in enumerate(langs)}
    y = np.array([at[x] for x in rows["lang"].to_pylist()], np.int64)
    x = [v.values.to_numpy(zero_copy_only=False) for v in rows["subwords"]]
    return train(x, y, langs, np.array([share[k] for k in langs], float))


def train(x: list[np.ndarray], y: np.ndarray, langs: list[str], counts: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    full = [i for i in order if len(x[i])]
    held, used = full[: len(full) // 5], full[len(full) // 5 :]
    c = len(langs)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, c), np.float32), np.zeros(c, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    weight = np.bincount(y[used], minlength=c).astype(float) if len(used) else np.ones(c)
    weight = (weight.sum() / np.maximum(weight, 1) / c).astype(np.float32)
    steps, step = max(1, EPOCHS * -(-len(used) // BATCH)), 0
    for _ in range(EPOCHS):
        for i in range(0, len(used), BATCH):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            lab = y[used[i : i + BATCH]]
            rows = [x[j] for j in used[i : i + BATCH]]
            size = np.array([len(r) for r in rows])
            flat = np.concatenate(rows)
            h = np.add.reduceat(emb[flat], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
            z = h @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(lab)), lab] -= 1
            p *= weight[lab][:, None]
            g = p @ out.T / size[:, None].astype(np.float32)
            out -= rate * (h.T @ p) / len(lab)
            bias -= rate * p.mean(axis=0)
            np.add.at(emb, flat, np.repeat(-rate * g * np.float32(8), size, axis=0))
        rng.shuffle(used)
    table = (emb @ out).astype(np.float32)
    table[0] = 0
    model = Model(langs, counts / counts.sum(), table, bias.astype(np.float64))
    sums, n, lab = [], [], []
    for j in held:
        for m in (4, 16, 64, len(x[j])):
            part = x[j][:m]
            sums.append(table[part].sum(axis=0))
            n.append(len(part))
            lab.append(y[j])
    if not held:
        return model
    sums, n, lab = np.array(sums, np.float64), np.array(n), np.array(lab)
    best = (np.inf, (1.0, 0.0))
    for a in 2.0 ** np.arange(-3, 4):
        for n0 in (0, 2, 5, 10, 20, 50, 100):
            model.scale = (float(a), float(n0))
            p = model.scores(sums, n)[np.arange(len(lab)), lab]
            best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), model.scale))
    model.scale = best[1]
    p = model.scores(sums[3::4], n[3::4])
    right = p.max(axis=1)[p.argmax(axis=1) == lab[3::4]]
    model.threshold = float(min(0.5, np.quantile(right, REJECT))) if len(right) else 0.0
    return model


def _predict(model):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            data, at = tk.buffers(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            pred, score = [], []
            for i, j in tk.pieces(at, max(1 << 14, (1 << 22) // max(len(m.langs), 4))):
                size = np.diff(at[i : j + 1])
                sub = subwords(data[at[i] : at[j]])
                # no subword runs from one text into the next
                ends = at[i + 1 : j + 1] - at[i]
                for back in (1, 2):
                    sub[np.maximum(ends - back, 0)[(size >= back)]] = 0
                has = np.flatnonzero(size > 0)
                sums, n = np.zeros((j - i, len(m.langs))), np.zeros(j - i, np.int64)
                if len(has) and m.langs:
                    start = (at[i:j] - at[i])[has]
                    n[has] = np.add.reduceat((sub > 0).astype(np.int64), start)
                    if len(has) == 1 and len(sub) > len(m.table):  # one long text: how often it has each subword
                        sums[has[0]] = np.bincount(sub, minlength=len(m.table)) @ m.table.astype(np.float64)
                    else:
                        sums[has] = np.add.reduceat(m.table[sub], start, axis=0, dtype=np.float64)
                if m.langs:
                    p = m.scores(sums, n)
                    top = p.argmax(axis=1)  # the first of equals
                    pred += [m.langs[k] if ok else "und" for k, ok in zip(top.tolist(), letters[i:j], strict=True)]
                    score += np.where(letters[i:j], p[np.arange(j - i), top], 0.0).tolist()
                else:
                    pred += ["und"] * (j - i)
                    score += [0.0] * (j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3, batch.num_columns)), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[3:], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, held_out, lang_pred, score, rejected, and the columns `keep` (prefixed k_)."""
    model = model or fit(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    got = docs.select(F.lit(0).alias("_0"), F.coalesce(text_col, F.lit("")).alias("_t"), letter.alias("_letter"), F.col(id_col), held_out(id_col).alias("held_out"), *[F.col(c).alias(f"k_{c}") for c in keep])
    from pyspark.sql.types import StructType

    schema = StructType(list(got.schema.fields[3:])).add("lang_pred", "string").add("score", "double")
    out = got.mapInArrow(_predict(sent), schema)
    return out.select(id_col, "held_out", "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("score") < model.threshold)).alias("rejected"), *[f"k_{c}" for c in keep])
