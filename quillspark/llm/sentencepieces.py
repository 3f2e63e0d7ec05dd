"""SentencePiece encoding and decoding in batched numpy: Viterbi over all words of one length at once.

A text is escaped as the model says (blanks to U+2581, one in front) and cut into units that no piece crosses: blanks
with the word after them.  Units not seen before are grouped by length, a group is a matrix of code points, and all
its units advance together: at each position the hash of the substring of each length, from prefix hashes, probes the
sorted keys of the pieces (hits are compared character by character), and the best of the lengths is stored as the
backpointer by a vectorised maximum.

Unigram models score a path by the sum of its pieces.  For BPE models the path must be the one that merging by score
gives.  That path is a Viterbi path too: of the pieces that end at a position, exactly one may follow the best path to
its start, the one that no earlier merge across the seam would have prevented; others score minus infinity.  Whether a
seam holds is told by undoing merges on both sides from the last to the first and looking for a pair across the seam
that would have merged sooner.  Runs of blanks are merged from the left, as equal scores ask for.  So ids equal those
of the library for both kinds of models; characters without a piece become bytes or the unknown piece.

Decoding joins the pieces' bytes, blanks restored, and drops the one in front.  Encoding then decoding gives back the
text, but for U+2581 (a blank to the model) and, without byte pieces, unknown characters.

Null and empty texts have no ids.  Models with a character map other than identity are refused.  Very long units work,
at a cost in proportion to their length.  Repeated rows encode alike; the empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk

U = np.uint64
BLANK = "▁"
#: Characters and ids (and 32 for each unit) of the units that a task remembers; beyond, it starts anew.  Longer units
#: than LONG_UNIT are forgotten after each piece of a batch.
CACHE, LONG_UNIT = 6_000_000, 64
#: Bits of the table that tells most substrings from pieces before the keys are searched.
MAYBE_BITS = 20
_NONE = np.iinfo(np.int64).max
#: Cuts of a text into units, finest first; one is of use if each piece is one unit.
_CUTS = (r" *[^\W\d_¹²³¼½¾]+| *\d+| *(?:[^ \n\w]|[_¹²³¼½¾])+|\n+| +", r" *[^ \n]+|\n+| +")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass
class Pieces:
    """A model's pieces, ready for probing; made on the driver, sent to the workers."""

    piece: list[str]
    score: np.ndarray
    kind: np.ndarray
    bpe: bool
    prefix: bool
    squeeze: bool
    unk: int
    byte: np.ndarray
    key: np.ndarray = field(default=None)
    key_id: np.ndarray = field(default=None)
    most: int = 1
    rank: np.ndarray = field(default=None)
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    pair: np.ndarray = field(default=None)
    pair_rank: np.ndarray = field(default=None)
    runs: list[list[int]] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or m.trainer_spec.model_type not in (1, 2) or not n.escape_whitespaces:
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        kind = np.array([p.type for p in m.pieces])
        byte = np.full(256, -1)
        for i in np.flatnonzero(kind == _BYTE):
            byte[int(m.pieces[i].piece[3:5], 16)] = i
        unk = int(np.flatnonzero(kind == _UNKNOWN)[0])
        out = cls([p.piece for p in m.pieces], np.array([p.score for p in m.pieces], np.float64), kind, m.trainer_spec.model_type == 2, n.add_dummy_prefix, n.remove_extra_whitespaces, unk, byte if (byte >= 0).all() else None)
        out._prepare()
        return out

    def _prepare(self) -> None:
        ids = [i for i in np.flatnonzero(np.isin(self.kind, (_NORMAL, _USER))).tolist()]
        blanks = {i for i in ids if self.bpe and len(self.piece[i]) > 1 and not self.piece[i].strip(BLANK)}
        probed = [i for i in ids if i not in blanks]
        if any(BLANK in self.piece[i].lstrip(BLANK) for i in probed) or any(self.piece[i].startswith(BLANK * 2) for i in probed):
            raise ValueError("pieces that go on after a blank are not supported")
        keys = np.concatenate([self.hash_rows(np.array([[ord(c) for c in self.piece[i]]], np.uint64)) for i in probed])
        order = np.argsort(keys)
        self.key, self.key_id = keys[order], np.array(probed)[order]
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        self.maybe[(self.key >> U(64 - MAYBE_BITS)).astype(np.int64)] = True
        self.most = max(len(self.piece[i]) for i in probed)
        self.chars = np.zeros((len(self.piece), self.most), np.int64)
        for i in probed:
            self.chars[i, : len(self.piece[i])] = [ord(c) for c in self.piece[i]]
        if self.bpe:
            self._merges(probed, blanks)

    @staticmethod
    def hash_rows(cp: np.ndarray) -> np.ndarray:
        up, _ = tk.powers(tk._P, cp.shape[1] + 1)
        return _finish(((cp + U(1)) * up[: cp.shape[1]]).sum(axis=1, dtype=U), cp.shape[1])

    def _merges(self, probed: list[int], blanks: set[int]) -> None:
        """Rank of each piece by the order of merges, and the two pieces its last merge joins."""
        n = len(self.piece)
        by = {self.piece[i]: i for i in probed}
        many = sorted((i for i in probed if len(self.piece[i]) > 1), key=lambda i: (-self.score[i], i))
        self.rank = np.full(n + 1, -1, np.int64)  # the last is that of unknown characters
        self.rank[many] = np.arange(len(many))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        rank = self.rank.tolist()
        pairs = {}
        for i in many:
            part = list(self.piece[i])
            while len(part) > 2:
                best = min((rank[j], k) if (j := by.get(part[k] + part[k + 1], -1)) >= 0 and rank[j] < rank[i] else (n, k) for k in range(len(part) - 1))
                if best[0] == n:
                    break
                part[best[1] : best[1] + 2] = ["".join(part[best[1] : best[1] + 2])]
            if len(part) == 2 and all(p in by for p in part):
                self.left[i], self.right[i] = by[part[0]], by[part[1]]
                pairs[by[part[0]] * (n + 1) + by[part[1]]] = rank[i]
        self.reachable = (self.rank < 0) | (self.left >= 0)
        order = np.array(sorted(pairs), np.int64)
        self.pair, self.pair_rank = order, np.array([pairs[k] for k in order.tolist()], np.int64)
        # runs of blanks: equal scores merge from the left, better ones first
        run = {self.piece[i]: i for i in blanks} | ({BLANK: by[BLANK]} if BLANK in by else {})
        self.runs = [[]]
        longest = max(map(len, run), default=1)
        for k in range(1, 4 * longest + 1):
            part = [BLANK] * k
            while True:
                best = max(((self.score[run[part[j] + part[j + 1]]], -j) for j in range(len(part) - 1) if part[j] + part[j + 1] in run), default=None)
                if best is None:
                    break
                part[-best[1] : 2 - best[1]] = [part[-best[1]] + part[1 - best[1]]]
            self.runs.append([run.get(p, self.unk) for p in part])
        self.longest_run = longest

    def blank_run(self, k: int) -> list[int]:
        """Runs beyond those worked out are the longest piece again and again, as merging from the left goes."""
        n = self.longest_run
        more = max(0, -(-(k - len(self.runs) + 1) // n))
        return self.runs[n] * more + self.runs[k - more * n]

    def seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank would leave pieces a and b side by side."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), _NONE)
        n = len(self.rank)
        while len(live):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            merged = np.where(self.pair[at] == key, self.pair_rank[at], _NONE) if len(self.pair) else np.full(len(x), _NONE)
            rx, ry = self.rank[x], self.rank[y]
            bad = merged < limit
            ok[live[bad]] = False
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            later = rx > ry
            limit = np.where(later, rx, ry + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return ok

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, word after word, and how many each has; -1 - code point: no piece."""
        size = len(words[0])
        cp = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size).astype(np.int64)
        n = len(words)
        up, down = tk.powers(tk._P, size + 1)
        total = np.zeros((n, size + 1), U)
        np.cumsum((cp.astype(U) + U(1)) * up[:size], axis=1, out=total[:, 1:])
        none = len(self.piece)
        last = np.full((n, size + 1), -1, np.int64)  # best last piece of each prefix; `none` is an unknown character
        back = np.zeros((n, size + 1), np.int32)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        low = self.score[self.key_id].min() - 10 if len(self.key_id) else 0.0
        for i in range(1, size + 1):
            top, piece, step = np.full(n, -np.inf), np.full(n, none, np.int64), np.ones(n, np.int32)
            alone = np.full(n, True)
            most = min(i, self.most)
            sizes = np.arange(1, most + 1)
            h = _finish((total[:, i, None] - total[:, i - sizes]) * down[i - sizes], sizes.astype(U))
            row, m = np.nonzero(self.maybe[(h >> U(64 - MAYBE_BITS)).astype(np.int64)])  # few substrings are pieces
            h, m = h[row, m], m + 1
            at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            hit = np.flatnonzero(self.key[at] == h)
            got, row, m = self.key_id[at[hit]], row[hit], m[hit]
            if not len(row):
                same = np.empty(0, bool)
            else:  # hits are compared character by character
                place = tk.spread(np.zeros(len(m), np.int64), m)
                equal = self.chars[np.repeat(got, m), place] == cp[np.repeat(row, m), np.repeat(i - m, m) + place]
                same = np.logical_and.reduceat(equal, np.cumsum(m) - m)
            got, row, m = got[same], row[same], m[same]
            alone[row[m == 1]] = False
            if self.bpe:
                ok = self.reachable[got] & np.isfinite(best[row, i - m])
                prev = last[row, i - m]
                joined = np.flatnonzero(ok & (prev >= 0))
                ok[joined] = self.seam(prev[joined], got[joined])
                value = np.where(ok, 0.0, -np.inf)
            else:
                value = best[row, i - m] + self.score[got]
            # the maximum of each word, the shortest of equals
            order = np.lexsort((m, -value, row))
            row, first = np.unique(row[order], return_index=True)
            pick = order[first]
            better = value[pick] > -np.inf
            row, pick = row[better], pick[better]
            top[row], piece[row], step[row] = value[pick], got[pick], m[pick]
            value = best[:, i - 1] + (0.0 if self.bpe else low)  # a character without a piece
            unknown = alone & (value > top)
            top[unknown], piece[unknown], step[unknown] = value[unknown], none, 1
            best[:, i], last[:, i], back[:, i] = top, piece, step
        # backpointers of all words are followed at once, from the ends
        ids, live, end, steps = [], np.arange(n), np.full(n, size), []
        while len(live):
            p = last[live, end]
            ids.append(np.where(p < none, p, -1 - cp[live, end - 1]))
            steps.append(live)
            end = end - back[live, end]
            live, end = live[end > 0], end[end > 0]
        row = np.concatenate(steps)
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(x) for x in steps]), row))
        return np.concatenate(ids)[order], np.bincount(row, minlength=n)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of units, each blanks and then no blank."""
        forms = [u.replace(" ", BLANK) for u in units]
        if self.bpe:
            word = [f.lstrip(BLANK) for f in forms]
            lead = [len(f) - len(w) for f, w in zip(forms, word, strict=True)]
            core = [(BLANK + w if k else w) if w else "" for k, w in zip(lead, word, strict=True)]
        else:
            core, lead = forms, [0] * len(forms)
        by_size: dict[int, list[str]] = {}
        for c in set(core):
            if c:
                by_size.setdefault(len(c), []).append(c)
        known = {"": []}
        for size, group in by_size.items():
            step = max(1, 40_000 // size)  # its arrays stay in the cache
            for i in range(0, len(group), step):
                flat, count = self.viterbi(group[i : i + step])
                end = np.cumsum(count)
                known.update((w, flat[b - n : b].tolist()) for w, n, b in zip(group[i : i + step], count.tolist(), end.tolist(), strict=True))
        one = None
        if self.bpe:
            one = next((i for i in self.key_id[self.key == self.hash_rows(np.array([[ord(BLANK)]], np.uint64))[0]].tolist()), -1 - ord(BLANK))
        out = []
        for c, k in zip(core, lead, strict=True):
            ids = known[c]
            if self.bpe and k:
                if not c:
                    ids = self.blank_run(k)
                elif k > 1:
                    ids = self.blank_run(k) + ids[1:] if ids[0] == one else self.blank_run(k - 1) + ids
            out.append(self._spell(ids))
        return out

    def _spell(self, ids: list[int]) -> list[int]:
        if not ids or min(ids) >= 0:
            return ids
        out = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte is None:
                if not out or out[-1] != self.unk:  # a run of unknown characters is one unknown piece
                    out.append(self.unk)
            else:
                out += self.byte[list(chr(-1 - i).encode("utf-8", "surrogatepass"))].tolist()
        return out

    def texts_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, and where those of each start and how many they are."""
        raw = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(BLANK, " ").encode() for p, k in zip(self.piece, self.kind.tolist(), strict=True)]
        size = np.array([len(r) for r in raw])
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size


def _finish(h: np.ndarray, size) -> np.ndarray:
    return tk.mix(h + np.asarray(size, U) * U(tk._P))


class Codec:
    """Encoder and decoder of one worker, with the units it has seen."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        # units are cut further where no piece goes on: at line ends, and between letters, digits and the rest
        cut = next((c for c in _CUTS if all(re.fullmatch(c, p.replace(BLANK, " ")) for p in np.array(pieces.piece, object)[np.isin(pieces.kind, (_NORMAL, _USER))])), " *[^ ]+| +")
        self.units = re.compile(cut).findall
        self.blob, self.start, self.size = pieces.texts_of()
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.first, self.count, self.used = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.weight = 0

    def _learn(self, units: set[str]) -> None:
        plain: dict[int, list[str]] = {}
        other = []
        for u in units:
            if u[:2] == "  " or u == " ":
                other.append(u)
            else:
                plain.setdefault(len(u), []).append(u)
        for size, group in plain.items():
            step = max(1, 60_000 // size)  # its arrays stay in the cache
            for i in range(0, len(group), step):
                part = group[i : i + step]
                flat, count = self.p.viterbi([u.replace(" ", BLANK) for u in part])
                if flat.min() < 0:  # characters without a piece
                    other += part
                else:
                    self._add(part, flat, count)
        if other:
            got = self.p.encode_units(other)
            self._add(other, np.fromiter(chain.from_iterable(got), np.int32), np.array([len(g) for g in got]))

    def _add(self, units: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while n + len(units) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[n : n + len(units)] = self.used + np.cumsum(size) - size
        self.count[n : n + len(units)] = size
        self.used += len(flat)
        self.weight += len(flat) + sum(map(len, units)) + 32 * len(units)
        self.at.update(zip(units, range(n, n + len(units)), strict=True))

    def form(self, text: str) -> str:
        text = text.replace(BLANK, " ")
        if self.p.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return " " + text if text and self.p.prefix else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        per, units = [], []
        for t in texts:
            u = self.units(self.form(t)) if t else []
            per.append(len(u))
            units += u
        at = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        miss = np.flatnonzero(at < 0).tolist()
        if miss:
            new = {units[i] for i in miss}
            long = {u for u in new if len(u) > LONG_UNIT}
            self._learn(new - long)
            kept = self.used, self.weight
            self._learn(long)
            at[miss] = [self.at[units[i]] for i in miss]
        flat = self.ids[tk.spread(self.first[at], self.count[at])]
        total = np.concatenate([[0], np.cumsum(self.count[at])])
        if self.weight > CACHE:
            self._reset()
        elif miss and long:
            for u in long:
                del self.at[u]
            self.used, self.weight = kept
        end = np.cumsum(per)
        return flat, total[end] - total[end - np.array(per, np.int64)] if len(per) else np.empty(0, np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts (UTF-8) of ids, text after text."""
        out = self.blob[tk.spread(self.start[ids], self.size[ids])].tobytes()
        total = np.concatenate([[0], np.cumsum(self.size[ids])])
        end = np.cumsum(sizes)
        a, b = total[end - sizes].tolist(), total[end].tolist()
        skip = 1 if self.p.prefix else 0
        return [out[x + (skip if out[x : x + 1] == b" " else 0) : y] for x, y in zip(a, b, strict=True)]


def _encode(sent):
    def run(batches):
        codec = Codec(sent.value)  # a task's own: a reused worker keeps nothing
        for batch in batches:
            _, at = tk.buffers(batch.column(1))
            for i, j in tk.pieces(at):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids, sizes = codec.encode(texts)
                back = codec.decode(ids, sizes)
                same = [b == codec.form(t).encode("utf-8", "surrogatepass")[1 if codec.p.prefix and t else 0 :] for b, t in zip(back, texts, strict=True)]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), tk.lists(ids, sizes, pa.int32()), pa.array([len(b) for b in back], pa.int64()), pa.array(same, pa.bool_())], names=["_id", "n_tokens", "token_ids", "decoded_bytes", "round_trip"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, token_ids, and of the decoded ids: decoded_bytes, round_trip (equal to the text)."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    got = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    return got.mapInArrow(_encode(sent), "_id long, n_tokens long, token_ids array<int>, decoded_bytes long, round_trip boolean").withColumnRenamed("_id", id_col)


def _decode(sent):
    def run(batches):
        codec = Codec(sent.value)  # a task's own: a reused worker keeps nothing
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            out = codec.decode(np.concatenate(rows) if rows else np.empty(0, np.int64), np.array([len(r) for r in rows], np.int64))
            yield pa.record_batch([batch.column(0), pa.array([b.decode("utf-8", "replace") for b in out], pa.string())], names=["_id", "text"])

    return run


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row a row: id and the text of its ids (null: empty)."""
    sent = rows.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    return rows.select(F.col(id_col).cast("long").alias("_id"), ids_col).mapInArrow(_decode(sent), "_id long, text string").withColumnRenamed("_id", id_col)
