"""N-gram Jaccard join by signature trees.

A document's set holds the distinct k-word shingles of its whole text, A-Z lower-cased, words
[^\\x20\\x09-\\x0D]+; with fewer words the whole sequence is one shingle; without words or text it is empty and
linked with nothing.  Two documents link when 100 * |A & B| >= percent * |A | B|.  Shingles are 64-bit hashes.

1. Sets that are equal are one class, known by a 64-bit hash of the set; its members are linked.
2. Classes A and B that link share at least min(l(A), l(B)) of their first |A| - ceil(t |A|) + l(A) shingles in any
   global order, l being SHARED percent of the size.  The order puts frequent shingles last; frequencies are counted
   over all documents in a sketch of fixed size, and any error there costs time, not results.  These prefix shingles
   are dealt by hash, sorted and streamed once: a shingle of one class alone is dropped, the others are cells.  A class
   in fewer cells than its smallest partner would share with it is dropped, then cells left with one class, and again.
3. Homes: each class goes, once, to the class that leads most of its cells (a home of over BLOCK classes has parts,
   the leader in each).  There a signature tree is built: leaves hold a bitmap of the set, its size and its count of
   shingles hidden by shared bits; a node holds the OR of its children's bitmaps and the ranges of the rest.  A dual
   traversal from (root, root) drops a pair of nodes when the bound on overlap is below what the smallest sizes need,
   or when both already are one component; the leaf pairs left are verified on the whole sets, and the links found join
   components.
4. Cells whose classes are of several components may hide a link yet.  Classes are pruned as in 2, counting such cells
   alone; of its c cells a class is sent to the first c - need + 1 in order of their hash, so a pair, which shares
   `need`, meets in one.  Bitmaps of SIGN_BITS bits a shingle go to these cells (of over BLOCK classes: to its pairs of
   blocks) and trees are traversed there too.  Pairs that the bounds leave are not listed: a cell gives a spanning forest
   of them, so its rows are in proportion to its classes, and the connected classes of all cells are clusters.
5. Whole sets go, once, to their cluster (of over BLOCK classes or BLOCK_BYTES: to its pairs of blocks), where a tree
   with larger bitmaps is traversed and what is left is verified on the sets.  Links that join components are returned.

Nothing is capped or sampled; a large cell or cluster becomes more blocks.  Links that are found inside a component
already connected are not looked for: the result is the components.  The empty table gives an empty result; repeated
rows are rows of one class; a missing id sorts after every other and is returned as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.common import NO_ID, Cuts, components, forest, lookup_join, partitions

U = np.uint64
#: Counters of the frequency sketch (4 bytes each): the bound of what is sent to the driver and broadcast.
SKETCH_BITS = 18
#: Bits of a leaf's bitmap for each shingle of the largest set of a group, and at most in all.
BITS_EACH, MOST_BITS = 8, 1 << 16
BLOCK, FANOUT, SHARED, PRUNES, SIGN_BITS = 1024, 8, 5, 2, 3
#: Bytes of whole sets that a block holds on the average.
BLOCK_BYTES = 16 << 20
#: Rows (of a few longs) up to which classes and their places are broadcast to the sets; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of bitmaps up to which they are broadcast to the cells; beyond, each row takes its own along.
BROADCAST_BITS = 32 << 20


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, sorted text by text, and how many each has."""
    w = tk.Words(data, at, lower=True)
    n = np.diff(w.first)
    win = w.windows(k)
    inside = w.inside(k)
    doc = w.doc_of_words()[: len(win)][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    h = np.concatenate([win[inside], w.whole()[short]])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(n))


def set_hash(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, U)
    np.cumsum(tk.mix(h * U(tk._Q) + U(1)), out=total[1:])
    end = np.cumsum(sizes)
    return tk.mix(total[end] - total[end - sizes] + sizes.astype(U) * U(tk._P)).view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, at = tk.buffers(batch.column(1))
        for i, j in tk.pieces(at):
            yield (batch.column(0).slice(i, j - i), *shingle_sets(data, at[i : j + 1], k))


def _summary(k: int) -> Callable:
    def run(batches):
        for ids, h, sizes in _each(batches, k):
            yield pa.record_batch([ids, pa.array(sizes.astype(np.int64)), pa.array(set_hash(h, sizes))], names=["_id", "n", "sid"])

    return run


def _sketch(k: int) -> Callable:
    """Counts of all shingles of a partition by slot of the sketch, the slots it has alone."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, h, _n in _each(batches, k):
            total += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        slots = np.flatnonzero(total)
        for i in range(0, len(slots), 1 << 16):
            yield pa.record_batch([pa.array(slots[i : i + (1 << 16)].astype(np.int32)), pa.array(total[slots[i : i + (1 << 16)]])], names=["slot", "n"])

    return run


def prefix_lengths(sizes: np.ndarray, percent: int, shared: int) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-percent * sizes // 100) + np.maximum(sizes * shared // 100, 1), 0)


def least_shared(n: str, percent: int, shared: int) -> Column:
    """Cells that a class shares with its smallest partner, of ceil(percent * n / 100) shingles, at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.col(n) * percent / 100) * shared / 100))


def first_tokens(h: np.ndarray, sizes: np.ndarray, want: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first `want` shingles of each set in the global order."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((h, rank[(h >> U(64 - SKETCH_BITS)).astype(np.int64)], doc))
    return h[by[tk.spread(np.cumsum(sizes) - sizes, want)]].view(np.int64)


def _prefixes(k: int, percent: int, order) -> Callable:
    def run(batches):
        rank = order.value
        for _, h, sizes in _each(batches, k):
            sid = set_hash(h, sizes)
            _, first = np.unique(sid, return_index=True)
            want = np.zeros(len(sizes), np.int64)
            want[first] = prefix_lengths(sizes, percent, SHARED)[first]
            token = first_tokens(h, sizes, want, rank)
            yield pa.record_batch([pa.array(token), pa.array(np.repeat(sid, want))], names=["token", "sid"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, sid, ...): those of tokens that two classes share."""
    token, first, shown = None, None, False
    last = None
    for batch in batches:
        t, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        new[0] = (t[0], s[0]) != last
        last = (t[-1], s[-1])
        t, s = t[new], s[new]
        if not len(t):
            continue
        head = np.ones(len(t), bool)
        head[1:] = t[1:] != t[:-1]
        joined = token is not None and t[0] == token
        head[0] = not joined
        run = np.cumsum(head) - (0 if joined else 1)  # run 0 is the one that goes on, if joined
        starts = np.flatnonzero(head)
        leads = np.concatenate([[first], s[starts]]).astype(np.int64) if joined else s[starts]
        size = np.bincount(run, minlength=len(leads))
        carried = joined
        many = size >= 2
        if carried:
            many[0] = True  # the carried class and one more
        emit = many[run]
        tt, ss = t[emit], s[emit]
        if carried and not shown and size[0]:
            tt, ss = np.concatenate([[token], tt]), np.concatenate([[first], ss])
        if len(tt):
            yield pa.record_batch([pa.array(tt.astype(np.int64)), pa.array(ss.astype(np.int64))], names=["token", "sid"])
        open_run = run[-1]
        shown = bool(many[open_run])
        token, first = t[-1], leads[open_run]


class Tree:
    """Signature tree over sets in an order that keeps like sets together; level 0 holds the leaves."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, lost: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes, lost)]
        while len(bitmaps) > 1:
            at = np.arange(0, len(bitmaps), FANOUT)
            bitmaps = np.bitwise_or.reduceat(bitmaps, at, axis=0)
            _, low, high, lost = self.levels[-1]
            low, high, lost = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)
            self.levels.append((bitmaps, low, high, lost))


def bitmaps(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], np.int64)
    width = 64
    while width < min(MOST_BITS, BITS_EACH * int(sizes.max(initial=1))):
        width *= 2
    out = np.zeros((len(values), width // 64), U)
    for i, v in enumerate(values):
        bit = np.zeros(width, bool)
        bit[(v & U(width - 1)).astype(np.int64)] = True
        out[i] = np.packbits(bit).view(U)
    return out, sizes, sizes - np.bitwise_count(out).sum(axis=1).astype(np.int64)


def traverse(bits: np.ndarray, sizes: np.ndarray, lost: np.ndarray, labels: Callable, percent: int, side: np.ndarray | None = None):
    """Dual traversal of a signature tree: yields arrays of the leaf pairs that bounds leave.

    labels() gives labellings of the leaves as they are when it is asked, the components first: pairs that one of them
    has together are left out.  side: pairs of one side are left out.
    """
    order = np.lexsort((sizes, labels()[0]))  # nodes of one component can be dropped whole
    tree = Tree(bits[order], sizes[order], lost[order])
    sides = None if side is None else side[order]
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(tree.levels) - 1, -1, -1):
        ranges = []
        for label in labels():
            low = high = label[order]
            for _ in range(level):
                cut = np.arange(0, len(low), FANOUT)
                low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            ranges.append((low, high))
        kept_a, kept_b = [], []
        bm, lo, hi, ls = tree.levels[level]
        for i in range(0, len(a), 1 << 12):
            x, y = a[i : i + (1 << 12)], b[i : i + (1 << 12)]
            if not level and i:
                ranges = [(now := label[order], now) for label in labels()]
            fits = (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])
            for low, high in ranges:
                fits &= ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
            x, y = x[fits], y[fits]
            need = -(-percent * (lo[x] + lo[y]) // (100 + percent))
            bound = np.bitwise_count(bm[x] & bm[y]).sum(axis=1) + np.minimum(ls[x], ls[y])
            ok = np.minimum(bound, np.minimum(hi[x], hi[y])) >= np.maximum(need, 1)
            x, y = x[ok], y[ok]
            if level:
                m = len(tree.levels[level - 1][1])
                each = FANOUT * FANOUT
                cx = np.repeat(x * FANOUT, each) + np.tile(np.repeat(np.arange(FANOUT), FANOUT), len(x))
                cy = np.repeat(y * FANOUT, each) + np.tile(np.arange(FANOUT), len(x) * FANOUT)
                good = (cx < m) & (cy < m) & (cx <= cy)  # x <= y: each pair of nodes once
                kept_a.append(cx[good])
                kept_b.append(cy[good])
            else:
                apart = x < y
                if sides is not None:
                    apart &= sides[x] != sides[y]
                yield order[x[apart]], order[y[apart]]
        if level:
            a, b = np.concatenate(kept_a) if kept_a else a[:0], np.concatenate(kept_b) if kept_b else b[:0]


def links(values: list[np.ndarray], comp: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of linked sets that join different components: with comp, all links' connectivity.

    side: pairs of one side are left to another group.
    """
    n = len(values)
    if n < 2:
        return []
    bits, sizes, lost = bitmaps(values)
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    found = []

    def verify(i, j):
        ra, rb = root(int(comp[i])), root(int(comp[j]))
        if ra != rb:
            both = overlap(values[i], values[j])
            if both and 100 * both >= percent * (len(values[i]) + len(values[j]) - both):
                parent[max(ra, rb)] = min(ra, rb)
                found.append((i, j))

    # the first of the group against all: a cluster becomes one component at a cost in proportion to its size
    need = -(-percent * (sizes + sizes[0]) // (100 + percent))
    bound = np.minimum(np.bitwise_count(bits & bits[0]).sum(axis=1) + np.minimum(lost, lost[0]), np.minimum(sizes, sizes[0]))
    for j in np.flatnonzero(bound >= need).tolist():
        if j:
            verify(0, j)
    for i, j in traverse(bits, sizes, lost, lambda: [np.array([root(int(c)) for c in comp])], percent, side):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            verify(p, q)
    return found


def _tree_home(percent: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "sid"], ascending=[False, True]).drop_duplicates("sid").reset_index(drop=True)
        sid = pdf["sid"].to_numpy()
        got = links([np.frombuffer(x, "<u8") for x in pdf["hashes"]], sid, percent)
        i, j = (np.array(x, np.int64) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
        return pd.DataFrame({"a": sid[i], "b": sid[j]})

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _tree_cluster(percent: int) -> Callable:
    """Links of a cluster, or of a pair of its blocks, that join components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid").reset_index(drop=True)
        sid, side = pdf["sid"].to_numpy(), pdf["side"].to_numpy()
        got = links([np.frombuffer(x, "<u8") for x in pdf["hashes"]], pdf["comp"].to_numpy(), percent, side if side.any() else None)
        i, j = (np.array(x, np.int64) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
        return pd.DataFrame({"a": sid[i], "b": sid[j]})

    return run


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: SIGN_BITS a shingle at least, in powers of two from 64."""
    return max(64, 1 << (SIGN_BITS * n - 1).bit_length())


def _signatures(batches):
    for batch in batches:
        out, sizes = [], []
        for h in batch.column(1):
            v = np.frombuffer(h.as_buffer(), "<u8")
            bit = np.zeros(width_of(len(v)), bool)
            bit[(v & U(len(bit) - 1)).astype(np.int64)] = True
            out.append(np.packbits(bit, bitorder="little").tobytes())
            sizes.append(len(v))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["sid", "n", "bits"])


class Joined:
    """Which rows' classes are connected so far."""

    def __init__(self, sid: np.ndarray, edges: tuple[np.ndarray, np.ndarray]):
        self.nodes, self.row = np.unique(sid, return_inverse=True)
        self.label, self.edges = np.arange(len(self.nodes)), edges
        node, root = edges
        if len(node):
            at = np.minimum(np.searchsorted(node, self.nodes), len(node) - 1)
            self.label = np.unique(np.where(node[at] == self.nodes, root[at], self.nodes), return_inverse=True)[1]

    def of_rows(self) -> np.ndarray:
        return self.label[self.row]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the classes of rows i and j."""
        if len(i):
            x, y = self.row[i], self.row[j]
            node, root = forest(self.label[x], self.label[y])
            to = np.arange(len(self.nodes))
            to[node] = root
            self.label = to[self.label]
            self.edges = forest(np.concatenate([self.edges[0], self.nodes[x]]), np.concatenate([self.edges[1], self.nodes[y]]))


def _small_cells(joined: Joined, rows: np.ndarray, cell: np.ndarray, side: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> None:
    """Joins pairs of rows of one cell (rows are in order of cells, cells are small) that the bounds leave."""
    width = np.array([8 * len(b) for b in bits])
    full = {w: np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(width == w).tolist()), "<u8").reshape(-1, w // 64) for w in np.unique(width).tolist()}
    row = np.zeros(len(n), np.int64)
    for w in full:
        row[width == w] = np.arange((width == w).sum())
    half = {w: m[:, : w // 128] | m[:, w // 128 :] for w, m in full.items() if w > 64}
    two = np.isin(cell, cell[side > 0])
    most = int(np.bincount(np.unique(cell, return_inverse=True)[1]).max(initial=0))
    for d in range(1, most):
        label = joined.of_rows()[rows]
        i = np.flatnonzero((cell[:-d] == cell[d:]) & (comp[:-d] != comp[d:]) & (label[:-d] != label[d:]))
        j = i + d
        ok = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i]) & (~two[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        swap = width[i] > width[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for w in np.unique(width[i]).tolist():
            for v in (w, 2 * w):
                at = np.flatnonzero((width[i] == w) & (width[j] == v))
                for k in range(0, len(at), 4096):
                    x, y = i[at[k : k + 4096]], j[at[k : k + 4096]]
                    a, b = full[w][row[x]], (full if v == w else half)[v][row[y]]
                    lost = np.minimum(n[x] - np.bitwise_count(a).sum(axis=1), n[y] - np.bitwise_count(b).sum(axis=1))
                    bound = np.minimum(np.bitwise_count(a & b).sum(axis=1) + lost, np.minimum(n[x], n[y]))
                    ok = bound >= np.maximum(-(-percent * (n[x] + n[y]) // (100 + percent)), 1)
                    joined.add(rows[x[ok]], rows[y[ok]])


def _large_cell(joined: Joined, rows: np.ndarray, side: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> None:
    """The same for one large cell, by signature trees: a tree for each width, larger bitmaps folded to it."""
    width = np.array([8 * len(b) for b in bits])
    for w in np.unique(width).tolist():
        at = np.flatnonzero((width == w) | (width == 2 * w))
        m = np.stack([np.frombuffer(bits[i], "<u8") if width[i] == w else np.bitwise_or.reduce(np.frombuffer(bits[i], "<u8").reshape(2, -1)) for i in at.tolist()])
        lost = n[at] - np.bitwise_count(m).sum(axis=1).astype(np.int64)
        labels = lambda at=at: [comp[at], joined.of_rows()[rows[at]]]
        for i, j in traverse(m, n[at], lost, labels, percent, side[at] if side.any() else None):
            keep = (width[at[i]] == w) | (width[at[j]] == w)  # both larger: their own tree has them
            joined.add(rows[at[i[keep]]], rows[at[j[keep]]])


def _cell_forest(percent: int, signs=None, small: int = 64) -> Callable:
    """A spanning forest of the pairs that cells leave; rows come sorted by cell, and a cell is at most two blocks.

    signs: broadcast (sorted sids, sizes, bitmaps), unless rows bring theirs.
    """

    def run(batches):
        edges = np.empty(0, np.int64), np.empty(0, np.int64)
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held, edges = joined(t if held is None else pa.concat_tables([held, t]), edges, last=False)
        if held is not None:
            _, edges = joined(held, edges, last=True)
        if len(edges[0]):
            yield pa.record_batch([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    def joined(t, edges, last):
        key = np.stack([t.column(k).to_numpy() for k in range(3)])
        new = np.ones(t.num_rows, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        start = np.flatnonzero(new)
        end = t.num_rows if last else int(start[-1]) if len(start) else 0
        rest = t.slice(end).combine_chunks()
        if not end:
            return rest, edges
        cell = np.cumsum(new)[:end]
        side, sid, comp = (t.column(k).to_numpy()[:end] for k in (3, 4, 5))
        if signs is None:
            n, bits = t.column(6).to_numpy()[:end], t.column(7).slice(0, end).to_pylist()
        else:
            known, sizes, maps = signs.value
            at = np.searchsorted(known, sid)
            n, bits = sizes[at], [maps[i] for i in at.tolist()]
        count = np.bincount(cell)[cell]
        some, all_ = np.flatnonzero(count <= small), Joined(sid, edges)
        if len(some):
            _small_cells(all_, some, cell[some], side[some], comp[some], n[some], [bits[i] for i in some.tolist()], percent)
        for c in np.unique(cell[count > small]).tolist():
            at = np.flatnonzero(cell == c)
            _large_cell(all_, at, side[at], comp[at], n[at], [bits[i] for i in at.tolist()], percent)
        return rest, all_.edges

    return run


def _set_rows(k: int) -> Callable:
    def run(batches):
        for _, h, sizes in _each(batches, k):
            sid = set_hash(h, sizes)
            _, first = np.unique(sid, return_index=True)
            first.sort()
            end = np.cumsum(sizes)
            raw = h.astype("<u8").tobytes()
            out = [raw[8 * (end[i] - sizes[i]) : 8 * end[i]] for i in first.tolist()]
            yield pa.record_batch([pa.array(sid[first]), pa.array(out, pa.binary())], names=["sid", "hashes"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS rows, else left to a join by shuffle.  Counts: give it a table that is cut."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _blocks(members: DataFrame, group: str) -> DataFrame:
    """(group, blocks): of BLOCK classes and BLOCK_BYTES bytes of sets (n shingles each) on the average."""
    many, large = F.count(F.lit(1)) / BLOCK, F.sum(F.col("n")) * 8 / BLOCK_BYTES
    return members.groupBy(group).agg(F.ceil(F.greatest(many, large)).cast("int").alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    cuts, parts = Cuts(spark), partitions(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    rows = cuts.cut(texts.mapInArrow(_summary(k), "_id long, n long, sid long"))
    classes = cuts.cut(rows.groupBy("sid").agg(F.first("n").alias("n"), F.min("_id").alias("_id"), F.count(F.lit(1)).alias("size")))
    slots = texts.mapInArrow(_sketch(k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2**SKETCH_BITS
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[slots["slot"].to_numpy(np.int64)] = slots["n"].to_numpy(np.int64)
    # how often, in steps of a half; where counts are alike the order is by hash
    rank = np.round(2 * np.log2(counts + 1)).astype(np.int16)
    order = spark.sparkContext.broadcast(rank)

    firsts = texts.mapInArrow(_prefixes(k, percent, order), "token long, sid long").distinct()  # a class's copies as one, before tokens are dealt
    dealt = firsts.repartition(parts, "token").sortWithinPartitions("token", "sid")
    cells = cuts.cut(dealt.mapInArrow(_cells, "token long, sid long"))
    needs = classes.select("sid", least_shared("n", percent, SHARED).alias("need"))
    by_token = Window.partitionBy("token")
    for _ in range(PRUNES):
        busy = cuts.cut(cells.groupBy("sid").agg(F.count(F.lit(1)).alias("c")).join(needs, "sid").where("c >= need").select("sid", "c", "need"))
        left = cells.select("token", "sid").join(_few(busy), "sid")
        # a cell of one class is none
        left = left.withColumn("lead", F.min("sid").over(by_token)).withColumn("many", F.max("sid").over(by_token) > F.col("lead")).where("many").drop("many")
        new = cuts.cut(left)
        cuts.drop(cells)
        cells = new
    # one document of each of these classes, found before its text is read: few ids go to the texts, many meet them by shuffle
    live = cells.select("sid").distinct()
    of_class = cuts.cut(classes.join(live, "sid", "left_semi").select("_id").distinct())
    sets = cuts.cut(texts.join(_few(of_class), "_id", "left_semi").mapInArrow(_set_rows(k), "sid long, hashes binary"))
    order.unpersist()

    best = F.max_by("lead", F.struct("n", (-F.col("lead")).alias("l")))
    home = cuts.cut(cells.groupBy("sid", "lead").agg(F.count(F.lit(1)).alias("n")).groupBy("sid").agg(best.alias("home")))
    home = home.join(classes.select("sid", "n"), "sid")
    sizes = _blocks(home, "home")
    members = home.join(sizes, "home").select("home", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("part"), "sid", (F.col("sid") == F.col("home")).alias("first"))
    heads = sizes.select("home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("home").alias("sid"), F.lit(True).alias("first"))
    placed = cuts.cut(members.unionByName(heads))
    edges = cuts.cut(sets.join(_few(placed), "sid").groupBy("home", "part").applyInPandas(_tree_home(percent), "a long, b long"))
    comp = components(cuts, edges).select(F.col("id").alias("sid"), F.col("component").alias("comp"))

    named = cells.select("token", "sid", "need").join(_few(comp), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    several = F.max("comp").over(by_token) > F.min("comp").over(by_token)
    for _ in range(PRUNES):
        named = cuts.cut(named.withColumn("several", several).where("several").drop("several"))
        busy = cuts.cut(named.groupBy("sid").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("least")).where("c >= least").select("sid", "c"))
        named = named.drop("c").join(_few(busy), "sid")
    place = F.row_number().over(Window.partitionBy("sid").orderBy("token"))
    named = named.withColumn("place", place).where(F.col("place") <= F.col("c") - F.col("need") + 1)
    named = cuts.cut(named.withColumn("several", several).where("several").select("token", "sid", "comp"))
    if not named.isEmpty():
        left = cuts.cut(named.select("sid").distinct())
        signs = cuts.cut(sets.join(_few(left), "sid", "left_semi").mapInArrow(_signatures, "sid long, n long, bits binary"))
        blocks = named.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
        b, o = F.col("part"), F.col("o")
        in_blocks = named.join(_few(cuts.cut(blocks)), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        in_blocks = in_blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least(b, o).alias("g2"), F.greatest(b, o).alias("g3"), (b > o).cast("int").alias("side"), "sid", "comp")
        group = ["token", "g2", "g3"]
        size = signs.agg(F.sum(F.octet_length("bits") + 100).alias("b")).first()["b"] or 0
        sent, extra = None, ["n", "bits"]
        if size <= BROADCAST_BITS:
            t = signs.dropDuplicates(["sid"]).orderBy("sid").toArrow()
            sent, extra = spark.sparkContext.broadcast((t["sid"].to_numpy(), t["n"].to_numpy(), t["bits"].to_pylist())), []
        else:
            in_blocks = in_blocks.join(signs, "sid")
        dealt = in_blocks.select(*group, "side", "sid", "comp", *extra).repartition(parts, *group).sortWithinPartitions(*group)
        near = components(cuts, cuts.cut(dealt.mapInArrow(_cell_forest(percent, sent), "a long, b long")))  # cut: a task has one worker
        if sent is not None:
            sent.unpersist()
        # each cluster of classes that may link, in pairs of blocks; a class's set goes there once a block of its cluster
        near = near.select(F.col("id").alias("sid"), F.col("component").alias("cluster")).join(classes.select("sid", "n"), "sid")
        near = near.join(_few(comp), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        near = cuts.cut(near.join(_blocks(near, "cluster"), "cluster").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")))
        near = near.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least(b, o).alias("g2"), F.greatest(b, o).alias("g3"), (b > o).cast("int").alias("side"), "sid", "comp")
        more = cuts.cut(sets.join(_few(cuts.cut(near)), "sid").groupBy("cluster", "g2", "g3").applyInPandas(_tree_cluster(percent), "a long, b long"))
        if not more.isEmpty():
            comp = components(cuts, edges.unionByName(more)).select(F.col("id").alias("sid"), F.col("component").alias("comp"))
    # classes to documents: smallest id of each component
    low = classes.where("n > 0").join(comp, "sid", "left").select("sid", F.col("_id").alias("low"), F.coalesce("comp", "sid").alias("comp"))
    best = low.groupBy("comp").agg(F.min("low").alias("component"))
    by_class = cuts.cut(low.join(best, "comp").select("sid", "component"))
    nul = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    sized = classes.select("sid", "size").join(by_class, "sid", "left")
    out = lookup_join(rows, sized, "sid", "size")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")))
    return out.select(nul("_id").alias(id_col), F.col("n").alias("n_shingles"), nul("component").alias("component_id"))
