"""Line dedup, hard negatives and lexical search against brute force: nulls, blanks, ties, repeats, empty tables, clashes."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import hard_negatives as hn
from quillspark.llm import lexical_index as lex
from quillspark.llm import line_dedup as ld
from quillspark.llm.common import Cuts

EXTRA = ", n int, size int, id int, pos int, word int, label2 string"


def docs(spark, rows, pieces=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "k") for r in rows], "doc_id long, text string" + EXTRA).repartition(pieces)


# --- lines


def some_lines(seed):
    rng = random.Random(seed)
    common = [("Line number %d " % i) * 4 for i in range(6)] + ["é" * 40, "x" * 39, "\t " + "SHOUTED line " * 4 + " \r"]
    rows = []
    for i in range(60):
        own = [f"{i} own {j}" * rng.choice([1, 5]) for j in range(rng.randrange(4))]
        text = own + [rng.choice([c, c.lower(), f"  {c}\t"]) for c in common if rng.random() < rng.choice([0.02, 0.1, 0.5])]
        rng.shuffle(text)
        rows.append((i, "\n".join(text + text[:1] * rng.choice([0, 1]))))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join([common[0]] * 200 + ["y"] * 300 + [common[1]])), (None, common[0]), (None, common[0] + "\n" + common[2]), (63, common[3]), (5, "again\n" + common[0])]
    return rows + [rows[3], rows[3]]


def lines_by_hand(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    low = lambda i: -(2**63) if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(low(i))
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if not (len(held[key(y)]) >= min_docs and low(i) < max(held[key(y)]))]
        out.append((i, len(x), len(x) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, sample", [(0.25, 32), (0.0, 1), (1e9, 32)])
def test_lines(spark, monkeypatch, hot, sample):
    """All keys hot, or none, gives the same rows."""
    monkeypatch.setattr(ld, "HOT", hot)
    monkeypatch.setattr(ld, "SAMPLE", sample)
    rows = some_lines(3)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in ld.line_dedup(docs(spark, rows)).collect()), key=str)
    assert got == lines_by_hand(rows) and sum(r[2] for r in got) > 60


def test_line_bitmaps(spark):
    """Words of 64 lines; those without a loss, and documents without one, are not stored."""
    line = "a line that is long enough to be looked at"
    rows = [(i, line) for i in range(5)] + [(-1, "\n".join(["short"] * 130 + [line, "end"]))]
    got = {r["_id"]: r for r in ld.keep_bitmaps(docs(spark, rows)).collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3]
    assert [(w.word, w.keep) for w in got[-1].words] == [(2, ~(1 << 2))] and got[-1].n_dropped == 1


def test_lines_without_rows(spark):
    assert ld.line_dedup(docs(spark, [])).collect() == []
    assert [tuple(r) for r in ld.line_dedup(docs(spark, [(1, None)])).collect()] == [(1, 1, 0, "")]


# --- hard negatives


def negatives_by_hand(rows, k=5, low=80, every=100, shift=7):
    good = []
    for i, v, lab in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i is not None and i % shift == 0 else lab
        good.append((i, lab, [max(-(2**24), min(2**24, math.floor(256 * float(np.float32(x))))) for x in v]))
    last = lambda i: 2**63 - 1 if i is None else i
    out = []
    for i in sorted({g[0] for g in good if g[0] is not None and g[0] % every == 0}):
        anchor = min((g for g in good if g[0] == i), key=lambda g: (g[1], len(g[2]), np.array(g[2], np.int32).tobytes()))
        scored = sorted(((-sum(a * b for a, b in zip(anchor[2], g[2])), last(g[0]), g[1]) for g in good if g[0] != i and len(g[2]) == len(anchor[2])))
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:k]:
            fit = [x for x in scored if x[2] != anchor[1] and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p if p < 2**63 - 1 else None, n, x[1] if x[1] < 2**63 - 1 else None, -s, -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(seed, n=700, dim=6):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centre)], rng.randrange(10)) for i in range(n)]
    rows += [(n + i, list(rows[100][1]), rows[100][2]) for i in range(30)] + [(n + 50 + i, list(rows[200][1]), (rows[200][2] + 1) % 10) for i in range(30)]
    rows += [(1000, None, 1), (1100, [1.0] * dim, None), (1200, [float("nan")] * dim, 2), (1300, [None] * dim, 2), (1400, [0.0] * dim, 3), (1500, [1.0] * dim, 4), (None, [1.0] * dim, 4), (None, [1.0] * dim, 5), (1501, [float("inf")] * dim, 4), (1600, [1e9] * dim, 4), (1601, [1e9] * dim, 5)]
    return rows + [rows[11], rows[11], rows[300]]


@pytest.mark.parametrize("block, clusters", [(4096, 8), (40, 3), (7, 1)])
def test_negatives(spark, block, clusters):
    """Pieces and sub-lists of any size give the same rows."""
    rows = vectors(4)
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, label int, id int, q string").repartition(3)
    got = sorted((tuple(r) for r in hn.hard_negatives(df, block=block, clusters=clusters).collect()), key=str)
    assert got == negatives_by_hand(rows) and len(got) > 50


def test_negatives_other_lengths(spark):
    rows = [(100, [1.0, 0.0], 1), (200, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.1], 2), (3, [1.0, 0.2, 0.0], 1), (4, [0.9, 0.0, 0.0], 3), (300, [], 1), (5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in hn.hard_negatives(df).collect()), key=str) == negatives_by_hand(rows) != []
    assert hn.hard_negatives(df.where("vec_id < 0")).collect() == [] == hn.hard_negatives(df.where("vec_id = 1")).collect()


def test_bounds_hold():
    """No anchor of a cluster scores above the bound with any row."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(-300, 300, (80, 8)).astype(float), rng.integers(-900, 900, (400, 8)).astype(float)
    n, m = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    c = hn.centroids(x / n[:, None], 5)
    at, wide = hn.angles(x, n, c).argmin(1), hn.angles(x, n, c).min(1)
    for i in range(len(c)):
        if (at == i).any():
            b = hn.bounds(hn.angles(y, m, c)[:, i], m, wide[at == i].max())
            assert (hn._scores(x[at == i], y) <= n[at == i][:, None] * b[None] + 1e-6).all()


# --- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found_by_hand(rows, items, top=20):
    terms = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    tfs = [(i, Counter(terms(t))) for i, t in rows]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n, length = len(tfs), sum(x[2] for x in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out, texts = [], {}
    for i, t in items:
        texts[i] = min((x for x in (t, texts.get(i, t)) if x is not None), default=None)
    for item, text in texts.items():
        scored = []
        for i, c, m in tfs:
            m = 75 + (25 * m * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, 2**63 - 1 if i is None else i))
        out += [(item, r, i if i < 2**63 - 1 else None, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def story(seed, n=300):
    rng = random.Random(seed)
    word = [rng.choice("abcdé字") + rng.choice(["", "x", "Y", "7"]) * rng.randrange(3) for _ in range(40)]
    text = lambda k: "".join(rng.choice(word) + rng.choice([" ", "-", "\n", "_", "'"]) for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 3, 20, 20, 100]))) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)] + [(900, None), (901, ""), (902, " .. "), (None, text(30)), (None, text(4)), (903, "long " * 5000 + text(2000)), rows[3], rows[3]]
    return rows, [(i, text(rng.choice([0, 2, 15]))) for i in range(25)] + [(30, None), (31, "nowhere to be seen"), (None, text(5)), (32, rows[7][1]), (32, "~" + rows[7][1])]


@pytest.mark.parametrize("postings, documents, items", [(200_000, 1024, 512), (300, 9, 512), (50, 2, 4)])
def test_search(spark, monkeypatch, postings, documents, items):
    """Shelves and blocks of items of any size give the same rows."""
    monkeypatch.setattr(lex, "POSTINGS", postings)
    monkeypatch.setattr(lex, "DOCS", documents)
    monkeypatch.setattr(lex, "ITEMS", items)
    rows, asked = story(8)
    q = spark.createDataFrame([(*r, "t", 1) for r in asked], "item_id long, text string, term string, n int").repartition(2)
    got = sorted((tuple(r) for r in lex.ranked_search(docs(spark, rows), q).collect()), key=str)
    assert got == found_by_hand(rows, asked) and len(got) > 300


def test_index_serves_again(spark):
    rows, asked = story(9, 80)
    cuts = Cuts(spark)
    index = lex.build_index(docs(spark, rows), cuts=cuts)
    for part in (asked[:5], asked[5:]):
        q = spark.createDataFrame(part, "item_id long, text string")
        assert sorted((tuple(r) for r in lex.search(index, q, top=3, cuts=cuts).collect()), key=str) == found_by_hand(rows, part, 3)
    assert index.shelves.selectExpr("max(size(ids))").first()[0] <= lex.DOCS


def test_search_without_rows(spark):
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = docs(spark, [(1, "a")])
    assert lex.ranked_search(docs(spark, []), q).collect() == [] == lex.ranked_search(some, q.where("item_id < 0")).collect()
    assert lex.ranked_search(docs(spark, [(1, None), (2, "..")]), q).collect() == []
