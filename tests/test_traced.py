"""Timelines of many targets and words of texts without blanks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import extract, segment
from quillspark.operators.timelines import pair_of, timelines


def test_pairs_of_targets(spark):
    rows = [("孙悟空和唐僧的关系变化", None), ("悟空", "悟空 八戒 之间的关系"), ("悟空", "悟空在哪"), (None, None), ("a, Anna; Anna/Bella|Carla", ""), ("Anna", "关系")]
    got = [r.p for r in spark.createDataFrame(rows, "t string, q string").select(pair_of("t", "q").alias("p")).collect()]
    assert got == [["孙悟空", "唐僧"], ["悟空", "八戒"], ["悟空"], [], ["Anna", "Bella"], []]


def _plain(targets, chunks, facts, relations, top_k):
    def cut(text, a, b):
        flat = " ".join(text.split())
        return flat[max(0, min(flat.find(a), flat.find(b)) - 80) : max(flat.find(a) + len(a), flat.find(b) + len(b)) + 140]

    out = []
    for tid, book, name, other, lo, hi in targets:
        if name is None or book is None:
            continue
        inside = lambda c, lo=lo, hi=hi: (lo is None or c >= lo) and (hi is None or c <= hi)
        every = []
        if other is not None:
            hits = [r for r in relations if r[0] == book and ((name in r[2] and other in r[3]) or (other in r[2] and name in r[3]))]
            hits.sort(key=lambda r: (r[5], r[6], -r[7], -r[8], r[1]))
            every += [("relation_state", r[1], r[5], f"{r[2]} -{r[4]}- {r[3]}") for r in hits[:10] if inside(r[5])]
            every += [("relation_context", i, c, cut(x, name, other)) for b, c, i, x in sorted(chunks) if b == book and inside(c) and name in x and other in x][:10]
        every += [("target_mention", i, c, cut(x, name, name)) for b, c, i, x in sorted(chunks) if b == book and inside(c) and name in x][:20]
        every += [("chapter_fact", i, c, cut(x, name, name)) for b, c, i, x in sorted(facts) if b == book and inside(c) and name in x][:10]
        ranked = sorted(((c, x, n, k, i) for n, (k, i, c, x) in enumerate(every)))[:top_k]
        out += [(tid, n, k, i, c, x, ref) for n, (c, x, ref, k, i) in enumerate(ranked, 1)]
    return out


def test_timelines_equal_plain_searches(spark):
    rng = random.Random(5)
    names = ["Anna", "Annabel", "Berta", "Carlo", "Dolores"]
    line = lambda: " ".join(rng.choice([*names, "walked", "  home\t", "x" * rng.randint(1, 60)]) for _ in range(rng.randint(1, 12)))
    chunks = [(b, c, 100 * c + i, line()) for b in ("p", "q") for c in range(1, 31) for i in range(3)]
    facts = [(b, c, c, line()) for b in ("p", "q") for c in range(1, 31)]
    relations = [(b, i, *rng.sample(names, 2), "KNOWS", rng.randint(1, 5), rng.randint(5, 9), rng.randint(1, 3), 0.5) for b in ("p", "q") for i in range(60)]
    targets = [(f"{b}{a}{o}{lo}", b, a, o, lo, hi) for b in ("p", "q") for a in names for o in (*names, None) if a != o for lo, hi in ((None, None), (3, 12), (7, None))]
    targets += [("again", "p", "Anna", "Berta", None, None), ("none", "p", "Nobody", "Anna", None, None), ("null", "p", None, "Anna", None, None), ("nobook", None, "Anna", None, None, None)]
    frames = (
        spark.createDataFrame(targets, "target_id string, book string, name string, other string, first long, last long"),
        spark.createDataFrame([*chunks, ("p", 1, 999, None), (None, 1, 998, "Anna")], "book string, chapter_id long, id long, content string"),
        spark.createDataFrame([*facts, ("p", 1, 999, None)], "book string, chapter_id long, id long, text string"),
        spark.createDataFrame([*relations, ("p", 99, None, None, "KNOWS", 1, 1, 1, 1.0)], "book string, id long, source string, target string, type string, first_chapter long, last_chapter long, strength long, confidence double"),
    )
    for k in (20, 7):
        got = timelines(*frames, top_k=k).select("target_id", "rank", "kind", "source_id", "chapter_id", "excerpt", "evidence_ref").collect()
        want = [(t, r, kind, i, c, x, ref) for t, r, kind, i, c, x, ref in _timelines_want(targets, chunks, facts, relations, k)]
        assert sorted(map(tuple, got)) == sorted(want)
    empty = [f.where("false") for f in frames]
    assert timelines(frames[0], *empty[1:]).count() == 0 and timelines(empty[0], *frames[1:]).count() == 0


def _timelines_want(targets, chunks, facts, relations, k):
    # chunks and facts are cut at the smaller of top_k and their limit
    def few(kind, most):
        return min(k, most) if kind != "relation_state" else most

    out = []
    for t in targets:
        kept, seen = [], {}
        for row in sorted(_plain([t], chunks, facts, relations, 10**6), key=lambda r: r[6]):
            seen[row[2]] = seen.get(row[2], 0) + 1
            if seen[row[2]] <= few(row[2], {"relation_state": 10, "relation_context": 10, "target_mention": 20, "chapter_fact": 10}[row[2]]):
                kept.append(row)
        ranked = sorted((r[4], r[5], n, r[2], r[3]) for n, r in enumerate(kept))[:k]
        out += [(t[0], n, kind, i, c, x, ref) for n, (c, x, ref, kind, i) in enumerate(ranked, 1)]
    return out


def _every_path(text, cost, unknown, longest):
    if not text:
        return [(0, ())]
    out = []
    for n in range(1, min(longest, len(text)) + 1):
        c = cost.get(text[:n], unknown if n == 1 else None)
        if n == 1 and c is not None:
            c = min(c, unknown)
        if c is not None:
            out += [(c + rest, (n, *p)) for rest, p in _every_path(text[n:], cost, unknown, longest)]
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_segmentation_is_the_cheapest_path(spark, monkeypatch, most):
    monkeypatch.setattr(segment, "BROADCAST_WORDS", most)
    rng = random.Random(2)
    letters = "悟空八戒ab𠀀"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(40)}
    book = segment.costs(spark.createDataFrame([*words.items(), (None, 3), ("z", 0), ("", 5)], "word string, n long"))
    cost = {r.word: r.cost for r in book.collect()}
    assert set(cost) == set(words)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "。。"), (103, "悟，空"), (None, texts[0])]
    got = {}
    for r in segment.segment(spark.createDataFrame(rows, "id long, t string"), ["id"], "t", book, longest=3).orderBy("run", "pos").collect():
        got.setdefault(r.id, []).append((r.run, r.word))
    unknown = max(cost.values()) + segment.UNIT
    for i, t in enumerate(texts):
        best = min(_every_path(t, cost, unknown, 3), key=lambda p: (p[0], tuple(-n for n in p[1])))[1]
        ends = [sum(best[:j]) for j in range(len(best) + 1)]
        assert got[i] == [(0, t[a:b]) for a, b in zip(ends, ends[1:])]
    assert not {100, 101, 102} & set(got) and [r for r, _ in got[103]] == [0, 1] and got[None] == got[0]
    assert segment.segment(spark.createDataFrame([], "id long, t string"), ["id"], "t", book).count() == 0
    none = segment.segment(spark.createDataFrame([(1, "悟空")], "id long, t string"), ["id"], "t", book.where("false"))
    assert sorted(r.word for r in none.collect()) == sorted("悟空")


def test_segmentation_with_a_dictionary_in_slices(spark, monkeypatch):
    """Slices of the dictionary and runs cut a few places at a time, against the path of one run alone."""
    monkeypatch.setattr(segment, "SLICE", 100)
    monkeypatch.setattr(segment, "PLACES", 50)
    rng = random.Random(5)
    words = {"".join(rng.choice("abcß𠀀") for _ in range(rng.randint(1, 5))): rng.randint(1, 99) for _ in range(600)}
    book = segment.costs(spark.createDataFrame(list(words.items()), "word string, n long"))
    cost = {r.word: r.cost for r in book.collect()}
    assert len(segment._sent(book, len(cost), int)) >= 4
    texts = ["".join(rng.choice("abcß𠀀x") for _ in range(rng.choice((1, 7, 40, 300)))) for _ in range(50)]
    got = {}
    for r in segment.segment(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t", book, longest=5).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.word)
    unknown = max(cost.values()) + segment.UNIT
    for i, t in enumerate(texts):
        edges = [(a, n, cost[t[a : a + n]]) for a in range(len(t)) for n in range(1, min(5, len(t) - a) + 1) if t[a : a + n] in cost]
        ends = [0, *segment.best_path(len(t), edges, unknown)]
        assert got[i] == [t[a:b] for a, b in zip(ends, ends[1:])]


def test_candidates_of_text_without_blanks(spark):
    words = segment.costs(spark.createDataFrame([("悟空", 50), ("取经", 9), ("走", 9), ("了", 90)], "word string, n long"))
    df = spark.createDataFrame([(1, "悟空走了取经走了悟空，唐僧师父道：取经。")], "id long, t string")
    got = {(r.term, r.n) for r in extract.candidates(df, ["id"], "t", "", words=segment.segment(df, ["id"], "t", words)).select("term", F.col("n")).collect()}
    assert {("悟空", 2), ("取经", 2), ("唐僧师父", 2)} <= got  # by its title and as a speaker


def test_searches_that_begin_alike_share_their_postings(spark):
    """The first of each range: open ends, rows without a chapter, ranges that end before the first `most` do."""
    from quillspark.operators.timelines import _earliest

    at = [(None, 0), *((c, c * 10) for c in range(9))]
    p = spark.createDataFrame([("b", "x", c, i) for c, i in at], "book string, name string, chapter_id long, id long")
    asked = [(None, None), (None, 1), (None, 7), (2, None), (2, 3), (8, 3)]
    s = spark.createDataFrame([("b", "x", *r) for r in asked], "book string, name string, first long, last long")
    got = {}
    for r in _earliest(s, p, ["book", "name"], [F.col("chapter_id"), F.col("id")], 3).orderBy("_n").collect():
        got.setdefault((r.first, r.last), []).append(r.chapter_id)
    assert got == {(None, None): [None, 0, 1], (None, 1): [0, 1], (None, 7): [0, 1, 2], (2, None): [2, 3, 4], (2, 3): [2, 3]}


_CHUNKS, _FACTS = "book string, chapter_id long, id long, content string", "book string, chapter_id long, id long, text string"
_TARGETS, _RELATIONS = "target_id string, book string, name string, other string, first long, last long", "book string, id long, source string, target string, type string, first_chapter long, last_chapter long, strength long, confidence double"


def shuffled(spark):
    """Records that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_timelines_shuffle_only_the_first_that_they_find(spark):
    """Words that are no names, and what is found beyond the limits, stay in their tasks, also where nothing is broadcast by itself."""
    chunks = spark.range(0, 4000, 1, 4).selectExpr("'p' AS book", "id AS chapter_id", "id", "concat_ws(' ', 'Anna', transform(sequence(1, 50), i -> concat('Word', substring(translate(hex(id * 50 + i), '0123456789', 'ghijklmnop'), 1, 9)))) AS content")
    targets = spark.createDataFrame([("t", "p", "Anna", "Berta", None, None)], _TARGETS)
    none = spark.createDataFrame([], _FACTS), spark.createDataFrame([], _RELATIONS)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert [r.chapter_id for r in timelines(targets, chunks, *none).orderBy("rank").collect()] == list(range(20))
        assert shuffled(spark) - before < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_timelines_in_rounds(spark, monkeypatch):
    from quillspark.operators import timelines as module

    names = ["Anna", "Berta", "Carlo"]
    chunks = spark.createDataFrame([("p", c, 10 * c, f"{names[c % 3]} met {names[c % 2]} at  home") for c in range(30)], _CHUNKS)
    relations = spark.createDataFrame([("p", i, names[i % 3], names[(i + 1) % 3], "KNOWS", i, i + 1, 1, 0.5) for i in range(9)], _RELATIONS)
    targets = spark.createDataFrame([(f"{a}{b}{i}", "p", a, b, i or None, None) for a in names for b in [*names, None] if a != b for i in range(3)], _TARGETS)
    frames = targets, chunks, chunks.withColumnRenamed("content", "text"), relations
    want = sorted(map(str, timelines(*frames).collect()))
    monkeypatch.setattr(module, "ROUND", 5)
    assert sorted(map(str, timelines(*frames).collect())) == want and want


def test_timelines_where_the_order_leaves_ties(spark):
    """Relations that are equal in all that orders them go by source, then target; a chunk that is there twice counts twice."""
    want = [f"Anna{x} -KNOWS- Berta{y}" for x in "abc" for y in "abc"]
    relations = spark.createDataFrame([("p", 7, f"Anna{x}", f"Berta{y}", "KNOWS", 1, 2, 3, 0.5) for x in "cab" for y in "bca"], _RELATIONS)
    chunks = spark.createDataFrame([("p", c, c, "Anna and Berta") for c in range(3, 11)] * 2, _CHUNKS)
    got = timelines(spark.createDataFrame([("t", "p", "Anna", "Berta", None, None)], _TARGETS), chunks, spark.createDataFrame([], _FACTS), relations, 60).orderBy("evidence_ref").collect()
    assert [r.excerpt for r in got if r.kind == "relation_state"] == want
    assert [r.chapter_id for r in got if r.kind == "relation_context"] == [c for c in range(3, 8) for _ in range(2)]
    assert [r.chapter_id for r in got if r.kind == "target_mention"] == [c for c in range(3, 11) for _ in range(2)]


def test_white_space_of_excerpts_is_that_of_the_sql(spark):
    import duckdb

    from quillspark.operators.timelines import around
    from quillspark.plans.traced import _FLAT

    texts = ["\xa0　 Anna\x0b\x0bwalked\x85\x85 home ", "\t\tAnna \x0b\n\r\f home\x1c\x1c", "\x0bAnna\xa0 \xa0home\x0b", " \xa0 \t Anna "]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(around("t", F.lit("Anna"), F.lit("Anna"))).collect()]
    flat = [duckdb.execute(f"SELECT {_FLAT.format('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for t in texts]
    assert got == flat


def test_dictionaries_pass_the_driver_as_bytes(spark, monkeypatch):
    """Pieces that tasks have sorted and packed: the driver collects no rows of words, and slices hold all of them."""
    import numpy as np
    import pyspark.sql.classic.dataframe as classic

    words = spark.range(3000).selectExpr("concat('w', id) AS word", "id AS cost")
    want = sorted((r.h % (1 << 64), r.g, r.cost) for r in words.select(segment._hashed("word").alias("x"), "cost").select("x.*", "cost").collect())

    def never(self):
        raise AssertionError("words are collected")

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(classic.DataFrame, name, never)
    monkeypatch.setattr(segment, "SLICE", 1000)
    monkeypatch.setattr(segment, "PIECE", 100, raising=False)
    slices = [w.value for w in segment._sent(words, 3000, np.int32)]
    assert len(slices) == 4 and all(len(set((h >> np.uint64(62)).tolist())) == 1 for h, _, _ in slices)
    assert [x for s in slices for x in zip(*(a.tolist() for a in s))] == want
    none = segment._sent(words.where("false"), 1, np.int64)
    assert [len(a) for a in none[0].value] == [0, 0, 0]
