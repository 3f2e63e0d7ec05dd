"""Greedy profiles, governed names, incremental facts, change sets and reviews, by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import folds, graph
from quillspark.operators import governance as gov
from quillspark.operators import relational as rel
from quillspark.sources.keyed import KeyedTable

SF = "/root/testdata/sf0.001"


def greedy(pairs, names):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(names):
        if n not in out:
            out[n] = n
            for x in near.get(n, ()):
                out.setdefault(x, n)
    return out


@pytest.mark.parametrize("serial", [200_000, 3, 0])
def test_greedy_profiles(spark, monkeypatch, serial):
    """Components worked off one by one, or in rounds, or both."""
    monkeypatch.setattr(graph, "SERIAL", serial)
    rng = random.Random(6)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = [tuple(rng.sample(names[:100], 2)) for _ in range(90)] + [("n001", "n001"), ("n100", "n101"), ("n101", "n102")]
    p = spark.createDataFrame([("b", *x) for x in pairs] + [("z", "n100", "n119")], "book string, name_a string, name_b string")
    n = spark.createDataFrame([(b, x) for b in "bz" for x in names] + [("b", "n001")], "book string, name string")
    got = {(r.book, r.name): r.canonical for r in graph.direct_clusters(p, n, "book").collect()}
    assert got == {("b", k): v for k, v in greedy(pairs, names).items()} | {("z", k): v for k, v in greedy([("n100", "n119")], names).items()}


def test_greedy_profiles_of_a_chain_and_a_hub(spark, monkeypatch):
    chain = [f"c{i:04d}" for i in range(1000)]
    p = spark.createDataFrame([("b", a, b) for a, b in zip(chain, chain[1:], strict=False)], "book string, name_a string, name_b string")
    n = spark.createDataFrame([("b", x) for x in chain], "book string, name string")
    assert {r.name: r.canonical for r in graph.direct_clusters(p, n, "book").collect()} == greedy(list(zip(chain, chain[1:], strict=False)), chain)
    monkeypatch.setattr(graph, "SERIAL", 50_000)  # the hub is decided in rounds
    hub = spark.range(100_000).select(F.lit("b").alias("book"), F.lit("hub").alias("name_a"), F.format_string("leaf%06d", "id").alias("name_b"))
    names = hub.select("book", F.col("name_b").alias("name")).unionByName(hub.select("book", F.col("name_a").alias("name")).limit(1))
    r = graph.direct_clusters(hub, names, "book").groupBy("canonical").count().collect()
    assert [(x.canonical, x["count"]) for x in r] == [("hub", 100_001)]


def test_governed_profiles_of_all_books(spark):
    merges = registry.queries()["governed_names"](spark, SF).select("book", "name_a", "name_b").collect()
    rows = registry.queries()["governed_profiles"](spark, SF).collect()
    for book in {r.book for r in rows}:
        names = {x for r in rows if r.book == book for x in (r.name, *r.aliases)}
        want = greedy([(r.name_a, r.name_b) for r in merges if r.book == book], names)
        assert {x: r.name for r in rows if r.book == book for x in (r.name, *r.aliases)} == want
    assert any(r.aliases for r in rows)


def test_decisions(spark):
    """Titles, edits and hints; a hinted pair that a rule blocks is merged, pairs of different chapters are not met."""
    m = [(1, "李逵"), (1, "李逵先生"), (1, "李四"), (1, "赵四"), (1, "abcd"), (1, "abce"), (1, "Zed"), (1, "Omega"), (2, "abcf"), (3, "Zed")]
    mentions = spark.createDataFrame([("b", *x) for x in m], "book string, chapter_id int, name string")
    hints = spark.createDataFrame([("b", "Zed", "Omega"), ("b", "赵四", "李四"), ("b", "Zed", "abcf"), ("b", "Zed", "Zed"), ("c", "abcd", "Zed")], "book string, name string, alias string")
    got = {(r.name_a, r.name_b): (r.confidence, r.by_rule, r.hinted) for r in gov.decisions(mentions, hints).collect()}
    assert got == {("李逵", "李逵先生"): (0.6, "MERGE", False), ("李四", "李逵"): (0.7, "MERGE", False), ("Omega", "Zed"): (0.7, "UNCERTAIN", True), ("李四", "赵四"): (0.95, "BLOCK", True)}
    assert gov.decisions(mentions.limit(0), hints).collect() == []


def test_last_before_of_one_key(spark):
    """One key holds nearly all rows, over many ranges."""
    rng = random.Random(1)
    rows = [(1 if i % 50 else i, i, rng.choice([None, None, f"v{i}"])) for i in range(3000)]
    got = {(r.k, r.i): r.before for r in rel.last_before(spark.createDataFrame(rows, "k int, i int, v string").repartition(7), ["k"], ["i"], "v", "before").collect()}
    last = {}
    for k, i, v in rows:
        assert got[k, i] == last.get(k)
        last[k] = v or last.get(k)


def test_facts_by_batch(spark, tmp_path):
    """More mentions of a pair than a double remembers, cut into batches anyhow; a batch that comes again is not counted."""
    rng = random.Random(3)
    rows = [("b", "x", "y", "t", rng.choice("PN"), rng.random(), i // 3, i % 3) for i in range(4000)] + [("b", "x", "z", "t", "P", 0.5, 7, 1)]
    ddl = "book string, source string, target string, type string, polarity string, confidence double, chapter_id long, seq int"
    df = spark.createDataFrame(rows, ddl).repartition(5)
    table = KeyedTable(spark, f"file://{tmp_path}/f", "book string, source string, target string, type string, strength long, polarity string, first_chapter long, last_chapter long, confidence double", ["book", "source", "target", "type"], 2)
    facts = folds.RelationFacts(table, ["chapter_id", "seq"])
    for n, (a, b) in enumerate([(0, 2), (2, 700), (700, 710), (710, 9999)]):
        part = df.where(F.col("chapter_id").between(a, b - 1))
        assert facts.add(part, n) and not facts.add(part, n)
    acc = None
    for r in rows[:4000]:
        acc = r[5] if acc is None else (acc + r[5]) / 2
    got = {r.target: r for r in table.read().collect()}
    assert got["y"].strength == 4000 and got["y"].polarity == rows[0][4] and (got["y"].first_chapter, got["y"].last_chapter) == (0, 1333) and abs(got["y"].confidence - acc) < 1e-12
    assert got["z"].confidence == 0.5 and got["z"].strength == 1
    whole = {r.target: r.confidence for r in folds.relation_facts(df, table.keys, ["chapter_id", "seq"]).collect()}
    assert abs(whole["y"] - acc) < 1e-12 and whole["z"] == 0.5


def quality_tables(spark, tmp_path):
    f = KeyedTable(spark, f"file://{tmp_path}/f", "id long, book string, source string, target string, type string, confidence double, status string", ["id"], 2)
    e = KeyedTable(spark, f"file://{tmp_path}/e", "id long, type string, description string, summary string", ["id"], 2)
    f.upsert(spark.createDataFrame([
        (1, "b", "Tom", "Ann", "t", 0.5, "ACTIVE"), (2, "b", "Tommy", "Ann", "t", 0.9, "ACTIVE"), (3, "b", "Tommy", "Bob", "t", 0.4, "ACTIVE"), (4, "b", "Thomas", "Bob", "t", 0.6, "ACTIVE"),
        (5, "b", "Bob", "Tommy", "t", 0.8, "ACTIVE"), (6, "b", "Tommy", "Bob", "u", 0.1, "MERGED"), (7, "b", "未知", "Tommy", "t", 0.1, "ACTIVE"), (8, "c", "Tommy", "Bob", "t", 0.1, "ACTIVE"),
    ], f.schema))
    e.upsert(spark.createDataFrame([(1, "war", " it began ", None), (2, "war", " ", ""), (3, "war", "x", "told"), (4, None, None, None)], e.schema))
    p = spark.createDataFrame([("b", "Tom", ["Tommy", "Thomas", "未知"]), ("b", "Ann", None)], "book string, name string, aliases array<string>")
    return f, e, p


def test_quality_stages(spark, tmp_path):
    f, e, p = quality_tables(spark, tmp_path)
    before = sorted(map(str, f.read().collect() + e.read().collect()))
    dry = sorted(tuple(r) for r in gov.quality(f, e, p).select("stage", "id", "column", "after").collect())
    assert sorted(map(str, f.read().collect() + e.read().collect())) == before  # nothing is written
    # 2 meets 1, which has the key already; 4 meets 3, both moved; 5 is 3 the other way round and more confident
    assert dry == [("names", 2, "status", "MERGED"), ("names", 3, "source", "Tom"), ("names", 4, "status", "MERGED"), ("names", 5, "target", "Tom"), ("names", 7, "target", "Tom"), ("relations", 3, "status", "MERGED"), ("summaries", 1, "summary", "it began"), ("summaries", 2, "summary", "war")]
    assert sorted(tuple(r) for r in gov.quality(f, e, p, dry_run=False).select("stage", "id", "column", "after").collect()) == dry
    got = {r.id: (r.source, r.target, r.status) for r in f.read().collect()}
    assert got[2] == ("Tommy", "Ann", "MERGED") and got[3] == ("Tom", "Bob", "MERGED") and got[5] == ("Bob", "Tom", "ACTIVE") and got[6] == ("Tommy", "Bob", "MERGED") and got[7][0] == "未知" and got[8] == ("Tommy", "Bob", "ACTIVE")
    assert {r.id: r.summary for r in e.read().collect()} == {1: "it began", 2: "war", 3: "told", 4: None}
    assert gov.quality(f, e, p, dry_run=False).collect() == []


def test_reviews(spark):
    """Any actions in any order, one patch with most of them, against a machine that takes them one by one."""
    rng = random.Random(9)
    acts = ["accept", "REJECT", "Needs_More_Evidence", "SUPERSEDE", "MERGE", "nonsense", None, ""]
    reviews = [(rng.choice([1, 1, 1, 2, 3, 4, 9]), i, rng.choices([*acts, "CANCEL"], [5] * 8 + [0.02])[0], rng.choice([None, True, False])) for i in range(600)]
    patches = [(1, "PROPOSED"), (2, "PENDING_REVIEW"), (3, "CANCELED"), (4, "ACCEPTED"), (5, "PROPOSED")]
    state, log = dict(patches), {}
    for p, i, a, vote in reviews:
        act = (a or "").upper()
        act = act if act in {**gov.ACTIONS, **gov.TERMINAL} else "ACCEPT" if vote else "REJECT" if vote is False else "REVIEW"
        to, now = {**gov.ACTIONS, **gov.TERMINAL}.get(act), state.get(p)
        ok = to is not None and now is not None and now not in ("MERGED", "CANCELED") and (act != "MERGE" or now == "ACCEPTED")
        log[i] = (p, act, now, to if ok else None, not ok)
        if ok:
            state[p] = to
    pd = spark.createDataFrame(patches, "patch_id int, status string")
    out = gov.review_log(pd, spark.createDataFrame(reviews, "patch_id int, at int, action string, approved boolean").repartition(6), ["at"])
    assert {r["at"]: (r.patch_id, r.action, r.previous_status, r.new_status, r.error is not None) for r in out.collect()} == log
    assert {r.patch_id: r.status for r in gov.patch_states(pd, out, ["at"]).collect()} == state
