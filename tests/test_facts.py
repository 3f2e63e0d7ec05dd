"""Rule extraction with hints, chapter facts and gram keywords against plain loops on small fixtures."""

import random

import pytest

from quillspark.operators import retrieve
from quillspark.operators import rule_facts as rf

VERBS, KINDS, ACTIONS = ("is", "of"), {"IS": ("is",)}, ("meets", "finds")
PEOPLE = [("b", 1, "Anna", ["Ann", "", None]), ("b", 2, "Bert", ["Ann", "Bertie"]), ("b", 3, "Cora", None), (None, 1, "Nobody", []), ("c", 1, "", ["x"])]
PLACES = [("b", 1, "Dale"), ("b", 2, None), (None, 1, "Nowhere")]
TEXTS = {
    1: ("b", "Ann is here. Bertie meets Dale of Cora and Anna finds Bert"),
    2: ("b", None),
    3: ("b", ""),
    4: (None, "Anna is Bert"),
    5: ("b", " ".join(f"N{i:02d} is" if i % 2 else f"N{i:02d} x" for i in range(30)) + " meets N03"),
    6: ("z", "Anna meets Bert, Anna finds Bert"),
    7: ("b", "Dale " * 5000 + "Anna meets Dale"),
}
CANDS = {1: ["Bertie", "Dale", "absent"], 4: ["Anna", "Bert"], 5: [f"N{i:02d}" for i in range(30)], 6: ["Bert", "Anna"], 2: ["Anna"]}


def by_loops(text, cands, known):
    text = text or ""
    names, aliases, places, normal = known
    order = list(cands)
    for n in names:
        if n not in order:
            order.insert(0, n)
    order += [a for a in dict.fromkeys(aliases + places) if a not in order]
    ents = [(n, normal.get(n, n), "LOCATION" if n in places else "CHARACTER", 0.6 if n in places else 0.3) for n in order[:20] if n in text]
    inside, rels, evs, seen = [e[1] for e in ents if e[1] in text], [], [], set()
    for i, a in enumerate(inside[:10]):
        for b in inside[i + 1 :]:
            if a == b or frozenset((a, b)) in seen:
                continue
            seen.add(frozenset((a, b)))
            x, y = sorted((text.find(a), text.find(b)))
            verb = next((v for v in VERBS if v in text[x:y]), None)
            rels.append((a, b, "IS" if verb == "is" else "RELATED_TO", 0.4 if verb else 0.2, text[x:y][:80]))
    rels = sorted(rels, key=lambda r: -r[3])[:20] if len(rels) > 20 else rels
    for n in inside[:8]:
        at = text.find(n)
        near = text[max(0, at - 60) : at + len(n) + 60]
        if any(a in near for a in ACTIONS):
            evs.append((n, [n, *[o for o in dict.fromkeys(inside) if o != n and o in near]][:5], near[:100] + ("…" if len(near) > 100 else ""), near[:120]))
    return ents, rels, evs


@pytest.fixture(scope="module")
def extracted(spark):
    chunks = spark.createDataFrame([(k, b, t, "e") for k, (b, t) in TEXTS.items()], "id long, book string, text string, entities string")
    cands = spark.createDataFrame([(k, t, i) for k, ts in CANDS.items() for i, t in enumerate(ts)], "id long, term string, rank int")
    hint = rf.hints(spark.createDataFrame(PEOPLE, "book string, place int, name string, aliases array<string>"), spark.createDataFrame(PLACES, "book string, place int, name string"), "book")
    return rf.extracted(chunks, ["id"], "book", "text", cands, hint, VERBS, KINDS, ACTIONS)


def test_extraction_equals_loops(extracted):
    hint = (["Anna", "Bert", "Cora"], ["Ann", "Bertie"], ["Dale"], {"Ann": "Anna", "Anna": "Anna", "Bert": "Bert", "Bertie": "Bert", "Cora": "Cora"})
    rows = {r.id: r for r in extracted.collect()}
    assert set(rows) == set(TEXTS)
    for k, (book, text) in TEXTS.items():
        ents, rels, evs = by_loops(text, CANDS.get(k, []), hint if book == "b" else ([], [], [], {}))
        r = rows[k]
        assert [(e.surface, e.name, e.entity_type, e.confidence) for e in r.entities] == ents, k
        assert [(x.source, x.target, x.relation_type, x.confidence, x.evidence) for x in r.relations] == rels, k
        assert [(e.name, e.participants, e.description, e.evidence) for e in r.events] == evs, k
    assert len(rows[5].relations) == 20 and not rows[2].entities and not rows[3].events


def test_chapter_facts_are_rows(spark, extracted):
    x = extracted.selectExpr("CASE WHEN id < 5 THEN 1 ELSE 2 END AS chapter", "id", "entities", "relations", "events")
    rows = rf.chapter_fact_rows(x, ["chapter"], "id").collect()
    one = {r.name: r for r in rows if r.chapter == 1 and r.part == "character"}
    assert one["Bert"].surfaces == ["Bert", "Bertie"]
    assert set(one["Anna"].surfaces) == {"Anna", "Ann"} and one["Anna"].evidence_id.startswith("ev_1_")
    assert sorted(r.ordinal for r in one.values()) == list(range(len(one)))
    n = extracted.selectExpr("sum(size(relations)) AS r", "sum(size(events)) AS e").first()
    assert (sum(r.part == "relation" for r in rows), sum(r.part == "event" for r in rows)) == (n.r, n.e)


def test_extraction_of_no_rows(spark, extracted):
    hint = rf.hints(spark.createDataFrame([], "book string, place int, name string, aliases array<string>"), spark.createDataFrame([], "book string, place int, name string"), "book")
    none = rf.extracted(spark.createDataFrame([], "id long, book string, text string"), ["id"], "book", "text", spark.createDataFrame([], "id long, term string, rank int"), hint)
    assert none.schema == extracted.schema and none.count() == 0


def test_gram_keywords_equal_a_scan(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abéß") for _ in range(rnd.randint(1, 6)))
    texts = [(i, None if i == 7 else "" if i == 8 else " ".join(word() for _ in range(rnd.randint(1, 9))) + (" ab" * 3000 if i == 9 else "")) for i in range(120)]
    asked = [(q, k) for q in range(6) for k in {word() for _ in range(1 + 3 * q)}] + [(0, "AB"), (0, "ab"), (1, ""), (1, None), (2, "abababab")]
    got = retrieve.lexical_grams(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "q int, w string"), "q", "w", ["id"], "text").collect()
    want = {}
    for q in range(6):
        words = sorted({w.lower() for p, w in asked if p == q and w})
        for w in words:
            for i in [i for i, t in texts if t and w in t.lower()][: max(16 // len(words), 2)]:
                want.setdefault((q, i), []).append(w)
    assert {(r.q, r.id): (r.keyword, r.keywords) for r in got} == {k: (min(v), len(v)) for k, v in want.items()} and len(got) == len(want)


def test_expanded_questions(spark):
    q = spark.createDataFrame([(1, "who is ann"), (2, "who"), (3, None)], "q int, text string")
    a = spark.createDataFrame([(1, "ann"), (1, "bea"), (1, "bea"), *[(1, f"z{i}") for i in range(9)]], "q int, alias string")
    got = {r.q: r.text for r in retrieve.expanded(q, a, "q", "text").collect()}
    assert got[1] == "who is ann bea z0 z1 z2 z3" and got[2] == "who"


def test_knowledge_of_two_names_is_there_once(spark):
    hits = spark.createDataFrame([(1, n, f"k{i}", i, "t") for n in "ab" for i in range(9)], "q int, name string, key string, n int, text string")
    got = retrieve.knowledge([(hits, "event", 0.3, 5)], "q", per=["name"])
    assert got.count() == 5


def test_no_filter_repeats_the_expressions_of_a_chunk(spark):
    """A filter on the size of an exploded array would hold the array's whole expression, several times."""
    import __spark_entry__

    for name in ("extracted_entities", "extracted_relations", "extracted_events"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "lambdafunction" in x]
