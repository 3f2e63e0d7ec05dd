"""Queries of text rules, vocabularies, splitting, extraction and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions import vocabulary as V
from quillspark.operators import extract, graph, split
from quillspark.operators import relational as rel
from quillspark.registry import query
from quillspark.sources import tables as T
from quillspark.sources.tables import table, with_views


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _pick(words, col: str):
    """A word of the list by a number column, from 0."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(col) % len(words) + 1).cast("int"))


def _pick_sql(words, col: str) -> str:
    return f"({_list(words)})[CAST({col} % {len(words)} AS INT) + 1]"


PATTERNS = ("Th[a-z]+", "[A-Z][a-z]+tion", "En [a-z]+")
_COUNTS = [f"len(regexp_extract_all(text, {_q(p)}))" for p in PATTERNS]


@query("detect_structure", f"""WITH c AS (SELECT doc_id, {', '.join(f'{e} AS c{i}' for i, e in enumerate(_COUNTS))}, regexp_matches(text, '(?i)the') AS has_catalog FROM documents), b AS (SELECT *, greatest(c0, c1, c2) AS best FROM c)
SELECT doc_id, CASE WHEN best = 0 THEN NULL WHEN c0 = best THEN 0 WHEN c1 = best THEN 1 ELSE 2 END AS pattern_index, CAST(best AS INT) AS chapter_count, least(1.0, best / 50.0)::DOUBLE AS confidence, has_catalog FROM b""")
def detect_structure(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in R.structure("text", PATTERNS, ("(?i)the",)).items()])


_TEXTS = ("之乎者也" * 20, "的了着过" * 20, "者不知也。" * 12, "山海经云" * 15, "short")


@query("classical_detect", f"""WITH t AS (SELECT event_id, {_pick_sql(_TEXTS, 'event_id')} AS t FROM events), c AS (SELECT event_id, length(t) AS n, len(regexp_extract_all(t, '[{V.CLASSICAL_PARTICLES}]')) * 1000.0::DOUBLE / length(t) AS o,
 len(regexp_extract_all(t, '[{V.MODERN_PARTICLES}]')) * 1000.0::DOUBLE / length(t) AS m, len(regexp_extract_all(t, '者[^。]*也')) * 1000.0::DOUBLE / length(t) AS p FROM t)
SELECT event_id, n >= 50 AND ((o > 50 AND m < 10) OR (o > 30 AND p > 2) OR o / greatest(m, 1) > 5) AS classical FROM c""")
def classical_detect(spark, d):
    return table(spark, d, "events").withColumn("t", _pick(_TEXTS, "event_id")).select("event_id", R.is_classical("t").alias("classical"))


_EVIDENCE = """WITH e AS (SELECT doc_id, text AS s, CASE doc_id % 5 WHEN 0 THEN substring(text, 3, 20) WHEN 1 THEN replace(substring(text, 3, 20), ' ', '  ') WHEN 2 THEN substring(text, 1, 4) || 'ZZZZZZ' WHEN 3 THEN '' ELSE 'ZZZZQQQQ' END AS e FROM documents), n AS (SELECT *, regexp_replace(s, '\\s+', '', 'g') AS ns, regexp_replace(e, '\\s+', '', 'g') AS ne FROM e),
 l AS (SELECT doc_id, CASE WHEN e = '' OR s = '' THEN 'UNSUPPORTED' WHEN contains(s, e) THEN 'EXACT' WHEN contains(ns, ne) THEN 'NORMALIZED' WHEN length(e) >= 4 AND (contains(s, left(e, 4)) OR contains(s, right(e, 4))) THEN 'NEAR' ELSE 'UNSUPPORTED' END AS level FROM n)"""


def _evidence(spark, d):
    """Documents with a piece of evidence each, taken from the text in five ways, and its level."""
    k = F.col("doc_id") % 5
    e = F.when(k == 0, F.substring("text", 3, 20)).when(k == 1, F.replace(F.substring("text", 3, 20), F.lit(" "), F.lit("  "))).when(k == 2, F.concat(F.substring("text", 1, 4), F.lit("ZZZZZZ"))).when(k == 3, "").otherwise("ZZZZQQQQ")
    return table(spark, d, "documents").withColumn("e", e).select("doc_id", R.evidence_level("e", "text").alias("level"))


@query("evidence_level", _EVIDENCE + " SELECT doc_id, level FROM l")
def evidence_level(spark, d):
    return _evidence(spark, d)


@query("evidence_worst", _EVIDENCE + f", w AS (SELECT doc_id // 2 AS fact, max(list_position({_list(R.LEVELS)}, level)) AS w FROM l GROUP BY 1) SELECT fact, ({_list(R.LEVELS)})[w] AS worst, CASE WHEN w = 4 THEN 'WEAK' ELSE 'PASSED' END AS status FROM w")
def evidence_worst(spark, d):
    """Facts of two pieces of evidence each: the worst level, and whether the fact is weak."""
    w = _evidence(spark, d).groupBy(F.floor(F.col("doc_id") / 2).alias("fact")).agg(F.max(R.severity("level")).alias("w"))
    return w.select("fact", F.element_at(F.array(*[F.lit(x) for x in R.LEVELS]), F.col("w") + 1).alias("worst"), F.when(F.col("w") == 3, "WEAK").otherwise("PASSED").alias("status"))


_NAMES = ("师父", "王师父", "老先生", "某先生", "赵云", "小姐", "", "李四", "大将军", "黑将军", "钱大王", "宋江")
_GENERIC_SQL = f"""CASE WHEN n = '' OR list_contains(g, n) THEN true WHEN len(list_filter(g, lambda x: ends_with(n, x) AND length(n) > length(x))) = 0 THEN false
 ELSE NOT list_contains(p, left(n, length(n) - length(list_filter(g, lambda x: ends_with(n, x) AND length(n) > length(x))[1]))) END"""


@query("is_generic", f"WITH t AS (SELECT event_id, {_pick_sql(_NAMES, 'event_id')} AS n, {_list(V.GENERIC)} AS g, {_list([*V.TITLE_PREFIXES, *V.SURNAMES])} AS p FROM events) SELECT event_id, n AS name, {_GENERIC_SQL} AS generic FROM t")
def is_generic(spark, d):
    return table(spark, d, "events").select("event_id", _pick(_NAMES, "event_id").alias("name")).withColumn("generic", R.is_generic("name"))


_A = ("师父", "赵云", "张三丰", "宋江", "宋江", "李逵", "林冲", "abcd", "abcx", "wang")
_B = ("小姐", "钱云", "张三李", "宋江", "宋汪", "李逵先生", "林冲之子孙", "abce", "abxyz", "wangx")


#: The common prefix of a and b, for alias_cases.
ALIAS_PREFIX = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS k"
ALIAS_LISTS = f"{_list(V.GENERIC)} AS g, {_list([*V.TITLE_PREFIXES, *V.SURNAMES])} AS p"


def alias_cases() -> tuple[str, str]:
    """Decision and confidence on names a and b, in SQL."""
    generic = lambda n: _GENERIC_SQL.replace("length(n)", f"length({n})").replace("ends_with(n,", f"ends_with({n},").replace("left(n,", f"left({n},").replace("n = ''", f"{n} = ''").replace("list_contains(g, n)", f"list_contains(g, {n})")
    surname = lambda n: f"CASE WHEN length({n}) >= 2 AND contains({_q(V.SURNAMES)}, left({n}, 1)) THEN left({n}, 1) END"
    rules = [
        (f"({generic('a')}) AND ({generic('b')})", "BLOCK", 0.9),
        (f"({surname('a')}) <> ({surname('b')})", "BLOCK", 0.95),
        ("k >= 2 AND abs(length(a) - length(b)) <= 2 AND length(a) > k AND length(b) > k", "BLOCK", 0.85),
        ("a = b", "MERGE", 0.99),
        ("levenshtein(a, b) <= 1", "MERGE", 0.7),
        (f"(contains(a, b) OR contains(b, a)) AND list_contains({_list(V.MERGE_TITLES)}, substring(CASE WHEN length(a) < length(b) THEN b ELSE a END, CAST(least(length(a), length(b)) + 1 AS INT)))", "MERGE", 0.6),
        ("contains(a, b) OR contains(b, a)", "UNCERTAIN", 0.4),
    ]
    case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {_q(r[1]) if k == 1 else f'{r[2]}::DOUBLE'}" for r in rules) + (" ELSE 'UNCERTAIN' END" if k == 1 else " ELSE 0.2::DOUBLE END")
    return case(1), case(2)


_DECIDED = f"WITH t AS (SELECT event_id, {_pick_sql(_A, 'event_id')} AS a, {_pick_sql(_B, 'event_id')} AS b, {ALIAS_LISTS} FROM events), k AS (SELECT *, {ALIAS_PREFIX} FROM t) SELECT event_id, a AS name_a, b AS name_b, {alias_cases()[0]} AS decision, {alias_cases()[1]} AS confidence FROM k"


@query("alias_decisions", _DECIDED)
def alias_decisions(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_A, "event_id").alias("name_a"), _pick(_B, "event_id").alias("name_b"))
    decision, confidence = R.alias_decision("name_a", "name_b")
    return t.select("*", decision.alias("decision"), confidence.alias("confidence"))


@query("keywords_ngram", """WITH t AS (SELECT item_id, text AS t FROM benchmark), r AS (SELECT item_id, unnest(regexp_extract_all(t, '[a-z]+')) AS r FROM t),
 g AS (SELECT DISTINCT item_id, substring(r, CAST(i AS INT), CAST(n AS INT)) AS g FROM r, (SELECT unnest([2, 3, 4]) AS n) x, LATERAL (SELECT unnest(range(1, length(r) - n + 2)) AS i)),
 k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(g), g) AS k FROM g WHERE g NOT IN ('th', 'he')) SELECT item_id, list(g ORDER BY k) AS keywords FROM k WHERE k <= 20 GROUP BY 1""")
def keywords_ngram(spark, d):
    t = table(spark, d, "benchmark")
    return t.select("item_id", R.ngram_keywords("text", "a-z", stop=("th", "he")).alias("keywords")).where(F.size("keywords") > 0)


_QUESTIONS = ("请分析宋江的人物形象与性格", "追踪林冲的发展历程", "这个证据修正一下", "宋江是谁？", "他和李逵的关系如何", "简单", "梳理水浒传的时间线变化过程")


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(q, {_q(w)})" for w in words) + ")"


def _n_sql(words) -> str:
    return "(" + " + ".join(f"contains(q, {_q(w)})::INT" for w in words) + ")"


@query("plan_mode", f"""WITH t AS (SELECT event_id, {_pick_sql(_QUESTIONS, 'event_id')} AS q, CAST(user_id % 3 AS INT) AS targets FROM events), m AS (SELECT *, CASE WHEN {_any_sql(V.ENRICH_WORDS)} THEN 'enrich' WHEN {_any_sql(V.TRACE_WORDS)} THEN 'trace' WHEN {_any_sql(V.ANALYZE_WORDS)} THEN 'analyze' ELSE 'answer' END AS mode FROM t),
 h AS (SELECT *, CASE mode WHEN 'trace' THEN {_n_sql(V.TRACE_WORDS)} WHEN 'analyze' THEN {_n_sql(V.ANALYZE_WORDS)} WHEN 'enrich' THEN {_n_sql(V.ENRICH_WORDS)} ELSE 0 END AS hits FROM m)
SELECT event_id, mode, round(least(0.99, 0.7 + CASE WHEN targets > 0 THEN 0.15 ELSE 0 END + CASE WHEN targets > 1 THEN 0.05 ELSE 0 END + CASE WHEN hits >= 2 THEN 0.05 ELSE 0 END + CASE WHEN hits >= 3 THEN 0.03 ELSE 0 END
 - CASE WHEN length(q) < 8 THEN 0.15 WHEN length(q) < 15 THEN 0.05 ELSE 0 END + CASE WHEN mode = 'answer' AND regexp_matches(q, '[？?。.]$') THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence FROM h""")
def plan_mode(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_QUESTIONS, "event_id").alias("q"), (F.col("user_id") % 3).alias("targets")).withColumn("mode", R.mode("q"))
    return t.select("event_id", "mode", R.mode_confidence("q", "mode", "targets").alias("confidence"))


@query("resolve_reference", "SELECT event_id, " + "".join("replace(" for _ in V.TARGET_PRONOUNS) + _pick_sql(_QUESTIONS, "event_id") + "".join(f", {_q(p)}, '林冲')" for p in sorted(V.TARGET_PRONOUNS, key=lambda p: (-len(p), p))) + " AS question FROM events")
def resolve_reference(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_QUESTIONS, "event_id").alias("q"), F.lit("林冲").alias("target"))
    return t.select("event_id", R.resolve_pronouns("q", "target").alias("question"))


_CATALOG = ("宋江", "林冲", "李逵", "水浒")


@query("find_targets", f"WITH t AS (SELECT event_id, {_pick_sql(_QUESTIONS, 'event_id')} AS q FROM events) SELECT event_id, n AS target, CAST(i - 1 AS INT) AS position FROM t, (SELECT unnest({_list(_CATALOG)}) AS n, unnest([1, 2, 3, 4]) AS i) WHERE contains(q, n)")
def find_targets(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_QUESTIONS, "event_id").alias("q"))
    names = F.filter(F.array(*[F.when(F.col("q").contains(n), F.struct(F.lit(n).alias("target"), F.lit(i).alias("position"))) for i, n in enumerate(_CATALOG)]), lambda x: x.isNotNull())
    return t.select("event_id", F.explode(names).alias("x")).select("event_id", "x.target", "x.position")


@query("entity_mention_count", f"WITH t AS (SELECT event_id, {_pick_sql(_QUESTIONS, 'event_id')} AS q FROM events) SELECT event_id, CAST({' + '.join(f'contains(q, {_q(n)})::INT' for n in _CATALOG)} AS INT) AS mentions FROM t")
def entity_mention_count(spark, d):
    return table(spark, d, "events").select("event_id", _pick(_QUESTIONS, "event_id").alias("q")).select("event_id", R.times_found("q", _CATALOG).alias("mentions"))


_ANSWERS = ('宋江是首领<cite type="chunk" id="3">原文</cite>。。', "众所周知,。他是巅峰之作 run_12 [chunk_4]", "没有证据。没有证据的长句子在这里。没有证据的长句子在这里。", "plain  answer\n\n\n\nend .", "")


@query("answer_audit", f"""WITH t AS (SELECT event_id, {_pick_sql(_ANSWERS, 'event_id')} AS a FROM events) SELECT event_id, CAST({' + '.join(f"len(regexp_extract_all(a, {_q(p)}))" for p in V.BROAD_CLAIMS)} AS INT) AS broad_claims, regexp_matches(a, '[。，；：？！]{{2,}}|[；;][。.]') AS has_punctuation_issues,
 len(list_filter(regexp_split_to_array(a, '[。！？!?]'), lambda s: length(trim(s)) > 8)) > len(list_distinct(list_filter(regexp_split_to_array(a, '[。！？!?]'), lambda s: length(trim(s)) > 8))) AS has_repetition, CAST(len(regexp_extract_all(a, '<cite')) AS INT) AS citations, CAST(length(a) AS INT) AS length FROM t""")
def answer_audit(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_ANSWERS, "event_id").alias("a"))
    return t.select("event_id", *[c.alias(n) for n, c in R.audit("a").items()])


def _replaced_sql(steps) -> str:
    """a after all replacements, one in the other."""
    out = "a"
    for pattern, by in steps:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(by)}, 'g')"
    return out


@query("answer_polish", f"WITH t AS (SELECT event_id, {_pick_sql(_ANSWERS, 'event_id')} AS a FROM events) SELECT event_id, {_replaced_sql(V.POLISH_TAGS + V.POLISH_IDS + V.POLISH_MARKS + V.POLISH_END)} AS polished, {_replaced_sql(V.POLISH_TAGS + V.POLISH_MARKS)} AS light FROM t")
def answer_polish(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_ANSWERS, "event_id").alias("a"))
    return t.select("event_id", R.polish("a").alias("polished"), R.polish("a", light=True).alias("light"))


@query("extract_citations", f"WITH t AS (SELECT event_id, {_pick_sql(_ANSWERS, 'event_id')} AS a FROM events) SELECT event_id, regexp_extract(a, '<cite\\s+type=\"(\\w+)\"(?:\\s+id=\"(\\d+)\")?[^>]*>([^<]+)</cite>', 1) AS type, CAST(regexp_extract(a, 'id=\"(\\d+)\"', 1) AS BIGINT) AS id, regexp_extract(a, '>([^<]+)</cite>', 1) AS excerpt FROM t WHERE contains(a, '<cite ')")
def extract_citations(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_ANSWERS, "event_id").alias("a"))
    return t.select("event_id", F.explode(R.citations("a")).alias("c")).select("event_id", "c.type", "c.id", "c.excerpt")


_RAW_REL = (*V.RELATION_TYPES[:20], *list(V.RELATION_SYNONYMS)[:30], " 师徒关系 ", "传人", "夫子", "母", "敌国", "盟", "兄长辈", "友", "xyz", "同")


def _rel_sql() -> str:
    types, syn = _list(V.RELATION_TYPES), "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in V.RELATION_SYNONYMS.items()) + "}"
    hints = " ".join(f"WHEN regexp_matches(t, '[{h[0]}]') THEN " + (f"CASE WHEN regexp_matches(t, '[{h[2]}]') THEN {_q(h[3])} ELSE {_q(h[1])} END" if len(h) > 2 else _q(h[1])) for h in V.RELATION_HINTS)
    return f"WITH w AS (SELECT event_id, trim({_pick_sql(_RAW_REL, 'event_id')}) AS t FROM events), d AS (SELECT DISTINCT t FROM w), m AS (SELECT t, coalesce(CASE WHEN list_contains({types}, t) THEN t END, ({syn})[t], list_filter({types}, lambda k: contains(t, k) OR contains(k, t))[1], CASE {hints} ELSE '未知' END) AS type FROM d) SELECT event_id, t AS raw, type FROM w JOIN m USING (t)"


@query("normalize_relation_type", _rel_sql())
def normalize_relation_type(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_RAW_REL, "event_id").alias("r"))
    return t.select("event_id", R.strip("r").alias("raw"), R.relation_type("r").alias("type"))


_RAW_EV = (*V.EVENT_TYPES[:20], "登基大典", "病逝了", "夺位", "大战败北", "出征了", "结拜", "自刎", "报", "xyz", "天象异变", "抄", "投降过")


def _event_sql() -> str:
    table_: dict[str, str] = {}
    for kind, words in V.EVENT_SYNONYMS.items():
        for w in words:
            table_.setdefault(w, kind)
    types, by = _list(V.EVENT_TYPES), _list(sorted(V.EVENT_TYPES, key=len, reverse=True))
    syn = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in table_.items()) + "}"
    return f"WITH w AS (SELECT event_id, trim({_pick_sql(_RAW_EV, 'event_id')}) AS t FROM events), d AS (SELECT DISTINCT t, regexp_replace(t, '[了过着]$', '') AS b FROM w), m AS (SELECT t, coalesce(CASE WHEN list_contains({types}, t) THEN t END, ({syn})[t], list_filter({by}, lambda k: contains(t, k) OR contains(k, t))[1], CASE WHEN b <> t THEN coalesce(CASE WHEN list_contains({types}, b) THEN b END, list_filter({types}, lambda k: ends_with(b, k) OR ends_with(k, b))[1]) END, t) AS type FROM d) SELECT event_id, t AS raw, type FROM w JOIN m USING (t)"


@query("normalize_event_type", _event_sql())
def normalize_event_type(spark, d):
    t = table(spark, d, "events").select("event_id", _pick(_RAW_EV, "event_id").alias("r"))
    return t.select("event_id", R.strip("r").alias("raw"), R.event_type("r").alias("type"))


_HINTS = ('{"entities": [{"name": "Thand", "type": "character", "aliases": ["thing", "x"]}]}', '[{"name": "ation", "type": "item"}]', "# note\nOnthe|place|with,of\nbad line", "")


@query("prior_hint_apply")
def prior_hint_apply(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", _pick(_HINTS, "doc_id").alias("hint"))
    return t.select("doc_id", F.explode(R.hint_candidates("text", R.hint_entities("hint"))).alias("c")).select("doc_id", "c.*")


_JSON = ('{"a": 1}', 'text ```json\n{"b": [1, 2]}\n``` more', "not json", "[1, 2]", "")


@query("json_salvage", f"SELECT event_id, CASE CAST(event_id % {len(_JSON)} AS INT) WHEN 0 THEN '{{\"a\":1}}' WHEN 1 THEN '{{\"b\":[1,2]}}' WHEN 3 THEN '[1,2]' END AS json FROM events")
def json_salvage(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(R.json_salvage(_pick(_JSON, "event_id"))).alias("json"))


@query("map_evidence", "SELECT event_id, CASE event_type WHEN 'click' THEN 'DIRECT' WHEN 'view' THEN 'NEAR' ELSE 'NEAR' END AS level, CASE event_type WHEN 'click' THEN 'entity' ELSE 'chunk' END AS source FROM events")
def map_evidence(spark, d):
    e = table(spark, d, "events").withColumn("old", F.when(F.col("event_type") == "click", "EXACT").when(F.col("event_type") == "view", "NEAR").otherwise("OTHER")).withColumn("kind", F.when(F.col("event_type") == "click", "entity_profile").otherwise("other"))
    return e.select("event_id", R.mapped("old", V.EVIDENCE_LEVELS, "NEAR").alias("level"), R.mapped("kind", V.SOURCE_TYPES, "chunk").alias("source"))


# --- splitting


@query("chapter_split")
def chapter_split(spark, d):
    return split.split_chapters(table(spark, d, "documents"), "text", PATTERNS[1:2], keep=["doc_id"])


@query("fixed_split")
def fixed_split(spark, d):
    return split.split_fixed(table(spark, d, "documents"), "text", 2000, "\n", keep=["doc_id"])


@query("chunk_documents")
def chunk_documents(spark, d):
    return split.chunk(table(spark, d, "documents"), "text", "\n", keep=["doc_id"])


@query("smart_split")
def smart_split(spark, d):
    return split.smart_split(table(spark, d, "documents"), "text", 1500, keep=["doc_id"])


@query("index_items")
def index_items(spark, d):
    return extract.index_items(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


# --- extraction and facts


@query("term_freq_top", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS term FROM documents), n AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM n) SELECT doc_id, term, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def term_freq_top(spark, d):
    return extract.term_frequency(table(spark, d, "documents"), ["doc_id"], "text", "[A-Za-z]{2,}")


@query("candidates", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS term FROM documents), a AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2),
 a20 AS (SELECT doc_id, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM a) WHERE k <= 20), s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{1,4}(?:tion|ment)')) AS term FROM documents), b AS (SELECT doc_id, term, count(*) AS n FROM s GROUP BY 1, 2),
 u AS (SELECT doc_id, term, max(n) AS n FROM (SELECT * FROM a20 UNION ALL SELECT * FROM b) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM u) SELECT doc_id, term, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 30""")
def candidates(spark, d):
    return extract.candidates(table(spark, d, "documents"), ["doc_id"], "text", "[A-Z][a-z]{4,}", ("tion", "ment"), (), "a-z")


_KIND_SQL = "CASE WHEN name IN ('Thand', 'Onthe') THEN 'LOCATION' WHEN regexp_matches(name, '[xz]') THEN 'LOCATION' ELSE 'CHARACTER' END"


@query("rule_entities", with_views("chunks", "mentions") + f"SELECT chapter_id, chunk_index, pos, name, {_KIND_SQL} AS entity_type, CASE WHEN {_KIND_SQL} = 'LOCATION' THEN 'CANONICAL' ELSE 'UNCERTAIN' END AS role, (CASE WHEN name IN ('Thand', 'Onthe') THEN 0.6 WHEN regexp_matches(name, '[xz]') THEN 0.5 ELSE 0.3 END)::DOUBLE AS confidence FROM mentions")
def rule_entities(spark, d):
    kind, role, sure = extract.entity_kind("name", ("Thand", "Onthe"), "place", "xz")
    return T.mentions(spark, d).select("chapter_id", "chunk_index", "pos", "name", kind.alias("entity_type"), role.alias("role"), sure.cast("double").alias("confidence"))


_PAIRS_SQL = with_views("chunks", "mentions") + """, p AS (SELECT a.chapter_id, a.chunk_index, a.pos AS i, b.pos AS j, a.name AS source, b.name AS target, least(a.name, b.name) AS lo, greatest(a.name, b.name) AS hi
 FROM mentions a JOIN mentions b ON a.chapter_id = b.chapter_id AND a.chunk_index = b.chunk_index AND a.pos < b.pos AND a.pos < 10 AND a.name <> b.name),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, chunk_index, lo, hi ORDER BY i, j) AS n FROM p) WHERE n = 1),
 x AS (SELECT o.*, content AS t, instr(content, source) AS a, instr(content, target) AS b FROM o JOIN chunks USING (chapter_id, chunk_index)), y AS (SELECT *, substring(t, least(a, b), abs(a - b)) AS between_ FROM x)"""
_VERBS = ("the", " of ", " in ")


@query("rule_relations", _PAIRS_SQL + ", z AS (SELECT *, CASE WHEN contains(between_, 'the') THEN 'the' WHEN contains(between_, ' of ') THEN ' of ' WHEN contains(between_, ' in ') THEN ' in ' END AS verb FROM y) SELECT chapter_id, chunk_index, source, target, CASE verb WHEN 'the' THEN 'IS' WHEN ' in ' THEN 'AT' ELSE 'RELATED_TO' END AS relation_type, (CASE WHEN verb IS NULL THEN 0.2 ELSE 0.4 END)::DOUBLE AS confidence, left(between_, 80) AS evidence FROM z")
def rule_relations(spark, d):
    p = rel.cooccurring(T.mentions(spark, d), ["chapter_id", "chunk_index"]).join(T.chunks(spark, d).drop("book"), ["chapter_id", "chunk_index"])
    return p.select("chapter_id", "chunk_index", "source", "target", *[c.alias(n) for n, c in extract.relation_of("content", "source", "target", _VERBS, {"IS": ("the",), "AT": (" in ",)}).items()])


@query("rule_events", with_views("chunks", "mentions") + """, n AS (SELECT chapter_id, chunk_index, name, content AS t, instr(content, name) AS a FROM mentions JOIN chunks USING (chapter_id, chunk_index) WHERE pos < 8),
 c AS (SELECT *, substring(t, greatest(a - 60, 1), a + length(name) + 60 - greatest(a - 60, 1)) AS context FROM n) SELECT chapter_id, chunk_index, name, CASE WHEN contains(context, 'with') THEN 'with' WHEN contains(context, 'from') THEN 'from' END AS action, left(context, 100) || CASE WHEN length(context) > 100 THEN '…' ELSE '' END AS description FROM c WHERE contains(context, 'with') OR contains(context, 'from')""")
def rule_events(spark, d):
    m = T.mentions(spark, d).where("pos < 8").join(T.chunks(spark, d).drop("book"), ["chapter_id", "chunk_index"])
    e = extract.event_of("content", "name", ("with", "from"))
    return m.select("chapter_id", "chunk_index", "name", e["action"].alias("action"), e["description"].alias("description")).where("action IS NOT NULL")


@query("chapter_fact", with_views("chunks", "mentions") + """, f AS (SELECT chapter_id, upper(name) AS name, min((chunk_index, pos)) AS o, list(DISTINCT name ORDER BY name) AS surfaces, count(*) AS mentions FROM mentions GROUP BY 1, 2)
SELECT chapter_id, name, surfaces, mentions, 0.3::DOUBLE AS confidence, 'ev_' || o[1] || '_' || (row_number() OVER (PARTITION BY chapter_id ORDER BY o) - 1) AS evidence_id FROM f""")
def chapter_fact(spark, d):
    m = T.mentions(spark, d).select("chapter_id", F.upper("name").alias("name"), F.col("name").alias("surface"), "chunk_index", "pos", F.lit(0.3).alias("confidence"))
    return extract.chapter_facts(m, ["chapter_id"], ["chunk_index", "pos"])


@query("chapter_entity_view", with_views("chunks", "mentions") + "SELECT chapter_id, left(name, 5) AS prefix, list(DISTINCT name ORDER BY name) AS surfaces, count(*) AS n, arg_min(name, (chunk_index, pos)) AS first FROM mentions GROUP BY 1, 2")
def chapter_entity_view(spark, d):
    return T.mentions(spark, d).groupBy("chapter_id", F.left("name", F.lit(5)).alias("prefix")).agg(F.array_sort(F.collect_set("name")).alias("surfaces"), F.count(F.lit(1)).alias("n"), F.min_by("name", F.struct("chunk_index", "pos")).alias("first"))


@query("entity_mentions", with_views("chunks", "mentions") + f", t AS (SELECT chapter_id, name AS n, count(*) AS k, {_list(V.GENERIC)} AS g, {_list([*V.TITLE_PREFIXES, *V.SURNAMES])} AS p FROM mentions GROUP BY 1, 2) SELECT chapter_id, n AS name, k AS n, {_GENERIC_SQL} AS generic FROM t")
def entity_mentions(spark, d):
    """Surfaces of a chapter, those that name nobody flagged by the rule."""
    return T.mentions(spark, d).groupBy("chapter_id", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("generic", R.is_generic("name"))


@query("relation_mentions", "SELECT event_id, coalesce(nullif(CASE WHEN user_id % 2 = 0 THEN event_type ELSE '' END, ''), props) AS description FROM events")
def relation_mentions(spark, d):
    s = F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise("")
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif(s, F.lit("")), "props").alias("description"))


@query("fact_text", "SELECT conv_id, left(arg_min(text, turn) || ' ' || array_to_string(list(text ORDER BY turn)[1:5], ' ') || ' ' || array_to_string(list(role ORDER BY turn)[1:8], ' '), 1000) AS text FROM conversations GROUP BY 1")
def fact_text(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("s"), F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("a"))
    c = c.select("conv_id", "s", F.transform("a", lambda x: x["text"]).alias("e"), F.transform("a", lambda x: x["role"]).alias("n"))
    return c.select("conv_id", extract.fact_text("s", "e", "n").alias("text"))


@query("entity_clusters")
def entity_clusters(spark, d):
    m = T.mentions(spark, d).select("book", "name").distinct()
    return graph.direct_clusters(rel.near_pairs(m, "book"), m, "book")
