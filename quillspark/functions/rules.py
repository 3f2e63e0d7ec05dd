"""Text rules as column expressions: no Python runs where rows are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import vocabulary as V


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lits(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_found(text: str | Column, words: Sequence[str]) -> Column:
    """The first of the words, in their order, that the text contains (null: none)."""
    return reduce(lambda out, w: F.when(_c(text).contains(w), F.lit(w)).otherwise(out), reversed(words), F.lit(None).cast("string"))


def any_found(text: str | Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [_c(text).contains(w) for w in words])


def times_found(text: str | Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [_c(text).contains(w).cast("int") for w in words])


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def structure(text: str, patterns: Sequence[str] = V.CHAPTER_PATTERNS, catalogs: Sequence[str] = V.CATALOG_PATTERNS) -> dict[str, Column]:
    """Which form of heading a text has most (the first of equals), how often, and the confidence that it is one."""
    counts = [F.regexp_count(text, F.lit(p)) for p in patterns]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    index = reduce(lambda out, i: F.when(counts[i] == best, F.lit(i)).otherwise(out), reversed(range(len(patterns))), F.lit(None).cast("int"))
    catalog = reduce(lambda a, b: a | b, [_c(text).rlike(p) for p in catalogs])
    return {"pattern_index": F.when(best > 0, index), "chapter_count": best, "confidence": F.least(F.lit(1.0), best / 50), "has_catalog": catalog}


def is_classical(text: str) -> Column:
    """Whether a text is classical Chinese, by the share of particles."""
    n = F.char_length(text)
    old = F.regexp_count(text, F.lit(f"[{V.CLASSICAL_PARTICLES}]")) * 1000 / n
    new = F.regexp_count(text, F.lit(f"[{V.MODERN_PARTICLES}]")) * 1000 / n
    pairs = F.regexp_count(text, F.lit("者[^。]*也")) * 1000 / n
    return F.coalesce((n >= 50) & (((old > 50) & (new < 10)) | ((old > 30) & (pairs > 2)) | (old / F.greatest(new, F.lit(1.0)) > 5)), F.lit(False))


def normalised(text: str | Column) -> Column:
    """No white space, full-width forms and quotes as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(F.regexp_replace(_c(text), r"\s+", ""), "。“”‘’" + wide, ".\"\"''" + "".join(chr(ord(c) - 0xFEE0) for c in wide))


LEVELS = ("EXACT", "NORMALIZED", "NEAR", "UNSUPPORTED")


def evidence_level(evidence: str, source: str) -> Column:
    """How a source holds a piece of evidence."""
    e, s = F.col(evidence), F.col(source)
    near = (F.char_length(e) >= 4) & (s.contains(F.substring(e, 1, 4)) | s.contains(F.right(e, F.lit(4))))
    return F.when(e.isNull() | s.isNull() | (e == "") | (s == ""), "UNSUPPORTED").when(s.contains(e), "EXACT").when(normalised(s).contains(normalised(e)), "NORMALIZED").when(near, "NEAR").otherwise("UNSUPPORTED")


def severity(level: str | Column) -> Column:
    return reduce(lambda out, i: F.when(_c(level) == LEVELS[i], F.lit(i)).otherwise(out), range(len(LEVELS)), F.lit(3))


def is_generic(name: str | Column, generic: Sequence[str] = V.GENERIC, prefixes: Sequence[str] = V.TITLE_PREFIXES, surnames: str = V.SURNAMES) -> Column:
    """Whether a mention names nobody: a listed word, or one that ends in one without a surname or title before it."""
    n = _c(name)
    hit = F.element_at(F.concat(F.filter(_lits(generic), lambda g: n.endswith(g) & (F.char_length(n) > F.char_length(g))), F.array(F.lit("")))  , 1)
    before = F.left(n, F.char_length(n) - F.char_length(hit))
    named = before.isin(*prefixes, *surnames)
    return F.when(n.isNull() | (n == "") | n.isin(*generic), True).when(hit == "", False).otherwise(~named)


def alias_decision(a: str, b: str, merge_titles: Sequence[str] = V.MERGE_TITLES, surnames: str = V.SURNAMES) -> tuple[Column, Column]:
    """(decision, confidence) of two names being one, by ordered rules."""
    x, y = F.col(a), F.col(b)
    nx, ny = F.char_length(x), F.char_length(y)
    surname = lambda c, n: F.when((n >= 2) & F.left(c, F.lit(1)).isin(*surnames), F.left(c, F.lit(1)))
    sx, sy = surname(x, nx), surname(y, ny)
    short = F.least(nx, ny)
    # the common prefix: positions up to the first difference
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= short) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(acc))
    tails = (same >= 2) & (F.abs(nx - ny) <= 2) & (nx > same) & (ny > same) & (F.substr(x, same + 1) != F.substr(y, same + 1))
    longer, less = F.when(nx < ny, y).otherwise(x), F.when(nx < ny, nx).otherwise(ny)
    inside = x.contains(y) | y.contains(x)
    titled = F.substr(longer, less + 1).isin(*merge_titles)
    rules = [
        (is_generic(x) & is_generic(y), "BLOCK", 0.9), (sx != sy, "BLOCK", 0.95), (tails, "BLOCK", 0.85), (x == y, "MERGE", 0.99),
        (F.levenshtein(x, y) <= 1, "MERGE", 0.7), (inside & titled, "MERGE", 0.6), (inside, "UNCERTAIN", 0.4),
    ]
    decision, confidence = F.lit("UNCERTAIN"), F.lit(0.2)
    for rule, said, sure in reversed(rules):
        decision, confidence = F.when(rule, F.lit(said)).otherwise(decision), F.when(rule, F.lit(sure)).otherwise(confidence)
    return decision, confidence


def ngram_keywords(text: str, chars: str = "一-鿿", low: int = 2, high: int = 4, most: int = 20, stop: Sequence[str] = V.STOP_WORDS) -> Column:
    """n-grams of runs of the characters, shorter first then by code point, without stop words."""
    runs = F.regexp_extract_all(_c(text), F.lit(f"([{chars}]+)"), 1)
    grams = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.char_length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, n))).otherwise(F.array().cast("array<string>"))))))
    good = F.array_except(F.array_distinct(grams), _lits(stop)) if stop else F.array_distinct(grams)
    ordered = F.array_sort(F.transform(good, lambda g: F.struct(F.char_length(g).alias("n"), g.alias("g"))))
    return F.slice(F.transform(ordered, lambda s: s["g"]), 1, most)


def mode(question: str) -> Column:
    """The mode that a question asks for: enrich, trace, analyze, else answer."""
    q = strip(question)
    return F.when(any_found(q, V.ENRICH_WORDS), "enrich").when(any_found(q, V.TRACE_WORDS), "trace").when(any_found(q, V.ANALYZE_WORDS), "analyze").otherwise("answer")


def mode_confidence(question: str, mode_: str | Column, targets: str | Column) -> Column:
    """Confidence of the mode; targets: how many known names the question has."""
    q, n, m = F.col(question), F.char_length(question), _c(mode_)
    hits = F.when(m == "trace", times_found(q, V.TRACE_WORDS)).when(m == "analyze", times_found(q, V.ANALYZE_WORDS)).when(m == "enrich", times_found(q, V.ENRICH_WORDS)).otherwise(0)
    more = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    s = F.lit(0.7) + more(_c(targets) > 0, 0.15) + more(_c(targets) > 1, 0.05) + more(hits >= 2, 0.05) + more(hits >= 3, 0.03)
    s = s - F.when(n < 8, F.lit(0.15)).when(n < 15, F.lit(0.05)).otherwise(F.lit(0.0)) + more((m == "answer") & q.rlike("[？?。.]$"), 0.05)
    return F.round(F.least(s, F.lit(0.99)), 2)


def fallback_target(question: str, title: str | Column) -> Column:
    """The first word of a question without asking phrases and punctuation, 24 characters at most; else the title."""
    q = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), V.ASK_PREFIXES, F.col(question))
    q = strip(F.translate(q, "？?。！!，,、；;：:（）()", " " * 16))
    word = F.left(F.element_at(F.split(q, r"\s+"), 1), F.lit(24))
    return F.when(F.char_length(word) >= 2, word).otherwise(_c(title))


def resolve_pronouns(question: str, target: str, pronouns: Sequence[str] = V.TARGET_PRONOUNS) -> Column:
    """Pronouns replaced by the current target, longest first."""
    q = F.col(question)
    for p in sorted(pronouns, key=lambda p: (-len(p), p)):
        q = F.replace(q, F.lit(p), F.coalesce(F.col(target), F.lit(p)))
    return q


def polish(text: str, light: bool = False) -> Column:
    """An answer without tags, internal ids, doubled punctuation and white space."""
    steps = V.POLISH_TAGS + V.POLISH_MARKS if light else V.POLISH_TAGS + V.POLISH_IDS + V.POLISH_MARKS + V.POLISH_END
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, _c(text))


def audit(text: str, claims: Sequence[str] = V.BROAD_CLAIMS) -> dict[str, Column]:
    """Signs of a poor answer: broad claims, punctuation, repetition; number of tags and length."""
    t = F.coalesce(_c(text), F.lit(""))
    broad = reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(p)) for p in claims])
    long_ = F.filter(F.transform(F.split(t, "[。！？!?]"), strip), lambda s: F.char_length(s) > 8)
    return {"broad_claims": broad, "has_punctuation_issues": t.rlike("[。，；：？！]{2,}|[；;][。.]"), "has_repetition": F.size(long_) > F.size(F.array_distinct(long_)), "citations": F.regexp_count(t, F.lit("(?i)<cite")), "length": F.char_length(t)}


def _chars(words: str) -> str:
    return f"[{words}]"


def relation_type(raw: str, types: Sequence[str] = V.RELATION_TYPES, synonyms: dict[str, str] | None = None, hints: Sequence[tuple] = V.RELATION_HINTS, unknown: str = "未知") -> Column:
    """A relation type of the vocabulary: itself, a synonym, one that contains or is contained, a hint by character."""
    t = strip(raw)
    synonyms = V.RELATION_SYNONYMS if synonyms is None else synonyms
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    part = F.element_at(F.concat(F.filter(_lits(types), lambda k: t.contains(k) | k.contains(t)), F.array(F.lit(None).cast("string"))), 1)
    guess = F.lit(unknown)
    for h in reversed(hints):
        said = F.when(t.rlike(_chars(h[2])), F.lit(h[3])).otherwise(F.lit(h[1])) if len(h) > 2 else F.lit(h[1])
        guess = F.when(t.rlike(_chars(h[0])), said).otherwise(guess)
    return F.coalesce(F.when(t.isin(*types), t), F.try_element_at(table, t), part, guess)


def event_type(raw: str, types: Sequence[str] = V.EVENT_TYPES, synonyms: dict[str, Sequence[str]] | None = None) -> Column:
    """An event type of the vocabulary: itself, a synonym, the longest that contains or is contained, without a particle; else as it is."""
    t = strip(raw)
    synonyms = V.EVENT_SYNONYMS if synonyms is None else synonyms
    table: dict[str, str] = {}
    for kind, words in synonyms.items():
        for w in words:
            table.setdefault(w, kind)
    by_size = sorted(types, key=len, reverse=True)
    pick = lambda cond, words: F.element_at(F.concat(F.filter(_lits(words), cond), F.array(F.lit(None).cast("string"))), 1)
    bare = F.regexp_replace(t, "[了过着]$", "")
    again = F.when(bare != t, F.coalesce(F.when(bare.isin(*types), bare), pick(lambda k: bare.endswith(k) | k.endswith(bare), types)))
    found = F.coalesce(F.when(t.isin(*types), t), F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t), pick(lambda k: t.contains(k) | k.contains(t), by_size), again, t)
    return F.when(t == "", F.col(raw)).otherwise(found)


def hint_entities(text: str) -> Column:
    """Entities of a hint: a JSON object or array, or lines name|type|aliases."""
    kind = "array<struct<name:string,type:string,aliases:array<string>>>"
    t = strip(text)
    obj = F.from_json(t, f"struct<entities:{kind},characters:{kind},people:{kind},items:{kind}>")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: (x != "") & ~x.startswith("#") & x.contains("|"))

    def one(x):
        p = F.transform(F.split(x, r"\|"), strip)
        names = F.when(F.size(p) > 2, F.filter(F.transform(F.split(F.element_at(p, 3), ","), strip), lambda a: a != "")).otherwise(F.array().cast("array<string>"))
        return F.struct(F.element_at(p, 1).alias("name"), F.element_at(p, 2).alias("type"), names.alias("aliases"))

    by_line = F.transform(lines, one).cast(kind)
    return F.when(t.startswith("{"), F.coalesce(obj["entities"], obj["characters"], obj["people"], obj["items"], by_line)).when(t.startswith("["), F.coalesce(F.from_json(t, kind), by_line)).otherwise(by_line)


def hint_candidates(text: str, entities: Column) -> Column:
    """Names (0.9) and aliases (0.7) of hinted entities that the text contains."""
    t = F.col(text)
    good = F.filter(entities, lambda e: F.char_length(e["name"]) >= 2)
    made = lambda word, e, source, sure: F.struct(word.alias("text"), F.coalesce(e["type"], F.lit("character")).alias("type"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
    return F.flatten(F.transform(good, lambda e: F.concat(F.filter(F.array(made(e["name"], e, "prior_hint", 0.9)), lambda s: t.contains(s["text"])), F.transform(F.filter(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: (F.char_length(a) >= 2) & t.contains(a)), lambda a: made(a, e, "prior_hint_alias", 0.7)))))


CITE = r'<cite\s+type="(\w+)"(?:\s+id="(\d+)")?[^>]*>([^<]+)</cite>'


def citations(answer: str) -> Column:
    """Citation tags of an answer: array of (type, id or 0, excerpt)."""
    parts = [F.regexp_extract_all(_c(answer), F.lit(CITE), k) for k in (1, 2, 3)]
    z = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("type", "id", "excerpt"), strict=True)])
    return F.transform(z, lambda x: F.struct(x["type"].alias("type"), F.coalesce(F.when(x["id"] != "", x["id"]).cast("long"), F.lit(0).cast("long")).alias("id"), x["excerpt"].alias("excerpt")))


def json_salvage(text: str) -> Column:
    """JSON as variant: the text, else a fenced block in it, else null."""
    fenced = F.regexp_extract(_c(text), r"```(?:json)?\s*([\s\S]*?)```", 1)
    return F.coalesce(F.try_parse_json(_c(text)), F.try_parse_json(F.when(fenced != "", fenced)))


def mapped(col: str, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(col)), F.lit(default))


def citation_errors(items: str) -> Column:
    """Errors of evidence items (source_type, source_id, excerpt)."""
    def of(i):
        bad_id = F.when(~i["source_type"].isin(*V.ZERO_ID_SOURCES) & (F.coalesce(i["source_id"], F.lit(0)) <= 0), F.concat(i["source_type"], F.lit(" has no valid id")))
        bad_text = F.when(F.coalesce(i["excerpt"], F.lit("")) == "", F.concat(i["source_type"], F.lit(":"), i["source_id"].cast("string"), F.lit(" has an empty excerpt")))
        return F.filter(F.array(bad_id, bad_text), lambda e: e.isNotNull())

    return F.flatten(F.transform(items, of))


def patch_errors(kind: str, risk: str, evidence: str | Column, target: str) -> Column:
    """Errors of a knowledge patch; evidence: how many pieces it has."""
    k, r = F.col(kind), F.col(risk)
    rules = [
        F.when(_c(evidence) < 1, F.lit("evidence missing")),
        F.when(k.isin(*V.HIGH_RISK) & ~r.isin("high", "critical"), F.lit("risk too low: high or critical")),
        F.when(k.isin(*V.CRITICAL) & (r != "critical"), F.lit("risk too low: critical")),
        F.when(k.isin(*V.CRITICAL) & (F.coalesce(F.col(target), F.lit(0)) == 0), F.lit("target missing")),
    ]
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def gate(n: str | Column, best: str | Column, entity: str | Column, retries: str | Column, least: int = 3, good: float = 0.4, most: int = 1) -> Column:
    """Decision on retrieved contexts: their number, the best of the first three scores, a known entity, retries so far."""
    again = F.when(_c(retries) < most, "retry_broader").otherwise("fail_insufficient")
    return F.when(_c(n) == 0, again).when((_c(n) >= least) & (_c(best) >= good), "pass").when(_c(entity).isNotNull() & (_c(entity) != ""), "retry_entity").otherwise(again)


def eval_scores(answer: str, n_citations: str) -> dict[str, Column]:
    """Score of an answer: has one (3), citations (at most 5), length by fifties (at most 3); fails without either."""
    a, n = F.coalesce(F.col(answer), F.lit("")), F.col(n_citations)
    has = (a != "").cast("int")
    quality = F.least(F.floor(F.char_length(a) / 50), F.lit(3)).cast("int")
    return {"has_answer": has, "citation_count": F.least(n, F.lit(5)).cast("int"), "answer_quality": quality, "total": (has * 3 + F.least(n, F.lit(5)) + quality).cast("int"), "passed": (a != "") & (n > 0)}


def final_status(errors: str | Column, has_answer: str | Column, has_citations: str | Column) -> Column:
    return F.when((_c(errors) > 0) & ~_c(has_answer), "FAILED").when(~_c(has_answer) & ~_c(has_citations), "INSUFFICIENT_EVIDENCE").otherwise("RESPONDED")


def stage_gate(stage2: str, stage3: str, override: str) -> Column:
    """Whether stage 3 may run."""
    return F.when(F.col(stage3) == "SUCCESS", False).when((F.col(stage2) == "SUCCESS") | F.col(override), True).otherwise(False)


def confirm_token(*parts: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of a state."""
    return F.left(F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256), F.lit(16))
