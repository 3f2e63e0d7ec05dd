"""Retrieval for many questions at once: dense, lexical, entity and structured candidates, and their contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.vector_index import exact_topk

#: Numbers in the vectors of a block of queries.
SMALL = 500_000


def dense_topk(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, k: int) -> DataFrame:
    """The k items nearest to each query by cosine: blocks of queries times pieces of items, both dealt by hash."""
    return exact_topk(items, queries, item_id, query_id, vector, k, SMALL)


def words_of(text: str, pattern: str = "[A-Za-z]+") -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.lower))


def lexical(chunks: DataFrame, keywords: DataFrame, query: str, word: str, chunk_key: list[str], text: str, per_word: int, score: float = 0.8, stem: int = 4) -> DataFrame:
    """Chunks whose text contains a keyword (of letters, any case), so many a keyword, each chunk once a query.

    Keywords are looked for once in the vocabulary of all chunks, where those that share `stem` letters meet in an
    equi-join and are verified; then words meet words.  No text is compared with every keyword.
    """
    inv = chunks.select(*chunk_key, F.explode(words_of(text)).alias("_w"))
    asked = keywords.select(query, F.lower(word).alias("keyword")).distinct()
    stems = asked.select("keyword").distinct().withColumn("_k", F.left("keyword", F.lit(stem)))
    cut = F.transform(F.sequence(F.lit(1), F.char_length("_w")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(stem)), lambda n: F.substring("_w", i, n)))
    parts = inv.select("_w").distinct().select("_w", F.explode(F.array_distinct(F.flatten(cut))).alias("_k"))
    holds = parts.join(stems, "_k").where(F.contains("_w", "keyword")).select("_w", "keyword")
    hit = holds.join(inv, "_w").select("keyword", *chunk_key).distinct()
    n = F.row_number().over(Window.partitionBy("keyword").orderBy(*chunk_key))
    few = asked.join(hit.withColumn("_n", n).where(F.col("_n") <= per_word).drop("_n"), "keyword")
    return few.groupBy(query, *chunk_key).agg(F.min("keyword").alias("keyword"), F.count(F.lit(1)).alias("keywords")).withColumn("score", F.lit(score))


def lexical_grams(chunks: DataFrame, keywords: DataFrame, query: str, word: str, chunk_key: list[str], text: str, budget: int = 16, least: int = 2, score: float = 0.8, letters: str = r"\p{L}", stem: int = 4) -> DataFrame:
    """Chunks whose text contains a keyword (of `letters`, any case): of each keyword the first max(budget / keywords of
    the question, least) chunks by key, each chunk once a query.

    The first `budget` chunks of a keyword are among the first `budget` of the words that contain it, so each word sends so
    many chunks and no more (limited before the shuffle, a word may stand in every chunk), and keywords meet the words by
    grams of at most `stem` letters.  Null, blank and repeated keywords count for nothing; a null text holds none.
    """
    n = F.row_number().over(Window.partitionBy("_w").orderBy(*chunk_key))
    w = chunks.select(*chunk_key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([{letters}]+)"), 1))).alias("_w"))
    w = w.withColumn("_n", n).where(F.col("_n") <= budget).groupBy("_w").agg(F.collect_list(F.struct(*chunk_key)).alias("_at"))
    asked = keywords.select(query, F.lower(word).alias("keyword")).where("keyword <> ''").distinct()
    asked = asked.withColumn("_most", F.greatest(F.floor(F.lit(budget) / F.count(F.lit(1)).over(Window.partitionBy(query))), F.lit(least)))
    stems = keywords.select(F.lower(word).alias("keyword")).where("keyword <> ''").distinct().withColumn("_k", F.left("keyword", F.lit(stem)))
    parts = w.select("_w", "_at", F.explode(F.sequence(F.lit(1), F.char_length("_w"))).alias("_i"))
    parts = parts.select("_w", "_at", F.explode(F.array(*[F.substring("_w", F.col("_i"), F.lit(k)) for k in range(1, stem + 1)])).alias("_k"))
    hit = parts.join(stems, "_k").where(F.contains("_w", "keyword")).select("keyword", F.explode("_at").alias("_c"))
    hit = hit.groupBy("keyword", *[F.col(f"_c.{k}").alias(k) for k in chunk_key]).agg(F.count(F.lit(1)).alias("_words"))
    n = F.row_number().over(Window.partitionBy("keyword").orderBy(*chunk_key))
    few = asked.join(hit.withColumn("_n", n).where(F.col("_n") <= budget), "keyword").where("_n <= _most")
    return few.groupBy(query, *chunk_key).agg(F.min("keyword").alias("keyword"), F.count(F.lit(1)).alias("keywords")).withColumn("score", F.lit(score))


def expanded(questions: DataFrame, aliases: DataFrame, query: str, question: str, most: int = 5) -> DataFrame:
    """Questions to embed: behind each the first `most` of its aliases, by code point, that it does not contain."""
    a = aliases.join(questions, query).where(~F.contains(F.col(question), F.col("alias"))).groupBy(query).agg(F.slice(F.array_sort(F.collect_set("alias")), 1, most).alias("_a"))
    return questions.join(a, query, "left").select(query, F.concat_ws(" ", question, "_a").alias("text"))


def containing(chunks: DataFrame, names: DataFrame, name: str, key: list[str], text: str, stem: int = 4) -> DataFrame:
    """(name, key...) of the chunks whose text contains a name (at least `stem` letters, case as it is).

    Each word meets the names by its grams of `stem` letters and is verified; names that are few are sent to the words, so
    no word is shuffled, only what was found.
    """
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1))
    w = chunks.select(*key, F.explode(words).alias("_w")).where(F.char_length("_w") >= stem)
    cut = w.select(*key, "_w", F.explode(F.sequence(F.lit(1), F.char_length("_w") - (stem - 1))).alias("_i")).select(*key, "_w", F.substring("_w", F.col("_i"), F.lit(stem)).alias("_k"))
    wanted = names.select(name).distinct().withColumn("_k", F.left(name, F.lit(stem)))
    return cut.join(wanted, "_k").where(F.contains("_w", name)).select(name, *key).distinct()


def names_in(questions: DataFrame, names: DataFrame, query: str, question: str, name: str, stem: int = 2) -> DataFrame:
    """Known names (of `stem` letters at least) that a question contains anywhere."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(question) - (stem - 1), F.lit(1))), lambda i: F.substring(question, i, F.lit(stem)))
    q = questions.select(query, question, F.explode(F.array_distinct(at)).alias("_k"))
    n = names.select(name).distinct().withColumn("_k", F.left(name, F.lit(stem)))
    return q.join(n, "_k").where(F.contains(question, name)).select(query, name).distinct()


def expand_aliases(found: DataFrame, profiles: DataFrame, query: str, name: str, aliases: str, least: int = 2) -> DataFrame:
    """Aliases of the names found, short ones left out, as further keywords."""
    a = found.join(profiles.select(name, aliases), name).select(query, F.explode(aliases).alias("alias"))
    return a.where(F.char_length("alias") >= least).distinct()


def knowledge(branches: list[tuple[DataFrame, str, float, int]], query: str, extra: list[str] = [], per: list[str] = []) -> DataFrame:  # noqa: B006
    """Union of branches of structured knowledge (hits (key, n, text), source, score, most a query), largest n first.

    per: columns of the hits that, with the query, have so many each (what two of them find is there once).  The id is the first 60 bits of the key's MD5.
    """
    out = []
    for hits, source, score, most in branches:
        rank = F.row_number().over(Window.partitionBy(query, *per).orderBy(F.desc("n"), "key"))
        id_ = F.conv(F.left(F.md5("key"), F.lit(15)), 16, 10).cast("long")
        out.append(hits.withColumn("_n", rank).where(F.col("_n") <= most).select(query, F.lit(source).alias("source"), id_.alias("id"), F.lit(score).alias("score"), "text", *extra))
    return reduce(DataFrame.unionByName, [x.distinct() for x in out] if per else out)


def contexts(hits: DataFrame, texts: DataFrame, query: str, limits: dict[str, int], top: int) -> DataFrame:
    """Texts of the hits (source, id), cut as their source asks, each once, best first; other sources go."""
    size = reduce(lambda c, kv: F.when(F.col("source") == kv[0], F.lit(kv[1])).otherwise(c), limits.items(), F.lit(0))
    once = hits.groupBy(query, "source", "id").agg(F.max("score").alias("score")).where(F.col("source").isin(*limits))
    c = once.join(texts, ["source", "id"]).withColumn("text", F.left("text", size))
    n = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "source", "id"))
    return c.withColumn("rank", n.cast("int")).where(F.col("rank") <= top)


def excerpt(text: str, word: str | Column, before: int = 80, after: int = 140) -> Column:
    """Text around the first place of a word, white space collapsed."""
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    at = F.instr(flat, F.lit(word) if isinstance(word, str) else word)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(flat, start, at + after - start)).otherwise(F.left(flat, F.lit(before + after)))


def resolve_citations(cites: DataFrame, context: DataFrame, query: str) -> DataFrame:
    """Citations (type, id) to contexts: by type and id, else by position from 1."""
    by_id = context.select(query, F.col("source").alias("type"), "id", F.struct("source", "id", "rank").alias("_a"))
    by_place = context.select(query, F.col("rank").cast("long").alias("id"), F.struct("source", "id", "rank").alias("_b"))
    j = cites.join(by_id, [query, "type", "id"], "left").join(by_place, [query, "id"], "left")
    got = F.coalesce("_a", "_b")
    return j.select(query, "type", "id", got["source"].alias("actual_type"), got["id"].alias("actual_id"))
