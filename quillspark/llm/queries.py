"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.embedding_dedup import embedding_dedup
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.hard_negatives import hard_negatives
from quillspark.llm.html_text import extract_pages
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.langid import identify
from quillspark.llm.lexical_index import ranked_search
from quillspark.llm.line_dedup import line_dedup
from quillspark.llm.mixing import mix
from quillspark.llm.sentencepieces import encode
from quillspark.llm.substring_dedup import substring_dedup
from quillspark.llm.url_filter import url_filter
from quillspark.llm.warc import write_and_read

#: The model file of op2 and the pipeline.
PIECES = os.environ.get("QUILLSPARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), PIECES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "pages"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sentencepiece, op3_language_id, op4_mixing, op5_url_filter, op6_warc, op7_html_extraction, op8_embedding_dedup, op9_jaccard_join, op10_exact_dedup, op11_line_dedup, op12_hard_negatives, op13_lexical_search)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t
         FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
 f AS (SELECT t, min(doc_id) AS first FROM win GROUP BY t),
 hit AS (SELECT doc_id, i FROM win JOIN f USING (t) WHERE first < doc_id),
 cov AS (SELECT doc_id, list(DISTINCT p) AS p
         FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id)""",
    "op4_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
        source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
 l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 e AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
 t AS (SELECT source, source_size, CASE WHEN e.level IS NULL THEN cap ELSE least(cap, e.level * weight) END AS target FROM l, e),
 g AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS BIGINT) AS whole FROM t),
 x AS (SELECT *, CAST(greatest(0, round(target - whole * source_size)) AS BIGINT) AS extra FROM g),
 r AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.extra,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM r""",
    "op5_url_filter": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 b AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p),
 l AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
 c AS (SELECT bare, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM b LEFT JOIN l USING (page_id) GROUP BY 1),
 h AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare
        WHEN regexp_matches(bare, '(^|\.)[^.]+\.(?:ac|co|com|edu|gov|net|or|org)\.[a-z]{2}$') THEN regexp_extract(bare, '[^.]+\.(?:ac|co|com|edu|gov|net|or|org)\.[a-z]{2}$')
        WHEN regexp_extract(bare, '[^.]+\.[^.]+$') = '' THEN bare ELSE regexp_extract(bare, '[^.]+\.[^.]+$') END AS domain FROM c),
 hs AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN '' ELSE regexp_extract(domain, '^[^.]*\.?(.*)$', 1) END AS suffix FROM h),
 m AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m0 FROM hs),
 s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS m0 FROM hs, m GROUP BY 1),
 ks AS (SELECT sum((bad - n * m0) ** 2 / n) AS s, sum(m0 * (1 - m0)) AS v, sum((n - 1) * m0 * (1 - m0)) AS o FROM s0 WHERE n > 0),
 ks1 AS (SELECT CASE WHEN coalesce(o, 0) = 0 THEN 10.0 WHEN (s - v) / o > 0 THEN least(1000.0, greatest(1.0, o / (s - v) - 1)) ELSE 1000.0 END::DOUBLE AS k FROM ks),
 s1 AS (SELECT suffix, (k * m0 + bad) / (k + n) AS ms FROM s0, ks1),
 d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(ms) AS ms FROM hs JOIN s1 USING (suffix) GROUP BY 1, 2),
 kd AS (SELECT sum((bad - n * ms) ** 2 / n) AS s, sum(ms * (1 - ms)) AS v, sum((n - 1) * ms * (1 - ms)) AS o FROM d0 WHERE n > 0),
 kd1 AS (SELECT CASE WHEN coalesce(o, 0) = 0 THEN 10.0 WHEN (s - v) / o > 0 THEN least(1000.0, greatest(1.0, o / (s - v) - 1)) ELSE 1000.0 END::DOUBLE AS k FROM kd),
 d1 AS (SELECT suffix, domain, (k * ms + bad) / (k + n) AS md FROM d0, kd1),
 h0 AS (SELECT hs.*, md FROM hs JOIN d1 USING (suffix, domain)),
 kh AS (SELECT sum((bad - n * md) ** 2 / n) AS s, sum(md * (1 - md)) AS v, sum((n - 1) * md * (1 - md)) AS o FROM h0 WHERE n > 0),
 kh1 AS (SELECT CASE WHEN coalesce(o, 0) = 0 THEN 10.0 WHEN (s - v) / o > 0 THEN least(1000.0, greatest(1.0, o / (s - v) - 1)) ELSE 1000.0 END::DOUBLE AS k FROM kh),
 h1 AS (SELECT bare, k, n, (k * md + bad) / (k + n) AS mean FROM h0, kh1),
 h2 AS (SELECT bare, mean - 1.645 * sqrt(mean * (1 - mean) / (k + n + 1)) AS low FROM h1),
 r(rule, name, start, said) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
 f AS (SELECT p.page_id, p.host, p.path, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
       FROM (SELECT DISTINCT host, path, page_id FROM p) p JOIN r ON (p.host = name OR p.host LIKE '%.' || name) AND starts_with(p.path, start) GROUP BY 1, 2, 3)
SELECT b.page_id, b.host, b.path, f.rule, coalesce(f.said, CASE WHEN h2.low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(h2.low, 9) AS bad_lower_bound
FROM b LEFT JOIN h2 USING (bare) LEFT JOIN f ON b.page_id = f.page_id AND b.host = f.host AND b.path = f.path""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
 d AS (SELECT page_id, payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM d""",
    "op8_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
 reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
 comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1), cnt AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(cnt.n, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON v.vec_id = comp.id LEFT JOIN cnt ON v.vec_id = cnt.a""",
    "op9_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
 comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
 w AS (SELECT doc_id, sha256(n) AS text_sha256,
        first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, i, l[i] AS line, len(l) AS n, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
         FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
 k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 j AS (SELECT l.*, k.top IS NOT NULL AND doc_id < k.top AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op12_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
       FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE same) WHERE nth <= 5),
 n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
       FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_lexical_search": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
 c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
 m AS (SELECT doc_id, 75 + (25 * n * big_n) // big_l AS m, big_n FROM n, c),
 q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT big_n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf GROUP BY 1),
 s AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}
