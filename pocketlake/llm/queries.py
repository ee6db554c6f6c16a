"""Queries of this folder over the whole tables, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_repair, divergence, html_extract, langid, packing, quality_bayes, simhash, source_audit, substring_dedup, token_fields, toxicity, va_search
from .shared import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"))


@query
def op6_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(read_table(spark, sf_dir, "embeddings"))


ORACLES["op6_vafile"] = """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fields.count_tokens(read_table(spark, sf_dir, "documents"))


@query
def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return divergence.judge(docs, divergence.learn_references(docs))


@query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_table(spark, sf_dir, "documents"))


ORACLES["op11_source_audit"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
),
tokens AS (
    SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM docs
),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
grps AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM grps AS g JOIN kept AS k ON g.lang = k.lang LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
langs AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
sp AS (
    SELECT lang, source, term, n,
           CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS BIGINT) AS p
    FROM cells JOIN v USING (lang)
),
lp AS (
    SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS BIGINT) AS q
    FROM langs JOIN v USING (lang)
),
distances AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM sp AS a JOIN sp AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
    FROM grps AS a JOIN grps AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distances AS d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
    FROM sp JOIN lp USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read_table(spark, sf_dir, "documents"))


ORACLES["op12_substring_dedup"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
places AS (SELECT r, doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM docs),
windows AS (SELECT r, doc_id, p, array_to_string(words[p : p + 12], ' ') AS body FROM places WHERE p + 12 <= len(words)),
firsts AS (SELECT body, min(doc_id) AS least FROM windows GROUP BY body),
starts AS (SELECT r, p FROM windows JOIN firsts USING (body) WHERE doc_id > least),
covered AS (
    SELECT a.r, a.p, a.words[a.p] AS word,
           count(s.p) OVER (PARTITION BY a.r ORDER BY a.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone
    FROM places AS a LEFT JOIN starts AS s ON a.r = s.r AND a.p = s.p
),
summed AS (
    SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
    FROM covered GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (r)
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audits(conversation_repair.damaged(read_table(spark, sf_dir, "conversations")))


ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE
crc AS (
    SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n) FOR n IN range(256)] AS t
),
lots AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([ord(x) FOR x IN string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), '')],
                           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS lot
    FROM conversations, crc
),
copies AS (SELECT * FROM lots WHERE lot <> 0 UNION ALL SELECT * FROM lots WHERE lot = 3),
damaged AS (
    SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM copies
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
    FROM damaged
),
r AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
           CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(last, '[.!?]') THEN 't' ELSE 's' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former
    FROM placed
),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
           count(*) FILTER (WHERE former IS NOT NULL AND concat(former, initial) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM r GROUP BY conv_id
),
back AS (
    SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS c FROM counts
    UNION ALL
    SELECT conv_id, i, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
    FROM (
        SELECT k.conv_id, r.i,
               [least(3 + k.c[s], CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE CASE WHEN fault = 't' THEN 1 ELSE 0 END + least(
                    2 + k.c[CASE WHEN s = 3 THEN 4 ELSE 3 END],
                    CASE WHEN initial = '' THEN k.c[s] WHEN s = 1 AND initial = 's' THEN k.c[2] WHEN s <> 3 AND initial = 'u' THEN k.c[3]
                         WHEN s = 3 AND initial = 'a' THEN k.c[4] ELSE 1000000000 END) END) FOR s IN range(1, 5)] AS b
        FROM back AS k JOIN r ON k.conv_id = r.conv_id AND r.i = k.i - 1
    )
),
ahead AS (
    SELECT conv_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counts
    UNION ALL
    SELECT conv_id, CASE WHEN op = 'I' THEN i ELSE i + 1 END,
           CASE WHEN op = 'D' OR op = 'K' AND initial = '' THEN s WHEN op = 'K' AND initial = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END,
           concat(audit, op),
           CASE op WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, concat(role, ':', text))
                ELSE list_append(lines, concat(CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END, ':', CASE WHEN op = 'I' THEN '' ELSE text END)) END
    FROM (
        SELECT w.*, r.initial, r.role, r.text,
               CASE WHEN r.i IS NULL THEN 'I'
                    WHEN 3 + n.c[w.s] = h.c[w.s] THEN 'D'
                    WHEN 2 + h.c[CASE WHEN w.s = 3 THEN 4 ELSE 3 END] = h.c[w.s] THEN 'I'
                    WHEN CASE WHEN fault = 't' THEN 1 ELSE 0 END + CASE WHEN initial = '' THEN n.c[w.s] WHEN w.s = 1 AND initial = 's' THEN n.c[2]
                         WHEN w.s <> 3 AND initial = 'u' THEN n.c[3] WHEN w.s = 3 AND initial = 'a' THEN n.c[4] END = h.c[w.s] THEN 'K'
                    ELSE 'R' END AS op
        FROM ahead AS w JOIN back AS h ON h.conv_id = w.conv_id AND h.i = w.i
        LEFT JOIN r ON r.conv_id = w.conv_id AND r.i = w.i
        LEFT JOIN back AS n ON n.conv_id = w.conv_id AND n.i = w.i + 1
        WHERE r.i IS NOT NULL OR w.s IN (2, 3)
    )
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(h.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a
LEFT JOIN counts USING (conv_id)
LEFT JOIN back AS h ON h.conv_id = a.conv_id AND h.i = 1
LEFT JOIN ahead AS w ON w.conv_id = a.conv_id AND w.i = counts.n + 1 AND w.s IN (1, 4)
"""
