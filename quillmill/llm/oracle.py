"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

from quillmill.llm import mixing

_WS = r"[\x20\x09-\x0D]+"

RULE_LEDGER = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 3),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM win),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + x) AS n FROM dup, (VALUES (0), (1), (2)) v(x) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct_words,
  length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  length(t) - length(replace(t, '!', '')) AS n_exclaim FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
  + 8 * CAST(n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) AS BIGINT) + 16 * CAST(n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines AS BIGINT)
  + 32 * CAST(n_words >= 50 AND 10 * n_distinct_words < n_words AS BIGINT) + 64 * CAST(n_letters >= 50 AND 10 * n_upper > 7 * n_letters AS BIGINT)
  + 128 * CAST(n_words > 0 AND 2 * n_exclaim > n_words AS BIGINT) + 256 * CAST(n_words > 10000000 AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f"""


def sharding(limit: int) -> str:
    return f"""WITH r AS (SELECT row_number() OVER () AS i, doc_id, CAST(coalesce(strlen(text), 0) + 32 AS BIGINT) AS row_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
k AS (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS depth),
b AS (SELECT depth, h >> (60 - depth) AS p FROM r, k GROUP BY 1, 2 HAVING sum(row_bytes) <= {limit}),
s AS (SELECT i, doc_id, row_bytes, h, min(b.depth) AS depth FROM r JOIN b ON b.p = r.h >> (60 - b.depth) GROUP BY ALL)
SELECT doc_id, row_bytes, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard, depth FROM s"""


def mixed(seed: int = 17) -> str:
    weights = "CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END"
    tie = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '')) AS BIGINT) AS size, {tie} AS tie FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, {weights} AS weight, CAST({mixing.MOST} * source_size AS DOUBLE) AS cap FROM g),
o AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, rn) AS k FROM w),
l AS (SELECT k, ratio, (CAST({mixing.SHARE} * sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM o),
u AS (SELECT unit FROM l WHERE unit <= ratio ORDER BY k LIMIT 1),
t AS (SELECT o.source, source_size, docs, least(cap, unit * weight) AS target,
  CAST('0x' || substr(sha256(CASE WHEN o.source IS NULL THEN chr(1) ELSE 's' || o.source END || '{seed}'), 1, 12) AS BIGINT) / 281474976710656.0 AS off FROM o, u),
p AS (SELECT d.*, t.source_size, t.target, t.docs, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY size, tie % {mixing.CELLS}, tie) AS rk FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN rk % 2 = 1 THEN (rk + 1) // 2 ELSE docs + 1 - rk // 2 END AS place FROM p)
SELECT doc_id, size, source_size, target, CAST((floor(place * rate + off) - floor((place - 1) * rate + off)) * size AS BIGINT) AS taken, source FROM q"""
