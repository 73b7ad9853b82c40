"""DuckDB SQL for the queries that SQL can express on whole tables."""

from lodestone.llm import quality
from lodestone.llm.hash_sql import xxh64

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Base counts, then buckets of words (seed 42) and of word pairs (the number 2, the first and the second word in a chain of seeds).
OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i < len(w) THEN w[i + 1] END AS b, CASE WHEN i + 1 < len(w) THEN array_to_string(w[i:i + 2], ' ') END AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
p AS (SELECT doc_id, i FROM t WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, c) > 1),
u AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM p, (VALUES (0), (1), (2)) AS x(j) GROUP BY 1),
q0 AS (SELECT 0 AS k, '02000000' AS h, 42::UHUGEINT AS seed), {xxh64("q0", "two")},
q1 AS (SELECT a AS k, lower(hex(encode(a))) AS h, 42::UHUGEINT AS seed FROM (SELECT DISTINCT a FROM t)), {xxh64("q1", "ones")},
q2 AS (SELECT k, h, (SELECT x FROM two)::UHUGEINT AS seed FROM q1), {xxh64("q2", "firsts")},
q3 AS (SELECT a || ' ' || b AS k, lower(hex(encode(b))) AS h, x::UHUGEINT AS seed FROM (SELECT DISTINCT a, b FROM t WHERE b IS NOT NULL) JOIN firsts ON firsts.k = a), {xxh64("q3", "seconds")},
g AS (SELECT doc_id, x % {quality.BUCKETS} AS bucket FROM t JOIN ones ON k = a UNION ALL SELECT doc_id, x % {quality.BUCKETS} FROM t JOIN seconds ON k = a || ' ' || b),
n AS (SELECT bucket, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS good FROM g GROUP BY 1),
v AS (
  SELECT bucket, CASE WHEN (SELECT sum(good) FROM n) = 0 THEN 0.0 ELSE
         ln((good + {quality.SMOOTHING}) / ((SELECT sum(good) FROM n)::DOUBLE + {quality.SMOOTHING * quality.BUCKETS})) - ln((raw + {quality.SMOOTHING}) / ((SELECT sum(raw) FROM n)::DOUBLE + {quality.SMOOTHING * quality.BUCKETS})) END AS weight FROM n
),
r AS (SELECT doc_id, avg(weight) AS ratio FROM g JOIN v ON v.bucket = g.bucket GROUP BY 1),
o AS (
  SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(u.n, 0) AS n_repeat_words, ratio
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
),
z AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(ratio >= {quality.THRESHOLD}, false) AS kept, round(ratio, 6) AS log_ratio FROM z
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
p AS (
  SELECT conv_id >> 1 AS pair_id, max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) AS chosen, max(CASE WHEN conv_id % 2 <> 0 THEN conv_id END) AS rejected
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
),
c AS (SELECT pair_id, k, role, text FROM p JOIN t ON t.conv_id = p.chosen),
b AS (SELECT pair_id, k, role, text FROM p JOIN t ON t.conv_id = p.rejected),
lc AS (SELECT pair_id, max(k) AS k FROM c WHERE role = 'assistant' GROUP BY 1),
lb AS (SELECT pair_id, max(k) AS k FROM b WHERE role = 'assistant' GROUP BY 1),
r AS (
  SELECT c.* FROM c JOIN lc ON lc.pair_id = c.pair_id WHERE c.k < lc.k
  UNION ALL SELECT b.pair_id, lc.k, b.role, b.text FROM b JOIN lb ON lb.pair_id = b.pair_id AND lb.k = b.k JOIN lc ON lc.pair_id = b.pair_id
  UNION ALL SELECT b.* FROM b WHERE b.pair_id NOT IN (SELECT pair_id FROM lc)
),
a AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, c.role AS r0, c.text AS t0, r.role AS r1, r.text AS t1,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.k = r.k
),
x AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN k END), max(k) + 1) AS n FROM a GROUP BY 1),
e AS (
  SELECT a.pair_id, a.k, x.n, r0, r1,
         '<|' || r0 || '|>' || chr(10) || t0 || chr(10) || '<|end|>' || chr(10) AS s0,
         '<|' || r1 || '|>' || chr(10) || t1 || chr(10) || '<|end|>' || chr(10) AS s1,
         length(r0) + 5 AS h0, length(r1) + 5 AS h1
  FROM a JOIN x ON a.pair_id = x.pair_id
),
l AS (
  SELECT *, sum(CASE WHEN k >= n THEN length(s0) ELSE 0 END) OVER w AS e0, sum(CASE WHEN k >= n THEN length(s1) ELSE 0 END) OVER w AS e1
  FROM e WINDOW w AS (PARTITION BY pair_id ORDER BY k)
),
g AS (
  SELECT pair_id,
         string_agg(CASE WHEN k < n THEN s0 END, '' ORDER BY k) AS prompt,
         string_agg(CASE WHEN k >= n THEN s0 END, '' ORDER BY k) AS chosen,
         string_agg(CASE WHEN k >= n AND r0 = 'assistant' THEN CAST(CAST(e0 - length(s0) + h0 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e0 AS BIGINT) AS VARCHAR) END, ',' ORDER BY k) AS chosen_mask,
         string_agg(CASE WHEN k >= n THEN s1 END, '' ORDER BY k) AS rejected,
         string_agg(CASE WHEN k >= n AND r1 = 'assistant' THEN CAST(CAST(e1 - length(s1) + h1 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY k) AS rejected_mask
  FROM l GROUP BY 1
)
SELECT p.pair_id, p.chosen AS chosen_id, p.rejected AS rejected_id, CAST(coalesce(x.n, 0) AS INTEGER) AS n_prompt_turns,
       coalesce(g.prompt, '') AS prompt, coalesce(g.chosen, '') AS chosen, coalesce(g.chosen_mask, '') AS chosen_mask,
       coalesce(g.rejected, '') AS rejected, coalesce(g.rejected_mask, '') AS rejected_mask
FROM p LEFT JOIN g ON p.pair_id = g.pair_id LEFT JOIN x ON p.pair_id = x.pair_id
"""

OP6 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(max(list_dot_product(q.e, c.e)) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

#: Windows of 100 bytes, as figures of base 16, by their MD5.
OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substring(h, CAST(2 * i + 1 AS BIGINT), 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
e AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM e),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, z AS from_, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS to_ FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY 1),
kept AS (SELECT k.doc_id, string_agg(substring(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (to_ - from_) AS BIGINT)), '' ORDER BY from_) AS h FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY 1),
n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Shingles and their hashes, bits by majority, links of all pairs of distinct fingerprints.
OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
),
g AS (SELECT t AS k, lower(hex(encode(t))) AS h, 42::UHUGEINT AS seed FROM (SELECT DISTINCT t FROM s)),
{xxh64("g", "hashed")},
b AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((x >> {i}) & 1) AS b{i}" for i in range(64))} FROM s JOIN hashed ON k = t GROUP BY 1),
f AS (
  SELECT d.doc_id, CAST(coalesce({" + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::UHUGEINT ELSE 0 END" for i in range(64))}, 0) AS UBIGINT) AS fp
  FROM d LEFT JOIN b ON b.doc_id = d.doc_id
),
r AS (SELECT fp, min(doc_id) AS rep FROM f GROUP BY 1),
e AS (SELECT a.rep AS i, b.rep AS j FROM r a JOIN r b ON bit_count(xor(a.fp, b.fp)) <= 2),
reach(node, root) AS (SELECT rep, rep FROM r UNION SELECT e.j, reach.root FROM reach JOIN e ON e.i = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
SELECT f.doc_id, lpad(lower(to_hex(f.fp)), 16, '0') AS fingerprint, c.component_id
FROM f JOIN r ON r.fp = f.fp JOIN c ON c.node = r.rep
"""

ORACLES = {"op1_quality_rules": OP1, "op5_chat_formatting": OP5, "op6_exact_topk": OP6, "op7_simhash_dedup": OP7, "op8_suffix_dedup": OP8}
