"""DuckDB SQL that gives the same rows as the queries of the same names.

Those not here: token ids and byte repeats are held against brute force by the tests, the language model in its base columns and
in sums of probabilities, surrogates and licences by examples.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
#: crc32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
 lambda c, b: list_reduce([8, 7, 6, 5, 4, 3, 2, 1], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295))"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
link AS (SELECT p.doc_id AS u, q.doc_id AS v FROM common JOIN n p ON p.r = ra JOIN n q ON q.r = rb WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
walk AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT edge.v, walk.root FROM walk JOIN edge ON edge.u = walk.node AND walk.root < edge.v),
comp AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) LEFT JOIN comp ON comp.node = d.doc_id""",
    "op3_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM d),
three AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
many AS (SELECT r, g FROM three GROUP BY r, g HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM three JOIN many USING (r, g), (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
base AS (SELECT r, doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN hit USING (r)),
rule AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper,
 length(regexp_replace(t, '[^A-Za-z]', '', 'g')) + octet_length(encode(t)) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS letters,
 len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND 10 * n_symbols <= 2 * n_words AND 10 * n_dup_lines <= n_words AND 2 * n_words <= word_chars AND word_chars <= 20 * n_words AND 2 * upper <= letters AND 10 * lettered >= 6 * n_words AS kept FROM rule""",
    "op4_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
place AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
met AS (SELECT r, i, k, item_id FROM place JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
own AS (SELECT r, count(item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
    "op6_mixing": f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
 (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS per FROM s),
o AS (SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM f) - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0) AS words_left, (SELECT CAST(sum(weight) AS BIGINT) FROM f) - coalesce(CAST(sum(weight) OVER b AS BIGINT), 0) AS weight_left
 FROM f WINDOW b AS (ORDER BY per, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(words_left / weight_left, per) AS level FROM o WHERE per > words_left / weight_left),
t AS (SELECT source, source_size, n_docs, CASE WHEN level IS NULL OR per <= level THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM o, lv),
x AS (SELECT d.*, t.source_size, t.n_docs, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(floor(share) AS BIGINT) AS whole, CASE WHEN share > floor(share) THEN target - CAST(floor(share) AS BIGINT) * source_size ELSE 0 END AS rest, CAST(2 * size AS DOUBLE) / nullif(size + source_size / n_docs, 0) AS f FROM x),
h AS (SELECT source, f, any_value(rest) AS rest, CAST(sum(size) AS BIGINT) AS words FROM p WHERE rest > 0 AND size > 0 GROUP BY source, f),
c AS (SELECT *, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open, sum(f * words) OVER (PARTITION BY source ORDER BY f DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighed FROM h),
sc AS (SELECT source, max(f) AS least_certain, greatest(arg_max(open, f), 0) / arg_max(weighed, f) AS scale FROM c WHERE open * f < weighed GROUP BY source),
q AS (SELECT p.*, rest > 0 AND size > 0 AS drawn, CASE WHEN scale IS NULL OR f > least_certain THEN 0 ELSE (u / (1 - u)) / (scale * f / (1 - scale * f)) END AS odds FROM p LEFT JOIN sc ON p.source IS NOT DISTINCT FROM sc.source),
k AS (SELECT *, coalesce(sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN isinf(odds) THEN 1 ELSE odds / (1 + odds) END, doc_id NULLS FIRST, u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN drawn AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k""",
    "op11_periodic_runs": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, {_CRC} AS h FROM documents),
p AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
u AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM p),
word AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM u),
often AS (SELECT * FROM word SEMI JOIN (SELECT r, x FROM word GROUP BY r, x HAVING count(*) >= 4) USING (r, x)),
same AS (SELECT f.r, f.i, e.i - f.i AS q FROM often f JOIN often e ON f.r = e.r AND f.x = e.x AND e.i > f.i AND 4 * (e.i - f.i) <= f.n),
island AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, start, length, min(q) AS period FROM island GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
every AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t, min((-length, start, period)) AS best FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period, CAST((1000 * -best[1]) // best[3] AS BIGINT) AS exponent_milli,
 sha256(coalesce(every.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256 FROM d LEFT JOIN every USING (r) LEFT JOIN kept USING (r)""",
    "op12_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_TERMS}) AS t FROM documents),
item AS (SELECT row_number() OVER () AS b, item_id, list_distinct(regexp_extract_all({_LOWER}, {_TERMS})) AS t FROM benchmark),
term AS (SELECT b, item_id, unnest(t) AS x FROM item),
place AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(t) AS x FROM d) WHERE x IN (SELECT x FROM term) GROUP BY r, x),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
weight AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT x, count(*) AS df FROM place GROUP BY x), total),
size AS (SELECT r, doc_id, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0),
score AS (SELECT b, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM term JOIN place USING (x) JOIN weight USING (x) JOIN size USING (r) GROUP BY b, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= 10""",
}
