"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import re

from . import quality

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, (CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight,
         2::DOUBLE * source_size AS cap
  FROM src),
ranked AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
         sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, pos) AS k
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (1.5::DOUBLE * total - cap_before) / weight_left AS level
  FROM ranked
  WHERE (1.5::DOUBLE * total - cap_before) / weight_left * weight <= cap
  ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, level * weight) AS target,
         ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 8))::UBIGINT::DOUBLE
           / 4294967296::DOUBLE AS shift
  FROM weighed, level),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS pos FROM sized),
rated AS (
  SELECT p.doc_id, p.size, p.pos, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(floor(rate * pos + shift) - floor(rate * (pos - 1) + shift), 2)::BIGINT * size AS taken
FROM rated
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
seen AS (
  SELECT doc_id, part, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS copy,
         len(words) AS n_words, len(list_distinct(words)) AS n_distinct, length(text) AS n_chars,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
         regexp_matches(text, '[#$%&*|]') AS symbol
  FROM texts),
known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good,
         coalesce(bool_or(toxic = 1), FALSE) AS toxic
  FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         [n_words < 200, 100 * n_distinct < 50 * n_words, 100 * n_capitals > 2 * n_chars, symbol, copy] AS fails
  FROM seen LEFT JOIN known USING (doc_id)),
orders AS (
  SELECT [a, b, c, d, e] AS o
  FROM range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
grouped AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM marked GROUP BY ALL),
placed AS (
  SELECT part, o, step, o[step] AS f, fails, good, toxic, n,
         coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), FALSE) AS gone,
         fails[o[step]] AS failing,
         list_bool_or(fails) AND len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM grouped, orders, range(1, 6) t(step)),
steps AS (
  SELECT part, o, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failing AND single), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY part, o, step, f)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order,
       step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
"""

FILL_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS y,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100
              THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:least(x, y)], ''), '') AS p,
         coalesce(array_to_string(units[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(x, y) + 1:n], ''), '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

LINE_DEDUP = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT row, doc_id, text, line, spot,
         translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM texts)),
common AS (
  SELECT key FROM (SELECT DISTINCT key, doc_id, text FROM lines WHERE key <> '')
  GROUP BY key HAVING count(*) >= 10),
kept AS (
  SELECT row, doc_id, line, spot, key IN (SELECT key FROM common) AS gone FROM lines)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY row, doc_id
"""

SHARDING = r"""
WITH crc AS (  -- the table of CRC-32, and each text's bytes through it
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
docs AS (
  SELECT doc_id, CASE WHEN doc_id IS NULL THEN 'n' ELSE 'k' || doc_id END AS key,
         octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                        lambda h: ('0x' || h)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM documents, crc),
scored AS (
  SELECT *, list_transform(range(25), lambda s: -1 / ln(
    ((('0x' || substr(md5('shard:' || s || ':' || key), 1, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496)) AS score
  FROM docs),
placed AS (
  SELECT doc_id, key, size, crc, list_position(score[1:24], list_max(score[1:24])) - 1 AS shard,
         list_position(score, list_max(score)) - 1 AS grown
  FROM scored)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || key), doc_id NULLS FIRST, crc, size) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM placed
"""

NEAR_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM texts),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM edges
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

QUALITY = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, v) AS times
  FROM (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS v
        FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5))),
repeated AS (
  SELECT row, count(DISTINCT i + k) AS n FROM windows, range(5) t(k) WHERE times > 1 GROUP BY row),
counted AS (
  SELECT x.row, doc_id, lang, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, length(text) AS chars, len(regexp_extract_all(text, '\p{Lu}')) AS upper,
         len(regexp_extract_all(text, '[0-9]')) AS digits,
         len(regexp_extract_all(text, '[.,;:!?''"()\[\]-]')) AS points,
         list_transform(w, lambda y: lower(rtrim(y, '.,;:!?'))) AS flat
  FROM lines x LEFT JOIN repeated r ON x.row = r.row),
hists AS (
  SELECT *, n_words < MIN_WORDS OR 100 * n_repeat_words > MAX_REPEAT * n_words AS base_failed,
         [greatest(word_chars - n_symbols - upper - digits - points, 0), upper, digits, points, n_symbols,
          greatest(chars - word_chars, 0)] AS c,
         list_transform([COMMON], lambda x: len(list_filter(flat, lambda y: y = x))) AS common
  FROM counted),
shares AS (
  SELECT *, list_transform(c, lambda x: CASE WHEN list_sum(c) > 0 THEN x / list_sum(c)::DOUBLE ELSE 0 END) AS cp,
         list_transform(list_append(common, n_words - coalesce(list_sum(common), 0)::BIGINT),
                        lambda x: CASE WHEN n_words > 0 THEN x / n_words::DOUBLE ELSE 0 END) AS wp
  FROM hists),
steps AS (
  SELECT lang, k, round(share * STEPS)::INTEGER AS step, count(*) AS n
  FROM (SELECT lang, unnest(list_concat(cp, wp)) AS share, generate_subscripts(list_concat(cp, wp), 1) AS k
        FROM shares WHERE NOT base_failed) GROUP BY ALL),
medians AS (
  SELECT lang, k, min(step) / STEPS.0 AS m
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, k ORDER BY step) AS upto, sum(n) OVER (PARTITION BY lang, k) AS every FROM steps)
  WHERE 2 * upto >= every GROUP BY lang, k),
refs AS (
  SELECT lang, list(m::DOUBLE ORDER BY k) FILTER (k <= 6) AS rc, list(m::DOUBLE ORDER BY k) FILTER (k > 6) AS rw FROM medians GROUP BY lang),
normal AS (
  SELECT lang, CASE WHEN list_sum(rc) > 0 THEN list_transform(rc, lambda x: x / list_sum(rc)) END AS rc,
         CASE WHEN list_sum(rw) > 0 THEN list_transform(rw, lambda x: x / list_sum(rw)) END AS rw FROM refs),
terms AS (
  SELECT s.*, r.rc, r.rw,
    list_sum(list_transform(range(1, 7), lambda i: CASE WHEN cp[i] > 0 THEN cp[i] * log2(2 * cp[i] / (cp[i] + rc[i])) ELSE 0 END
      + CASE WHEN rc[i] > 0 THEN rc[i] * log2(2 * rc[i] / (cp[i] + rc[i])) ELSE 0 END)) / 2 AS cj,
    list_sum(list_transform(range(1, len(wp) + 1), lambda i: CASE WHEN wp[i] > 0 THEN wp[i] * log2(2 * wp[i] / (wp[i] + rw[i])) ELSE 0 END
      + CASE WHEN rw[i] > 0 THEN rw[i] * log2(2 * rw[i] / (wp[i] + rw[i])) ELSE 0 END)) / 2 AS wj
  FROM shares s LEFT JOIN normal r ON s.lang IS NOT DISTINCT FROM r.lang),
judged AS (
  SELECT *, CASE WHEN rc IS NULL THEN 0 ELSE cj END AS char_js, CASE WHEN rw IS NULL OR n_words = 0 THEN 0 ELSE wj END AS word_js FROM terms)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (chars >= MIN_CHARS AND char_js > MAX_CHAR_JS OR n_words >= MIN_HIST_WORDS AND word_js > MAX_WORD_JS) AS kept,
       round(char_js, 6) AS char_js, round(word_js, 6) AS word_js
FROM judged
"""
for _name, _value in (("MIN_WORDS", quality.MIN_WORDS), ("MAX_REPEAT", quality.MAX_REPEAT_PERCENT), ("STEPS", quality.STEPS),
                      ("MIN_CHARS", quality.MIN_CHARS), ("MAX_CHAR_JS", quality.MAX_CHAR_JS),
                      ("MIN_HIST_WORDS", quality.MIN_HIST_WORDS), ("MAX_WORD_JS", quality.MAX_WORD_JS),
                      ("COMMON", ", ".join(f"'{w}'" for w in quality.COMMON_WORDS))):
    QUALITY = re.sub(rf"\b{_name}\b", str(_value), QUALITY)

ORACLE = {"op1_mixing": MIXING, "op9_quality_rules": QUALITY, "op2_sharding": SHARDING, "op3_ngram_jaccard": NEAR_JOIN, "op11_filter_audit": FILTER_AUDIT, "op12_fill_middle": FILL_MIDDLE,
          "op13_line_dedup": LINE_DEDUP}
