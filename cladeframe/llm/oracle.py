"""DuckDB SQL with the results of the text queries.

Ids are taken to be unique, as they are in the tables. The learned parts of quality rules and language
identification, the tokenizers, CRC-32 and compact windows are beyond SQL; those queries are tested
against brute force, the library itself, or held-out accuracy instead.
"""

from __future__ import annotations

import string

from .license_scan import NOTICES, PHRASES

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
_TEMPLATES = ", ".join(f"({i}, '{t.label}', '{t.text}', {t.is_phrase and t.slack == 0}, {t.coverage}::DOUBLE, {t.slack})" for i, t in enumerate(PHRASES + NOTICES))

_OP1 = f"""
WITH t(template, label, text, phrase, coverage, slack) AS (VALUES {_TEMPLATES}),
tw AS (SELECT * EXCLUDE (text), {_ALNUM} AS w FROM t),
tg AS (SELECT template, label, phrase, coverage, slack, len(w) - 1 AS n_grams, i - 1 AS at_, w[i] AS a, w[i + 1] AS b FROM tw, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i)),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS p, w[i] AS a, w[i + 1] AS b FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i)),
v AS (SELECT DISTINCT doc_id, template, label, phrase, coverage, slack, n_grams, p - at_ AS diagonal, at_ FROM g JOIN tg USING (a, b)),
x AS (SELECT a.doc_id, a.template, a.label, a.phrase, a.coverage, a.n_grams, a.diagonal, b.at_, min(b.diagonal + b.at_) AS p FROM (SELECT DISTINCT * EXCLUDE (at_) FROM v) a JOIN v b ON b.doc_id = a.doc_id AND b.template = a.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + a.slack GROUP BY ALL),
y AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id, template, diagonal ORDER BY at_), p - 1) AS after FROM x),
s AS (SELECT doc_id, template, label, phrase, coverage, diagonal AS start, count(*) FILTER (after) / n_grams AS share FROM y GROUP BY doc_id, template, label, phrase, coverage, n_grams, diagonal),
h AS (SELECT * FROM s WHERE share >= coverage)
SELECT doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (phrase) AS n_base, (min(start) FILTER (phrase))::BIGINT AS first_word, (max(start) FILTER (phrase))::BIGINT AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN h USING (doc_id) GROUP BY doc_id"""

_OP3 = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM d, ks, LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
hit AS (SELECT doc_id, item_id, k, i FROM dw JOIN bw USING (k, win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, z.v FROM r JOIN (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) z ON r.b = z.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id"""

_OP9 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 12))::BIGINT % 1000003 AS h FROM l),
m AS (SELECT *, CASE WHEN i = 1 OR (lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 3 = 0 THEN 1 ELSE 0 END AS s FROM h),
c AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS at_ FROM m),
k AS (SELECT doc_id, at_, string_agg(s || line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, at_ HAVING count(*) > 1 AND bool_or(regexp_matches(line, '[^\x20\x09-\x0D]'))),
gone AS (SELECT doc_id, at_ FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, at_) AS r FROM k) WHERE r > 1),
t AS (SELECT c.doc_id, count(*) AS n_lines, count(gone.at_) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.at_ IS NULL), '') AS text FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND gone.at_ = c.at_ GROUP BY c.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, t.text FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id"""

SQL = {"op1_license_scan": _OP1, "op3_benchmark_decontamination": _OP3, "op7_jaccard_join": _OP7, "op9_line_dedup": _OP9}
