"""The operators' queries over whole tables, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op13_chat_format
from .decontamination import op10_benchmark_leaks
from .divergence import op12_source_divergence
from .hmm import op9_hidden_markov
from .language import op6_character_language
from .near_dup import op7_lsh_forest
from .packing import op1_curve_packing
from .repair import op11_conversation_repair
from .rules import op4_certified_rules
from .sharding import op3_matrix_shards
from .substrings import op8_prefix_suffixes
from .tokens import op5_token_counts
from .weak_labels import op2_weak_label_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_curve_packing,
        op2_weak_label_quality,
        op3_matrix_shards,
        op4_certified_rules,
        op5_token_counts,
        op6_character_language,
        op7_lsh_forest,
        op8_prefix_suffixes,
        op9_hidden_markov,
        op10_benchmark_leaks,
        op11_conversation_repair,
        op12_source_divergence,
        op13_chat_format,
    )
}
_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"

# Components by repeated smallest neighbours, over all pairs that share a shingle.
_NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS shingle FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id, component_id = s.doc_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id"""

_REPEATS = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
k AS (SELECT *, string_agg(word, ' ') OVER ahead AS words, count(*) OVER ahead AS n FROM t WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT *, n = 20 AND row_number() OVER (PARTITION BY words, n ORDER BY doc_id, i) > 1 AS later FROM k),
g AS (SELECT doc_id, word, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS stay FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(stay, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k ON k.lang = e.lang AND k.term = e.term GROUP BY e.lang, e.source, e.term),
s AS (SELECT lang, source, sum(n) AS own FROM n GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 2) // (coalesce(s.own, 0) + 2 * v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.total + 2) // (v.whole + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10"""

# The damaged rows in order; then, row after row, the cheapest edits to each of four places (start, system, user,
# assistant) as cost, initials and what they leave.
_REPAIR = r"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
bits AS (SELECT z.*, (CAST({crc} AS BIGINT)) % 20 AS x FROM z),
d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM bits),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS r, right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) AS last FROM d),
e AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
f AS (SELECT *, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS cut FROM e),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size FROM f GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {c: CAST(0 AS BIGINT), a: '', t: ''} AS k0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS k1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS k2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS k3 FROM s
  UNION ALL SELECT conv_id, i,
    CASE WHEN e0 IS NOT NULL THEN {c: e0.c + 4, a: e0.a || 'D', t: e0.t} END,
    list_min([CASE WHEN e1 IS NOT NULL THEN {c: e1.c + 4, a: e1.a || 'D', t: e1.t} END, CASE WHEN e0 IS NOT NULL AND stays AND r = 's' THEN {c: e0.c + extra, a: e0.a || 'K', t: e0.t || chr(10) || role || ':' || text} END]),
    list_min([CASE WHEN e2 IS NOT NULL THEN {c: e2.c + 4, a: e2.a || 'D', t: e2.t} END, CASE WHEN from_a IS NOT NULL AND stays THEN
      CASE WHEN r = 'u' THEN {c: from_a.c + extra, a: from_a.a || 'K', t: from_a.t || chr(10) || role || ':' || text} ELSE {c: from_a.c + 3 + extra, a: from_a.a || 'R', t: from_a.t || chr(10) || 'user:' || text} END END]),
    list_min([CASE WHEN e3 IS NOT NULL THEN {c: e3.c + 4, a: e3.a || 'D', t: e3.t} END, CASE WHEN e2 IS NOT NULL AND stays THEN
      CASE WHEN r = 'a' THEN {c: e2.c + extra, a: e2.a || 'K', t: e2.t || chr(10) || role || ':' || text} ELSE {c: e2.c + 3 + extra, a: e2.a || 'R', t: e2.t || chr(10) || 'assistant:' || text} END END])
  FROM (SELECT *, list_min([e0, e1, e3]) AS from_a FROM (SELECT *,
      list_min([k3, CASE WHEN e2 IS NOT NULL THEN {c: e2.c + 3, a: e2.a || 'I', t: e2.t || chr(10) || 'assistant:'} END]) AS e3 FROM (SELECT w.conv_id, f.i, f.role, f.text, f.r, NOT f.blank AND NOT f.again AS stays, CASE WHEN f.cut THEN 3 ELSE 0 END AS extra, k3, k0 AS e0, k1 AS e1,
        list_min([k2, CASE WHEN q IS NOT NULL THEN {c: q.c + 3, a: q.a || 'I', t: q.t || chr(10) || 'user:'} END]) AS e2 FROM (SELECT *, list_min([k0, k1, k3]) AS q FROM w) w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) x) y) v),
o AS (SELECT conv_id, list_min([k0, k3, CASE WHEN k2 IS NOT NULL THEN {c: k2.c + 3, a: k2.a || 'I', t: k2.t || chr(10) || 'assistant:'} END, CASE WHEN k1 IS NOT NULL THEN {c: k1.c + 6, a: k1.a || 'II', t: k1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END]) AS b
  FROM (SELECT w.* FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.size = w.i) l)
SELECT p.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) p LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id"""
# CRC-32 of a short text, bit by bit: eight times over each byte.
_REPAIR = _REPAIR.replace("{crc}", "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda h, b: list_reduce(list_prepend(xor(h, b), [CAST(j AS BIGINT) FOR j IN range(8)]), lambda g, j: CASE WHEN g & 1 = 1 THEN xor(g >> 1, 3988292384) ELSE g >> 1 END)), 4294967295)")

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, [length(replace(replace(replace(x, '\', '\\'), '<', '\<'), '>', '\>')) FOR x IN [role, text]] AS sizes FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(list_sum(sizes) + 16) AS BIGINT) AS formatted_chars,
  coalesce(min(i - 1) FILTER (NOT (concat(coalesce(before, ''), '>', role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))), CASE WHEN max_by(role, i) <> 'assistant' THEN count(*) END) AS fault
FROM e GROUP BY conv_id"""

ORACLES: dict[str, str] = {"op11_conversation_repair": _REPAIR, "op13_chat_format": _CHAT, "op12_source_divergence": _DIVERGENCE, "op7_lsh_forest": _NEAR_DUPLICATES, "op8_prefix_suffixes": _REPEATS}
