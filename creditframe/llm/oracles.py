"""DuckDB twins of the operators that SQL can express on whole tables."""

from __future__ import annotations

from .line_templates import MIN_CONSTANT, MIN_DOCS, SIMILAR
from .quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

#: ratio of the threshold table -> SQL over the counts
_RATIOS = {
    "n_words": "n_words", "mean_word_length": "coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0)",
    "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0)",
    "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0)",
    "bullet_line_ratio": "coalesce(n_bullets / nullif(n_lines, 0)::DOUBLE, 0)",
    "ellipsis_line_ratio": "coalesce(n_dots / nullif(n_lines, 0)::DOUBLE, 0)",
    "alpha_word_ratio": "coalesce(n_alpha / nullif(n_words, 0)::DOUBLE, 0)",
    "stop_word_ratio": "coalesce(n_stops / nullif(n_words, 0)::DOUBLE, 0)",
}


def _broken(rule) -> str:
    r = _RATIOS[rule.metric]
    sides = [f"{r} < {rule.low}"] if rule.low is not None else []
    sides += [f"{r} > {rule.high}"] if rule.high is not None else []
    spoken = f" AND lang IN ({', '.join(repr(x) for x in rule.langs)})" if rule.langs else ""
    return f"CASE WHEN n_words >= {rule.least_words} AND ({' OR '.join(sides)}){spoken} THEN '{rule.name}' END"


QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{_WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(following - i, 5))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM f) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stops,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha,
             len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-•*]'))) AS n_bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_dots
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             concat_ws(',', {', '.join(_broken(r) for r in RULES)}) AS broken FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken FROM j
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_FOLD}, '{_ITEM_WORD}') AS w
           FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, w[i:i + 12] AS g
      FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ITEM_WORD}') AS w FROM documents),
m AS (SELECT DISTINCT len(g) AS m FROM p),
s AS (SELECT doc_id, i, m, w[i:i + m - 1] AS g
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT s.doc_id, s.i, s.m, p.item FROM s JOIN p ON s.g = p.g),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

LINE_TEMPLATES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, t, regexp_extract_all(t, '{_WORD}') AS w FROM l),
s AS (SELECT *, len(w)::VARCHAR || chr(1) || array_to_string(list_transform(w[1:2],
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), chr(1)) AS leaf FROM w WHERE len(w) > 0),
b AS (SELECT leaf FROM s GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
c AS (SELECT s.* FROM s JOIN b ON s.leaf = b.leaf),
k AS (SELECT doc_id, line, leaf, unnest(w) AS token, unnest(range(len(w))) AS place FROM c),
f AS (SELECT leaf, place, token FROM k WHERE NOT regexp_matches(token, '[0-9]')
      GROUP BY leaf, place, token HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
x AS (SELECT k.doc_id, k.line, sum(CASE WHEN f.token IS NULL AND NOT regexp_matches(k.token, '[0-9]') THEN 0 ELSE 1 END) / count(*)::DOUBLE AS share,
             count(f.token) AS fixed,
             string_agg(k.token, ' ' ORDER BY k.place) AS whole,
             string_agg(coalesce(f.token, '<*>'), ' ' ORDER BY k.place) AS general
      FROM k LEFT JOIN f ON k.leaf = f.leaf AND k.place = f.place AND k.token = f.token GROUP BY k.doc_id, k.line),
t AS (SELECT doc_id, line, CASE WHEN share >= {SIMILAR} AND fixed >= {MIN_CONSTANT} THEN general ELSE whole END AS template FROM x),
r AS (SELECT template FROM t GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
g AS (SELECT t.doc_id, t.line FROM t JOIN r ON t.template = r.template),
o AS (SELECT l.doc_id, count(g.line) AS n_dropped, coalesce(string_agg(l.t, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept,
             count(*) FILTER (WHERE regexp_matches(l.t, '{_WORD}')) AS n_lines
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""

#: CRC-32 of the characters of a decimal number, bit by bit
_CRC = ("xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), "
        "lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
        "ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")

PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, base, h, least(h, count(t.pos)) AS taken FROM c LEFT JOIN t ON t.conv_id = c.base GROUP BY c.conv_id, base, h),
r AS (SELECT b.conv_id, t.pos, role, text FROM b JOIN t ON t.conv_id = base WHERE t.pos < taken
      UNION ALL SELECT b.conv_id, t.pos - h + taken, role, text FROM b JOIN t ON t.conv_id = b.conv_id WHERE t.pos >= h),
q AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS seq, list(length(text) ORDER BY pos) AS sizes
      FROM r GROUP BY conv_id),
s AS (SELECT b.conv_id, coalesce(seq, []) AS seq, coalesce(sizes, []) AS sizes FROM b LEFT JOIN q ON b.conv_id = q.conv_id),
p AS (SELECT conv_id, d, seq[1:d] AS node, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(seq) AS ended
      FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM p GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node),
u AS (SELECT node[1:i] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
      FROM (SELECT *, unnest(range(d + 1)) AS i FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN u ON m.node = u.node LEFT JOIN n a ON m.d > 0 AND a.node = m.node[1:m.d - 1] AND a.d = m.d - 1
"""
