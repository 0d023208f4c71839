"""SQL that gives the rows of queries which SQL can express."""

from .quality import BOILERPLATE, LEAST_WORDS, MOST_LOST, MOST_REPEATED, STOPS, SYMBOLS

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n + b.n) AS n FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (n - shared) UNION ALL SELECT b, a FROM p WHERE 100 * shared >= 85 * (n - shared)),
r AS (SELECT doc_id, doc_id AS pos FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.pos)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(pos) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

_SOLID = f"length(translate(l, {_SPACES}, ''))"
_GAPS = "(length(l) - length(translate(l, ' ', '')))"
_DIVIDERS = "len(list_filter(string_split(l, ' '), lambda x: x IN ('|', '>', '»', '›', '•', '·')))"
_SHOUTS = "((length(l) - length(replace(l, '!!', ''))) / 2)"
_FAILS = (
    f"((length(l) - length(translate(l, '{SYMBOLS}', ''))) * 8 > {_SOLID} OR ({_DIVIDERS} >= 1 AND {_DIVIDERS} * 5 >= {_GAPS}) OR ({_SHOUTS} >= 2 AND {_SHOUTS} * 5 >= {_GAPS} + 1)"
    f" OR ({_SOLID} >= 60 AND length(translate(l, '{STOPS}', '')) = length(l)) OR (length(l) < 300 AND regexp_matches(lower(l), '{BOILERPLATE}')))"
)
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM x),
z AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM y WHERE n > 1) GROUP BY doc_id),
f AS (SELECT doc_id, list_filter(l, lambda q: length(translate(q, {_SPACES}, '')) > 0) AS f FROM d),
g AS (SELECT doc_id, sum(CASE WHEN {_FAILS} THEN 0 ELSE {_SOLID} END) AS left_ FROM (SELECT doc_id, unnest(l) AS l FROM d) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(translate(t, {_SPACES}, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, CAST(len(f) - len(list_distinct(f)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, left_ FROM d LEFT JOIN z USING (doc_id) JOIN f USING (doc_id) JOIN g USING (doc_id)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - CAST(left_ AS DOUBLE) / word_chars ELSE 0.0 END AS lost_share FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_share <= {MOST_LOST} AS kept, CAST(lost_share AS DOUBLE) AS lost_share FROM v
"""

ORACLES = {"op1_ngram_jaccard_join": JACCARD, "op10_quality_rules": QUALITY}
