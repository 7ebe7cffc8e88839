"""The operators' queries in DuckDB SQL, over whole tables, where SQL can express them."""

from __future__ import annotations

from .common import LOWER, UPPER
from .line_dedup import MIN_CHARS, MIN_DOCS
from .mixing import MAX_EPOCHS, PASSES, SEED, WEIGHTS
from .quality_rules import ALPHA, DELTA, MAX_REPEATED, MIN_WORDS, RULES, SYMBOLS

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"

TOKEN_ROLLUP = f"""
WITH d AS (
  SELECT source, lang, translate(coalesce(text, ''), '{SYMBOLS}', '') AS t FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '{WORD}')) AS n FROM d
  UNION ALL SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '{PIECE}')) FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang, tokenizer
"""


def mix_sources() -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    parts = [f"""
WITH s AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
g AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY src),
w AS (SELECT src, source_size, CASE (row_number() OVER (ORDER BY src) - 1) % {len(WEIGHTS)} {weight} END AS weight, source_size * {MAX_EPOCHS} AS cap FROM g),
o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
         sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
level AS (SELECT remain, share FROM o WHERE weight * remain < cap * share ORDER BY cap / weight, src LIMIT 1),
t AS (SELECT src, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE
        least(CAST(weight AS DOUBLE) * CAST(remain AS DOUBLE) / CAST(share AS DOUBLE), CAST(cap AS DOUBLE)) END AS target
      FROM w LEFT JOIN level ON true),
x AS (SELECT src, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r0 AS (SELECT *, target - whole * source_size AS rest FROM x), s0 AS (SELECT *, false AS got FROM s)"""]
    for i in range(PASSES):
        fits = "true" if i == 0 else "s.size <= r.rest"
        parts.append(f"""
f{i} AS (SELECT s.src, s.key, s.doc_id, s.size, r.rest, sum(s.size) OVER (PARTITION BY s.src ORDER BY s.key, s.doc_id NULLS FIRST, s.size) AS upto
        FROM s{i} s JOIN r{i} r USING (src) WHERE r.rest > 0 AND NOT s.got AND {fits}),
h{i} AS (SELECT DISTINCT src, key, doc_id, size FROM f{i} WHERE upto <= rest),
r{i + 1} AS (SELECT r.* EXCLUDE (rest), r.rest - coalesce(m.got, 0) AS rest
        FROM r{i} r LEFT JOIN (SELECT src, max(upto) AS got FROM f{i} WHERE upto <= rest GROUP BY src) m USING (src)),
s{i + 1} AS (SELECT s.doc_id, s.src, s.size, s.key, s.got OR h.src IS NOT NULL AS got
        FROM s{i} s LEFT JOIN h{i} h ON s.src = h.src AND s.key = h.key AND s.doc_id IS NOT DISTINCT FROM h.doc_id AND s.size = h.size)""")
    parts.append(f"""
c AS (SELECT s.src, s.key, s.doc_id, s.size, row_number() OVER (PARTITION BY s.src ORDER BY abs(s.size - r.rest), s.key, s.doc_id NULLS FIRST, s.size) AS place
      FROM s{PASSES} s JOIN r{PASSES} r USING (src) WHERE NOT s.got AND r.rest > 0 AND abs(s.size - r.rest) < r.rest)""")
    return ",".join(parts) + f"""
SELECT s.doc_id, s.size, x.source_size, x.target,
       CAST(s.size * (x.whole + CASE WHEN s.got OR c.src IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s{PASSES} s JOIN x USING (src)
LEFT JOIN c ON c.place = 1 AND s.src = c.src AND s.key = c.key AND s.doc_id IS NOT DISTINCT FROM c.doc_id AND s.size = c.size
"""


#: for pages as the tables have them: one article element, block elements p, br and h1 inside
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, unnest(range(len(bs))) AS i, unnest(bs) AS block
      FROM (SELECT page_id, url, string_split_regex(body, '</?(?:p|br|h1|ul|li|div)(?:\s[^>]*)?>') AS bs FROM a)),
c AS (SELECT page_id, url, i, trim(regexp_replace(
        regexp_replace(replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'),
        '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS block FROM b),
d AS (SELECT page_id, url, coalesce(string_agg(block, ' ' ORDER BY i) FILTER (WHERE block <> ''), '') AS text FROM c GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


#: a rule's part of the good documents that may be lost
SHARE = ALPHA / len(RULES)


def quality_rules() -> str:
    trials = " UNION ALL ".join(
        f"SELECT stratum, good, '{r}' AS rule, {i} AS step, {c} AS cutoff, {num} * 1000 > {den} * {c} AS rejected FROM labelled"
        for r, (num, den, cutoffs) in RULES.items() for i, c in enumerate(cutoffs))
    rejected = " OR ".join(f"coalesce({num} * 1000 > {den} * cut_{r}, false)" for r, (num, den, _) in RULES.items())
    cuts = ", ".join(f"max(cutoff) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '{WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {WHITE}) <> '') AS ls FROM d),
grams AS (SELECT doc_id, i, list_aggregate(ws[i:i + 2], 'string_agg', ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
f AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {WHITE}, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_text_lines FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM f),
agreed AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
labelled AS (SELECT j.*, q = 1 AS good FROM j JOIN agreed USING (doc_id) WHERE NOT base_failed),
trials AS ({trials}),
counts AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND rejected) AS k,
                  count(*) FILTER (WHERE NOT good AND rejected) AS caught FROM trials GROUP BY ALL),
tested AS (SELECT *, NOT (CASE WHEN k > n * {SHARE} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
             exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({SHARE}) + (n - i) * ln(1 - {SHARE})))) END
             <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM labelled) * {len(RULES)})) AS failed FROM counts),
certified AS (SELECT * FROM (SELECT *, bool_or(failed) OVER (PARTITION BY stratum, rule ORDER BY step) AS stopped FROM tested) WHERE NOT stopped AND caught > k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - k DESC, step) AS place FROM certified) WHERE place = 1),
chosen AS (SELECT stratum, {cuts} FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {rejected}) AS kept
FROM j LEFT JOIN chosen USING (stratum)
"""


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, {WHITE}), '{UPPER}', '{LOWER}') AS key FROM n),
hot AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT doc_id, i, line, hot.key IS NOT NULL AS dropped FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: crc32 runs over the bits of the digits: a digit is mixed in, then eight steps follow; paths are lists of turns
PREFIX_TRIE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, (4294967295 - list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
          string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, ts[1:d] AS path, d AS depth, len(ts) = d AS whole, CASE WHEN d = 0 THEN 0 ELSE strlen(ts[d].text) END AS size
      FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (SELECT path, depth, size, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256 FROM p GROUP BY path, depth, size),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, depth)),
u AS (SELECT path[1:a] AS path, a AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends_sha256
FROM m JOIN u USING (path, depth) LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.path = m.path[1:m.depth - 1]
"""
