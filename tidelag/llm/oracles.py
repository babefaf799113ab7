"""DuckDB SQL of the operators that SQL can express, in fair time at the scale where both are compared."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = UPPER + "234567"


def base32(hexadecimal: str) -> str:
    """Base32 of a SHA-1 in hexadecimal digits: five digits are four letters."""
    part = f"CAST('0x' || substr({hexadecimal}, 5 * i + 1, 5) AS BIGINT)"
    letters = " || ".join(f"substr('{BASE32}', CAST(({part} >> {k}) & 31 AS INTEGER) + 1, 1)" for k in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda i: {letters}), '')"


WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {base32('p.h')} AS payload_digest,
  CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) >= 5 THEN array_to_string(words[i:i + 4], ' ') ELSE '5 ' || array_to_string(words, ' ') END AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * c.c >= 85 * (na.n + nb.n - c.c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT k.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id
"""

def covered(span: int) -> str:
    """Tables k, t, c, g and s of a span: windows, repeated ones, and the runs a to b that these cover."""
    return f"""
k{span} AS (SELECT doc_id, p, md5(e[p + 1:p + {span}]) AS m FROM (SELECT doc_id, e, unnest(generate_series(0, n - {span})) AS p FROM d WHERE n >= {span})),
t{span} AS (SELECT m FROM k{span} GROUP BY m HAVING count(*) > 1),
c{span} AS (SELECT k.doc_id, k.p, CASE WHEN k.p > lag(k.p) OVER (PARTITION BY k.doc_id ORDER BY k.p) + {span} THEN 1 ELSE 0 END AS fresh FROM k{span} k JOIN t{span} t ON k.m = t.m),
g{span} AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c{span}),
s{span} AS (SELECT doc_id, min(p) AS a, max(p) + {span} AS b FROM g{span} GROUP BY doc_id, run)"""


_BLANK = "IN ('20', '09', '0A', '0B', '0C', '0D')"

SUFFIX = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{covered(400)},
{covered(200)},
x AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS u FROM s400 UNION ALL SELECT s.doc_id, max(s.b) AS f, max(d.n) AS u FROM s400 s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id),
y AS (SELECT x.doc_id, string_agg(substr(d.h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (u - f) AS BIGINT)), '' ORDER BY f) AS left_over FROM x JOIN d ON d.doc_id = x.doc_id GROUP BY x.doc_id),
z AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s400 GROUP BY doc_id),
r AS (SELECT s.doc_id, regexp_extract_all(CASE WHEN a = 0 THEN '20' ELSE substr(d.h, CAST(2 * a - 1 AS BIGINT), 2) END || substr(d.h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '..') AS bytes FROM s200 s JOIN d ON d.doc_id = s.doc_id),
q AS (SELECT doc_id, len(list_filter(range(2, len(bytes) + 1), lambda p: bytes[p] NOT {_BLANK} AND bytes[p - 1] {_BLANK})) AS words FROM r),
v AS (SELECT doc_id, max(words) >= 50 AS flagged FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(z.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(z.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(y.left_over, d.h))) AS kept_sha256, coalesce(v.flagged, false) AS flagged
FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id
"""

#: Sizes and targets of op1: sources in code-point order, null last, weigh 5, 2, 1 in turn; the level of targets by weight is found
#: where sources that stop at three times their size are those with the smallest ratio of that to their weight.
MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS words, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i FROM d GROUP BY source),
w AS (SELECT source, words, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * words AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS k FROM w),
l AS (SELECT *, ((SELECT sum(words) FROM w) - (sum(cap) OVER (ORDER BY k) - cap)) / ((SELECT sum(weight) FROM w) - (sum(weight) OVER (ORDER BY k) - weight)) AS level FROM o),
f AS (SELECT min_by(level, k) AS level FROM l WHERE level <= cap / weight)
SELECT d.doc_id, d.size, CAST(w.words AS BIGINT) AS source_size, round(CAST(least(w.cap, coalesce((SELECT level FROM f) * w.weight, w.cap)) AS DOUBLE), 3) AS target
FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source
"""

PAYLOADS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, greatest(1, (n + 63) // 64) * 64 AS m, h FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(unhex(h || repeat('00', CAST(m - n AS INTEGER)))) AS payload_sha256 FROM p
"""

COUNTS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM d),
t AS (SELECT r, i, words[i:i + 2] AS t FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) > 2)),
g AS (SELECT r, t FROM t GROUP BY r, t HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT t.r, unnest([t.i, t.i + 1, t.i + 2]) AS j FROM t JOIN g ON t.r = g.r AND t.t = g.t) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY r),
a AS (SELECT d.r, d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d JOIN w ON w.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed
FROM a LEFT JOIN u ON u.r = a.r LEFT JOIN c ON c.r = a.r
"""
