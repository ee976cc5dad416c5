"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, i, max(i + 35) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
s AS (SELECT doc_id, unnest(range(greatest(i, coalesce(upto, 0)), i + 35)) AS p FROM e),
u AS (SELECT doc_id, w[i] AS v, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT u.doc_id, count(s.p) AS n_removed, coalesce(string_agg(CASE WHEN s.p IS NULL THEN u.v END, ' ' ORDER BY u.i), '') AS kept FROM u LEFT JOIN s ON u.doc_id = s.doc_id AND u.i = s.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def _cover(k: int) -> str:
    """Words and characters in windows of k words that their text has twice or more."""
    return f"""g{k} AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {k - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
r{k} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g{k}) WHERE n > 1),
e{k} AS (SELECT doc_id, i, max(i + {k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r{k}),
s{k} AS (SELECT doc_id, unnest(range(greatest(i, coalesce(upto, 0)), i + {k})) AS p FROM e{k}),
c{k} AS (SELECT s.doc_id, count(*) AS n, CAST(sum(length(d.w[s.p])) AS BIGINT) AS chars FROM s{k} s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id)"""


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, v, length(v) AS n, row_number() OVER (PARTITION BY doc_id, v) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS v FROM d) WHERE regexp_matches(v, '[^\x20\x09-\x0D]')),
y AS (SELECT doc_id, count(*) FILTER (k > 1) AS dups, CAST(sum(n) AS BIGINT) AS chars, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS dup_chars FROM l GROUP BY doc_id),
""" + ",\n".join(_cover(k) for k in (5, 7, 10)) + r""",
a AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(y.dups, 0) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words, coalesce(c5.chars, 0) AS x5, coalesce(c7.chars, 0) AS x7, coalesce(c10.chars, 0) AS x10, coalesce(y.dup_chars, 0) AS yd, coalesce(y.chars, 0) AS yc
  FROM d LEFT JOIN y ON d.doc_id = y.doc_id LEFT JOIN c5 ON d.doc_id = c5.doc_id LEFT JOIN c7 ON d.doc_id = c7.doc_id LEFT JOIN c10 ON d.doc_id = c10.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(x5 AS DOUBLE) / greatest(word_chars, 1) AS share_5, CAST(x7 AS DOUBLE) / greatest(word_chars, 1) AS share_7,
  CAST(x10 AS DOUBLE) / greatest(word_chars, 1) AS share_10, CAST(yd AS DOUBLE) / greatest(yc, 1) AS share_line_chars FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND share_line_chars <= 0.20 AND share_5 <= 0.30 AND share_7 <= 0.26 AND share_10 <= 0.20 AS kept, share_5, share_7, share_10, share_line_chars FROM b
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) >= 1)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
q AS (SELECT g.doc_id, g.h FROM g JOIN f ON g.h = f.h),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM q a JOIN q b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
k AS (SELECT x, y FROM p JOIN n s ON s.doc_id = x JOIN n t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
m AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT x AS v, x AS u FROM m UNION SELECT r.v, m.y FROM r JOIN m ON r.u = m.x),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.v
"""
