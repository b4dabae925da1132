"""SQL of the corpus queries that it can express, for DuckDB."""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]+"


#: CRC-32 of the decimal id: bytes one by one, eight halvings each. A list of the state after each halving keeps the expression short.
_CRC_STEPS = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({id}) + 1), lambda i: [1000 + ascii(substr({id}, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: CASE WHEN b >= 1000 THEN xor(c, b - 1000) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""


def crc32(id_: str) -> str:
    return f"xor({_CRC_STEPS.format(id=id_)}, 4294967295)"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP9 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, p, md5(substr(x, 2 * p - 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS p FROM h)),
f AS (SELECT doc_id, p FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM f)),
c AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS b FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS a, a - 1 AS b FROM c UNION ALL SELECT doc_id, max(b) + 1, NULL FROM c GROUP BY 1),
t AS (SELECT doc_id, string_agg(CASE WHEN k.b IS NULL THEN substr(x, 2 * k.a - 1) ELSE substr(x, 2 * k.a - 1, 2 * (k.b - k.a + 1)) END, '' ORDER BY k.a) AS kept FROM k JOIN h USING (doc_id) GROUP BY 1),
m AS (SELECT doc_id, sum(b - a + 1) AS n, count(*) AS spans FROM c GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(m.n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP11 = f"""WITH o AS (SELECT doc_id, {crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws FROM documents),
q AS (SELECT *, h // 10 AS g, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM o),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM q),
w AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM d),
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island),
c AS (SELECT * FROM s WHERE length >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND s.q < c.q AND s.start <= c.start AND s.start + s.length >= c.start + c.length)),
b AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q)) AS runs_sha256, first({{'s': start, 'l': length, 'q': q}} ORDER BY length DESC, start, q) AS best FROM r GROUP BY 1),
x AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)"""
