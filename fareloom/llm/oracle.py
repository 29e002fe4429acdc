"""The same results as DuckDB SQL, where SQL can express them."""
from __future__ import annotations

from fareloom.llm import licenses

_OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

_OP5 = r"""
WITH l AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
r AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, coalesce(doc_id <> keeper, false) AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY 1
"""

_OP4 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (h)
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


def _op9() -> str:
    rows = ", ".join("('{}', '{}')".format(*(v.replace("'", "''") for v in t)) for t in licenses.TEMPLATES)
    return f"""
WITH t AS (SELECT name, {_WORDS} AS w FROM (VALUES {rows}) AS v(name, text)),
ts AS (SELECT DISTINCT name, CAST(power(2, ceil(log2(len(w) - 4))) AS BIGINT) AS m, array_to_string(w[k:k + 4], ' ') AS s
       FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS k FROM t)),
tn AS (SELECT name, m, count(*) AS n FROM ts GROUP BY 1, 2),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT doc_id, k - 1 AS p, array_to_string(w[k:k + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
hits AS (SELECT doc_id, name, m, s, unnest([p // m, p // m - 1]) AS win FROM ds JOIN ts USING (s)),
held AS (SELECT doc_id, name, count(DISTINCT s) / n AS contained FROM hits JOIN tn USING (name, m) WHERE win >= 0
         GROUP BY doc_id, name, win, n HAVING count(DISTINCT s) / n >= 0.8),
best AS (SELECT doc_id, name, max(contained) AS contained FROM held GROUP BY 1, 2)
SELECT doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses,
       coalesce(max(contained), 0) AS contained
FROM documents LEFT JOIN best USING (doc_id) GROUP BY 1
"""


_HOST = r"""lower(regexp_replace(regexp_replace(regexp_extract(coalesce({0}, ''),
  '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), ':[0-9]*$', ''), '\.$', ''))"""
_ADDRESS = _HOST + r""" || regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '#.*$', ''),
  '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''), '/$', '')"""
_OP3 = rf"""
WITH c AS (SELECT page_id, url, {_HOST.format('url')} AS host, {_ADDRESS.format('url')} AS address,
             to_timestamp(1704067200 + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 31622400) AS t
           FROM pages),
seen AS (SELECT DISTINCT kind, pattern FROM (
           SELECT 'domain' AS kind, regexp_replace(host, '^(www|m|blog)\.', '') AS pattern FROM c
           UNION ALL SELECT 'host', host FROM c UNION ALL SELECT 'url', url FROM c) WHERE pattern <> ''),
h AS (SELECT kind, pattern, md5(kind || '|' || pattern || '|' || k) AS d FROM seen, range(3) AS r(k)),
e AS (SELECT 'list' || CAST('0x' || substr(d, 1, 2) AS BIGINT) % 3 AS list,
        CASE kind WHEN 'domain' THEN 'd:' || pattern WHEN 'host' THEN 'h:' || pattern
          ELSE 'u:' || {_ADDRESS.format('pattern')} END AS key,
        CAST('0x' || substr(d, 3, 2) AS BIGINT) % 2 = 1 AS removed,
        to_timestamp(1704067200 + CAST('0x' || substr(d, 5, 4) AS BIGINT) % 366 * 86400) AS dated FROM h),
g AS (SELECT list, key, dated, bool_or(removed) AS removed FROM e GROUP BY 1, 2, 3),
i AS (SELECT *, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS until FROM g),
k AS (SELECT page_id, t, 'u:' || address AS key FROM c WHERE host <> ''
      UNION ALL SELECT page_id, t, 'h:' || host FROM c WHERE host <> ''
      UNION ALL SELECT page_id, t, 'd:' || array_to_string((string_split(host, '.'))[n:], '.')
      FROM (SELECT page_id, t, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM c WHERE host <> '')),
m AS (SELECT page_id, list FROM k JOIN i USING (key) WHERE NOT removed AND dated <= t AND (until IS NULL OR t < until)),
a AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY 1)
SELECT page_id, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists, n IS NOT NULL AS listed
FROM pages LEFT JOIN a USING (page_id)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
v AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS m FROM v GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM v JOIN f USING (s) WHERE m < doc_id),
l AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT l.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed,
        string_agg(word, ' ' ORDER BY l.p) FILTER (g.p IS NULL) AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _levels(name: str, key: str, deep: int) -> str:
    """CTEs {name}1 .. {name}deep from {name}0 (key, i, n nodes, node): the levels of one tree per key. A level of one
    node ends the tree."""
    return ",\n".join(f"""{name}{k} AS (SELECT {key}, i // 8 AS i, (n + 7) // 8 AS n,
       CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node
       FROM {name}{k - 1} GROUP BY {key}, i // 8, n)""" for k in range(1, deep + 1))


def _climb(name: str, key: str, start: str, deep: int) -> str:
    """CTEs {start}1 .. {start}deep from {start}0 (doc_id, key, i, sides, folded): siblings gathered, digests folded."""
    return ",\n".join(f"""{start}{k + 1} AS (SELECT a.doc_id, a.{key}, a.i // 8 AS i,
       a.sides || coalesce(b.l, '') || coalesce(b.r, '') AS sides,
       CASE WHEN b.n = 1 THEN folded ELSE sha256(coalesce(b.l, '') || folded || coalesce(b.r, '')) END AS folded
       FROM {start}{k} a JOIN (SELECT {key}, i, n,
         string_agg(node, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
         string_agg(node, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
         FROM {name}{k}) b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.i = b.i)""" for k in range(deep))


def _op12(deep: int = 8, wide: int = 4) -> str:
    """For up to 8 ** deep rows per language and 8 ** wide languages."""
    leaf = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "{0}")))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, lang, sha256({leaf.format('text')}) AS node,
             CASE WHEN {_CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({leaf.format(lower)}) END AS other FROM documents),
t0 AS (SELECT doc_id, lang, node, coalesce(other, node) AS found,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_levels('t', 'lang', deep)},
s0 AS (SELECT 0 AS top, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{deep}),
{_levels('s', 'top', wide)},
c0 AS (SELECT doc_id, lang, i, '' AS sides, found AS folded FROM t0),
{_climb('t', 'lang', 'c', deep)},
e0 AS (SELECT c.doc_id, 0 AS top, s.i, c.sides, c.folded FROM c{deep} c JOIN s0 s ON c.lang IS NOT DISTINCT FROM s.lang),
{_climb('s', 'top', 'e', wide)}
SELECT doc_id, t0.node AS leaf, t{deep}.node AS subroot, s{wide}.node AS root, sha256(sides) AS proof_sha256,
       folded AS folded_root, folded = s{wide}.node AS verified
FROM e{wide} JOIN t0 USING (doc_id) JOIN t{deep} ON t0.lang IS NOT DISTINCT FROM t{deep}.lang CROSS JOIN s{wide}
"""


def _op13(rounds: int = 10, dims: int = 64, k: int = 8) -> str:
    """Vectors and centroids as one row per component. The last round only assigns."""
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, unnest(embedding) AS x, unnest(range({dims})) AS d FROM embeddings
       WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
p AS MATERIALIZED (SELECT vec_id, d, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM v),
m AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM p)),
c0 AS MATERIALIZED (SELECT c, d, x FROM p JOIN m USING (vec_id) WHERE c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, min_by(c, (s, c)) AS c, min(s) AS s FROM (
       SELECT vec_id, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS s FROM p JOIN c{r} q USING (d) GROUP BY 1, 2) GROUP BY 1)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (SELECT q.c, q.d, coalesce(y, q.x) AS x FROM c{r} q LEFT JOIN (
       SELECT c, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y
       FROM p JOIN a{r} USING (vec_id) GROUP BY 1, 2) z USING (c, d))""")
    return f"""WITH {",".join(parts)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)
"""


ORACLE = {"op3_url_lists": _OP3, "op9_licenses": _op9(), "op4_warc": _OP4, "op5_line_dedup": _OP5, "op7_decontamination": _OP7,
          "op11_substring_dedup": _OP11, "op12_merkle": _op12(), "op13_centroids": _op13()}
