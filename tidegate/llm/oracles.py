"""SQL (DuckDB) that states the results of registered queries."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ASCII text: eight shifts a byte, then all bits turned."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda c, b: {step}), 4294967295::UBIGINT)"


_FORTY = "('0x' || substr(sha1(coalesce(html, '')), 1 + CAST(i // 8 AS BIGINT) * 10, 10))::UBIGINT"
_DIGEST = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({_FORTY} >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '')"
_URL = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)'"

CAPTURES = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_DIGEST} AS payload_digest,
         regexp_extract(coalesce(url, ''), {_URL}, 1) AS host, regexp_extract(coalesce(url, ''), {_URL}, 2) AS port,
         regexp_extract(coalesce(url, ''), {_URL}, 3) AS rest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id,
             array_to_string(list_reverse(string_split(lower(host), '.')), ',') || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END
               || ')' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS url_key
      FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url_key,
       row_number() OVER (PARTITION BY url_key ORDER BY page_id % 31536000, page_id) AS capture_no
FROM f"""

ORACLES = {"op11_captures": CAPTURES}


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', chars, 'text'))})"


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered
  FROM documents),
e AS (SELECT *, coalesce('v' || lang, 'n') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
             count(*) OVER (PARTITION BY lang) AS size, row_number() OVER () AS id FROM d),
nodes AS (
  SELECT tree, 0 AS level, place AS idx, leaf AS h, size FROM e
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (size + 1) // 2 FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 2, size),
tops AS (SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
upper_nodes AS (
  SELECT 0 AS level, place AS idx, h, size FROM tops
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (size + 1) // 2 FROM upper_nodes WHERE size > 1 GROUP BY level, idx // 2, size),
top AS (SELECT level AS height, h FROM upper_nodes WHERE size = 1),
steps AS (
  SELECT e.id, l.level, (e.place >> l.level) % 2 AS side, s.h
  FROM e JOIN tops t USING (tree) JOIN (SELECT CAST(range AS BIGINT) AS level FROM range(64)) l ON l.level < t.height
  LEFT JOIN nodes s ON s.tree = e.tree AND s.level = l.level AND s.idx = xor(e.place >> l.level, 1)
  UNION ALL
  SELECT e.id, t.height + l.level, (t.place >> l.level) % 2, s.h
  FROM e JOIN tops t USING (tree) CROSS JOIN top JOIN (SELECT CAST(range AS BIGINT) AS level FROM range(64)) l ON l.level < top.height
  LEFT JOIN upper_nodes s ON s.level = l.level AND s.idx = xor(t.place >> l.level, 1)),
proofs AS (SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256, count(*) AS n FROM steps GROUP BY id),
folds AS (
  SELECT id, 0 AS level, coalesce(tampered, leaf) AS h FROM e
  UNION ALL
  SELECT f.id, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM folds f JOIN steps s ON s.id = f.id AND s.level = f.level),
folded AS (SELECT id, arg_max(h, level) AS h FROM folds GROUP BY id)
SELECT e.doc_id, e.leaf, t.h AS subroot, top.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, g.h AS folded_root, g.h = top.h AS verified
FROM e JOIN tops t USING (tree) CROSS JOIN top LEFT JOIN proofs p USING (id) JOIN folded g USING (id)"""

ORACLES["op13_manifest"] = MANIFEST

PREFIXES = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS key FROM t),
o AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS ids, {crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM k GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.ids[1:CAST(o.h AS BIGINT)], []), o.ids[CAST(o.h AS BIGINT) + 1:]) AS ids
      FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
c AS (SELECT key, any_value(length(text)) AS chars FROM k GROUP BY key),
m AS (SELECT conv_id, ids, unnest(range(len(ids) + 1)) AS depth FROM r),
p AS (SELECT conv_id, depth, ids[1:depth] AS prefix, ids[1:depth - 1] AS up, len(ids) = depth AS ends FROM m),
n AS (SELECT prefix, any_value(up) AS up, depth, min(conv_id) AS low, count(*) AS n,
             sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM p GROUP BY prefix, depth),
w AS (SELECT n.*, coalesce((n.n - 1) * c.chars, 0) AS own FROM n LEFT JOIN c ON n.depth > 0 AND c.key = n.prefix[n.depth]),
kids AS (SELECT up, count(*) AS kids FROM w WHERE depth > 0 GROUP BY up),
x AS (SELECT w.*, coalesce(kids.kids, 0) AS kids FROM w LEFT JOIN kids ON kids.up = w.prefix),
a AS (SELECT prefix, own, kids, unnest(range(depth + 1)) AS d FROM x),
s AS (SELECT prefix[1:d] AS anc, sum(own) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM a GROUP BY 1)
SELECT x.low AS conv_id, x.depth, q.low AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.anc = x.prefix LEFT JOIN n q ON x.depth > 0 AND q.prefix = x.up"""

ORACLES["op12_prefixes"] = PREFIXES
