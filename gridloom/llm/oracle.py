"""DuckDB SQL for the operators that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1), d AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""

_WORDS = r"regexp_extract_all({c}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH i AS (SELECT item_id, {_WORDS.format(c=_LOWER.format(c="text"))} AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(c=_LOWER.format(c="text"))} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
h AS MATERIALIZED (SELECT p.doc_id, p.k, t.size, t.item_id FROM p JOIN (SELECT DISTINCT size FROM t) s ON p.k + s.size - 1 <= len(p.w) JOIN t ON t.size = s.size AND t.win = array_to_string(p.w[p.k:p.k + s.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

# A digest is 40 hexadecimal digits; each base32 letter takes five bits out of two of them.
_NIBBLE = "(instr('0123456789abcdef', substr(h, {k}, 1)) - 1)"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_NIBBLE.format(k=5 * g // 4 + 1)} * 16 + {_NIBBLE.format(k=5 * g // 4 + 2)}) >> {3 - 5 * g % 4}) & 31)::INTEGER + 1, 1)" for g in range(32))
OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS owner, sha1(body) AS h FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM k
"""

# A window is its first word and the nineteen that follow, by lead(); null where the document ends before.
_WINDOW = "word || " + " || ".join(f"' ' || lead(word, {k}) OVER t" for k in range(1, 20))
OP10 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
p AS (SELECT doc_id, k, {_WINDOW} AS win FROM a WINDOW t AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS place FROM p WHERE win IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM r WHERE place > 1),
s AS (SELECT a.doc_id, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY a.k) FILTER (g.k IS NULL) AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.k = g.k GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

ORACLE_SQL = {"op1_embedding_groups": OP1, "op5_decontaminate": OP5, "op6_warc": OP6, "op10_substrings": OP10}
