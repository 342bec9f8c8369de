"""SQL of the text queries that SQL can express, for an independent engine."""

from __future__ import annotations

from coordspark.llm import chat

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = """WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest"""

_words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4 = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id, {_words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p, w FROM b WHERE len(w) > 0), bs AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM bw),
dl AS (SELECT d.doc_id, d.w, l.n FROM d JOIN (SELECT DISTINCT n FROM bs) AS l ON len(d.w) >= l.n), dp AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dl),
h AS (SELECT dp.doc_id, dp.p, dp.n, bs.item_id FROM dp JOIN bs ON bs.n = dp.n AND bs.s = array_to_string(list_slice(dp.w, dp.p, dp.p + dp.n - 1), ' ')),
k AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h), c AS (SELECT doc_id, count(*) AS n_hit FROM k GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) AS s GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


def _op5() -> str:
    quoted = lambda s: "".join("\\" + c if c in "|[]/<>" else c for c in s).replace("'", "''")
    rest = "|".join(sorted((quoted(c[1:]) for c in chat.CONTROL), key=len, reverse=True))
    escaped = lambda c: f"regexp_replace({c}, '([<\\[])(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    marks = len(chat.TURN) + len(chat.BODY) + len(chat.STOP)
    ok = "'</s>[INST] ok [/INST]'"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {ok} UNION ALL SELECT -1, 1, 'assistant', {ok})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST({len(chat.BEGIN) + len(chat.END)} + sum({marks} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


OP5 = _op5()
_tokens = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_tokens} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""

OP13 = """WITH c AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, r.id AS r, a.label = r.label AS same, CAST(CASE WHEN len(a.v) > 0 THEN list_inner_product(a.v, r.v) ELSE 0 END AS BIGINT) AS s FROM c AS a JOIN c AS r ON a.id <> r.id AND len(a.v) = len(r.v) WHERE a.id % 100 = 0),
p AS (SELECT a, r AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= 5),
n AS (SELECT p.a, p.positive_id, p.positive_score, s.r AS negative_id, s.s AS negative_score, row_number() OVER (PARTITION BY p.a, p.positive_id ORDER BY s.s DESC, s.r) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.positive_score <= 100 * s.s AND s.s <= p.positive_score)
SELECT a AS anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5"""
OP11 = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50), s AS (SELECT doc_id, p, md5_number(array_to_string(list_slice(w, p, p + 49), ' ')) AS g FROM p),
f AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY 1), h AS (SELECT doc_id, p FROM s JOIN f ON f.g = s.g WHERE first_id < doc_id),
k AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM h), g AS (SELECT doc_id, list(q) AS gone FROM k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
OP12 = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
x AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM x GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM x, (SELECT unnest(range(1, 6)) AS k) AS r WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100), c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, size, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS lp, array_to_string(list_slice(w, k + 1, size), ' ') AS rp FROM c, (SELECT unnest(range(1, 5)) AS k) AS r WHERE k < size),
v AS (SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM u JOIN f AS l ON l.lang = u.lang AND l.phrase = u.lp JOIN f AS r ON r.lang = u.lang AND r.phrase = u.rp JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT s.lang, s.phrase FROM c AS s JOIN (SELECT lang, a, array_to_string(list_slice(w, p, p + m - 1), ' ') AS sub FROM c, (SELECT unnest(range(2, 5)) AS m) AS m, (SELECT unnest(range(1, 5)) AS p) AS p WHERE m < size AND p + m - 1 <= size) AS o
  ON o.lang = s.lang AND o.sub = s.phrase AND 100 * o.a >= 100 * s.a),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000"""
