"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from lakeloom.llm.line_clean import BOILERPLATE
from lakeloom.llm.url_filter import BINS, DOUBT, ORDER, RULES

_WS = r"[\x20\x09-\x0D]+"
_BOILER = " OR ".join("contains(lower(l), '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)

_FITS = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in RULES)
# a text as hexadecimal bytes between marks: a gram of order k is k + 1 of them
_OWN = ", ".join(f"max(CASE WHEN k = {k} THEN {n}{m} END) AS {n}{m}{k}" for k in range(ORDER + 1) for n in ("own", "all") for m in "br")


def _p(m: str) -> str:
    p = "CAST(1 AS DOUBLE) / 256"
    for k in range(ORDER + 1):
        w = f"(all{m}{k} / (all{m}{k} + {DOUBT}))"
        p = f"({w} * own{m}{k} / greatest(all{m}{k}, 1) + (1 - {w}) * {p})"
    return p


OP2 = rf"""
WITH a AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT DISTINCT ON (host, path) host, path, rh || rp AS rule, rv FROM a JOIN ({_FITS}) r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY host, path, length(rh || rp) DESC),
u AS (SELECT page_id, a.host, a.path, rule, rv, a.host || a.path AS text, rv IS NOT NULL AND CAST('0x' || md5(a.host || a.path)[1:7] AS INTEGER) % 5 = 0 AS aside FROM a LEFT JOIN f ON f.host = a.host AND f.path = a.path),
c AS (SELECT text, CAST(count(*) FILTER (rv = 'block') AS DOUBLE) AS b, CAST(count(*) FILTER (rv = 'allow') AS DOUBLE) AS r FROM u WHERE rv IS NOT NULL AND NOT aside GROUP BY 1),
s AS (SELECT text, repeat('^^', {ORDER}) || hex(replace(text, chr(0), ' ')) || '$$' AS marked FROM (SELECT DISTINCT text FROM u)),
g AS (SELECT text, i, k, substring(marked, 2 * (i + {ORDER} - k) + 1, 2 * (k + 1)) AS gram, substring(marked, 2 * (i + {ORDER} - k) + 1, 2 * k) AS before
    FROM (SELECT text, marked, unnest(range(0, len(marked) // 2 - {ORDER})) AS i FROM s), (SELECT unnest(range(0, {ORDER + 1})) AS k)),
own AS (SELECT k, gram, before, sum(b) AS b, sum(r) AS r FROM g JOIN c USING (text) GROUP BY 1, 2, 3),
every AS (SELECT k, before, sum(b) AS b, sum(r) AS r FROM own GROUP BY 1, 2),
j AS (SELECT text, i, g.k, coalesce(own.b, 0) AS ownb, coalesce(own.r, 0) AS ownr, coalesce(every.b, 0) AS allb, coalesce(every.r, 0) AS allr FROM g LEFT JOIN own ON own.k = g.k AND own.gram = g.gram LEFT JOIN every ON every.k = g.k AND every.before = g.before),
v AS (SELECT text, i, {_OWN} FROM j GROUP BY 1, 2),
z AS (SELECT text, avg(ln({_p("r")}) - ln({_p("b")})) AS score FROM v GROUP BY 1),
y AS (SELECT u.*, z.score FROM u JOIN z USING (text)),
h AS (SELECT CAST(round(greatest(-4.0, least(4.0, score)) * {(BINS - 1) // 8}) AS INTEGER) + {(BINS - 1) // 2} AS bin, count(*) FILTER (rv = 'block') AS b, count(*) FILTER (rv = 'allow') AS r FROM y WHERE aside GROUP BY 1),
e AS (SELECT e, sum(CASE WHEN bin < e THEN b ELSE 0 END) / sum(b) + sum(CASE WHEN bin >= e THEN r ELSE 0 END) / sum(r) AS gain, sum(b) AS b, sum(r) AS r FROM h, (SELECT unnest(range(0, {BINS + 1})) AS e) GROUP BY 1),
best AS (SELECT coalesce(CASE WHEN max(b) > 0 AND max(r) > 0 THEN ((min(e) + max(e)) / 2.0 - {(BINS - 1) // 2} - 0.5) / {(BINS - 1) // 8} END, 0.0) AS threshold FROM e WHERE gain >= (SELECT max(gain) FROM e) - 1e-12)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score, round(CAST(threshold AS DOUBLE), 6) AS threshold FROM y, best"""

OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

# windows of 200 bytes are 400 hexadecimal digits
OP6 = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS x FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM t WHERE len(h) >= 400)),
twice AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
hit AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, TRUE) AS fresh FROM w SEMI JOIN twice USING (x)),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS done FROM runs),
per AS (SELECT c.r, sum(b - a) AS removed, count(*) AS n, string_agg(substring(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept, max(b) AS last FROM cuts c JOIN t USING (r) GROUP BY c.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN per USING (r)"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

OP9 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8))),
rep AS (SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS k FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM v WHERE c > 1) GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.k, 0) AS n_repeat_words, lines FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT doc_id, l, list_filter(regexp_split_to_array(l, '{_WS}'), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(list_distinct(lines)) AS l FROM b)),
g AS (SELECT doc_id, l, ws, len(ws) AS n, len(list_filter(ws, lambda x: regexp_full_match(x, '[|»›•>/\\-]+'))) AS sep, len(list_filter(ws, lambda x: regexp_matches(x, '([#*$%&|<>]|!!)[.,;:]?$'))) AS noisy FROM f),
j AS (SELECT doc_id, length(array_to_string(ws, '')) AS c, CASE WHEN sep >= greatest(1.0, n * 0.2) THEN 'navigation' WHEN noisy >= greatest(1.0, n * 0.3) THEN 'noise' WHEN ({_BOILER}) AND n <= 40 THEN 'boilerplate'
    WHEN n <= 3 AND NOT regexp_matches(l, '[.!?:;,…。！？"'')\]”’»][\x20\x09-\x0D]*$') THEN 'navigation' WHEN n >= 40 AND NOT regexp_matches(l, '[.!?…。！？]') THEN 'punctuation' END AS why FROM g),
k AS (SELECT doc_id, CAST(sum(CASE WHEN why IS NULL THEN c ELSE 0 END) AS BIGINT) AS kept_chars, count(*) FILTER (why = 'navigation') AS n_navigation, count(*) FILTER (why = 'noise') AS n_noise,
    count(*) FILTER (why = 'boilerplate') AS n_boilerplate, count(*) FILTER (why = 'punctuation') AS n_punctuation FROM j GROUP BY 1)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(kept_chars, 0) >= 0.5 * word_chars AS kept, coalesce(kept_chars, 0) AS kept_chars,
    coalesce(n_navigation, 0) AS n_navigation, coalesce(n_noise, 0) AS n_noise, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_punctuation, 0) AS n_punctuation
FROM b LEFT JOIN k ON k.doc_id = b.doc_id"""

_BENCH_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT o.doc_id, o.i, o.n, win.item FROM occ o JOIN win ON win.x = o.x AND win.n = o.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

OP13 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
j AS (SELECT page_id, n, p.d, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""

OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
