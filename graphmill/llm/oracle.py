"""SQL of the training-data queries that SQL can express, for the same tables in another engine."""

from __future__ import annotations

import re

from graphmill.llm import license_scan, line_winnow
from graphmill.llm.mix_weights import mixed_sql

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, s, p AS ip, array_to_string(w[p : p + s - 1], ' ') AS txt FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS p FROM b)),
dw AS (SELECT doc_id, p, s, array_to_string(w[p : p + s - 1], ' ') AS txt FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS p FROM d, (SELECT DISTINCT s FROM iw) WHERE len(w) >= s)),
hits AS MATERIALIZED (SELECT doc_id, p, s, item, ip FROM dw JOIN iw USING (s, txt)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + s)) AS q FROM (SELECT DISTINCT doc_id, p, s FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, s, p - ip ORDER BY p) AS g FROM hits),
found AS (SELECT doc_id, item, min(p) - 1 AS p, min(ip) - 1 AS ip, max(p) - min(p) + s AS n FROM runs GROUP BY doc_id, item, s, p - ip, g),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item, ip) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
coalesce(n, 0)::BIGINT AS longest_words, best.item AS longest_item, best.p::BIGINT AS longest_doc_word, best.ip::BIGINT AS longest_item_word
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)"""

_LINES = "SELECT doc_id, l, i, 1 + coalesce(sum(len(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''))"
_NORMAL = "trim(regexp_replace(lower({}), '[ \\t\\r\\x0b\\x0c]+', ' ', 'g'))"

UNITS = rf"""WITH lines AS MATERIALIZED ({_LINES}),
parts AS (SELECT doc_id, i, beg, p, k, beg + coalesce(sum(len(p)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_at, n FROM (
SELECT doc_id, i, beg, unnest(x) AS p, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT doc_id, i, beg, regexp_extract_all(l, '(?:[^.!?]|[.!?]+[^.!?\s])*(?:[.!?]+\s+|[.!?]*$)') AS x0, list_filter(x0, lambda e: e <> '') AS x FROM lines))),
units AS (SELECT doc_id, {_NORMAL.format('l')} AS body, beg - 1 AS s, beg - 1 + len(l) AS e, 4 AS least_words FROM lines
UNION ALL SELECT doc_id, {_NORMAL.format('p')}, from_at - 1, from_at - 1 + len(p), 8 FROM parts WHERE n > 1),
long AS MATERIALIZED (SELECT DISTINCT doc_id, body, s, e FROM units WHERE body <> '' AND len(string_split(body, ' ')) >= least_words),
firsts AS (SELECT body, min((doc_id, s)) AS f FROM long GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, s::BIGINT AS s, e::BIGINT AS e FROM long JOIN firsts USING (body) WHERE (doc_id, s) <> f),
runs AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gone),
spans AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum((before IS NULL OR s > before)::INT) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM runs) GROUP BY doc_id, g)
SELECT d.doc_id, coalesce(len(d.text), 0)::BIGINT AS n_chars, coalesce(n, 0) AS n_removed, coalesce(c, 0)::BIGINT AS removed_chars, coalesce(x, '') AS spans, coalesce(n, 0) > 0 AS repeated FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, sum(e - s) AS c, string_agg(s || '-' || e, ',' ORDER BY s) AS x FROM spans GROUP BY 1) USING (doc_id)"""

LINE_RUNS = rf"""WITH lines AS MATERIALIZED (SELECT doc_id, i, l, CASE WHEN l = '' THEN 0 ELSE len(string_split(l, ' ')) END AS n FROM (SELECT doc_id, i - 1 AS i, {_NORMAL.format('l')} AS l FROM ({_LINES}))),
near AS (SELECT doc_id, i, l, n, lead(l, 1) OVER o AS l1, lead(l, 2) OVER o AS l2, lead(n, 1) OVER o AS n1 FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS MATERIALIZED (SELECT doc_id, i, 3 AS size, 'run' AS kind, l || chr(10) || l1 || chr(10) || l2 AS body FROM near WHERE l2 IS NOT NULL
UNION ALL SELECT doc_id, i, 2, 'passage', l || chr(10) || l1 FROM near WHERE n + n1 >= {line_winnow.LONG}
UNION ALL SELECT doc_id, i, 1, 'passage', l FROM near WHERE n >= {line_winnow.LONG}
UNION ALL SELECT doc_id, 0, count(*), 'whole', string_agg(l, chr(10) ORDER BY i) FROM lines GROUP BY doc_id HAVING count(*) < 3 AND sum(n) BETWEEN 1 AND {line_winnow.LONG - 1}),
firsts AS (SELECT size, kind, body, min((doc_id, i)) AS f FROM runs GROUP BY ALL HAVING count(*) > 1),
later AS MATERIALIZED (SELECT doc_id, i, size, f[1] AS source_doc, f[2] AS source_line FROM runs JOIN firsts USING (size, kind, body) WHERE (doc_id, i) <> f),
met AS (SELECT *, i - source_line AS shift, max(i + size) OVER (PARTITION BY doc_id, source_doc, i - source_line ORDER BY i, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM later),
islands AS (SELECT *, sum((before IS NULL OR i > before)::INT) OVER (PARTITION BY doc_id, source_doc, shift ORDER BY i, size) AS g FROM met),
matches AS (SELECT doc_id, min(i) AS a, max(i + size) AS b, source_doc, min(source_line) AS sa FROM islands GROUP BY doc_id, source_doc, shift, g)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(n, 0) AS n_deleted, coalesce(m, '') AS matches, coalesce(n, 0) > 0 AS repeated FROM documents d
LEFT JOIN (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS q FROM later) GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(a || '-' || b || '=' || source_doc || ':' || sa, ',' ORDER BY a, b, source_doc, sa) AS m FROM matches GROUP BY 1) USING (doc_id)"""


def licenses() -> str:
    """The query op9: k-grams of whole texts, joined with those of the templates."""
    rows = []
    for n, (text, label) in enumerate([*license_scan.PHRASES, *license_scan.NOTICES, *license_scan.TEXTS]):
        base, ws = n < len(license_scan.PHRASES), re.findall("[a-z0-9]+", text.lower())
        k = license_scan.PAIR if base else license_scan.RUN
        near = max(license_scan.NEAR, len(ws) // license_scan.NEAR_SHARE)
        rows += [f"({n}, '{label}', {base}, '{' '.join(ws[i : i + k])}', {i}, {len(ws) - k + 1}, {len(ws)}, {near})" for i in range(len(ws) - k + 1)]
    k, r = license_scan.PAIR, license_scan.RUN
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
t(template, label, base, gram, place, grams, words, near) AS (VALUES {", ".join(rows)}),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, i - 1 - place AS diagonal, t.* FROM (SELECT doc_id, i, array_to_string(w[i : i + {k - 1}], ' ') AS gram FROM p UNION ALL SELECT doc_id, i, array_to_string(w[i : i + {r - 1}], ' ') FROM p) JOIN t USING (gram)),
votes AS MATERIALIZED (SELECT doc_id, template, label, base, grams, near, diagonal, count(DISTINCT place) AS votes FROM hits GROUP BY ALL),
places AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list_sort(list_distinct(list(label))) AS base_set FROM votes WHERE base AND votes = grams GROUP BY 1),
clusters AS (SELECT *, sum((prior IS NULL OR diagonal - prior > near)::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS c FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS prior FROM votes WHERE NOT base)),
spans AS (SELECT doc_id, template, c, h.label, count(DISTINCT place)::DOUBLE / any_value(h.grams) AS cover, max(pos) - min(pos) + {r} <= {license_scan.STRETCH} * any_value(words) AS fits FROM clusters JOIN hits h USING (doc_id, template, diagonal) GROUP BY ALL),
found AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS own_set, max(cover) AS cover FROM spans WHERE cover >= {license_scan.COVER} AND fits GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, array_to_string(coalesce(base_set, []), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(own_set, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""


#: crc32 of the ASCII text x, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda k: ascii(substr({x}, k, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
_LEAF = " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", "{text}"))

MERKLE = rf"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
FROM (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({_LEAF.format(text="text")}) AS leaf,
sha256({_LEAF.format(text="CASE WHEN " + _CRC.format(x="doc_id::VARCHAR") + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS found FROM documents)),
nodes AS (SELECT tree, 0 AS lvl, i, leaf AS h, n FROM leaves
UNION ALL SELECT tree, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 8, n),
tops AS MATERIALIZED (SELECT tree, lvl, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS (SELECT 0 AS lvl, i, h, n FROM tops
UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM over WHERE n > 1 GROUP BY lvl, i // 8, n),
steps AS MATERIALIZED (SELECT a.tree, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL
UNION ALL SELECT t.tree, t.lvl + a.lvl, 0, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''), coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')
FROM tops t JOIN over a ON a.n > 1 AND a.i = CASE a.lvl {" ".join(f"WHEN {k} THEN t.i // {8**k}" for k in range(12))} END JOIN over b ON a.lvl = b.lvl AND a.i // 8 = b.i // 8 GROUP BY ALL),
climbed AS (SELECT tree, i AS leaf_i, 0 AS lvl, i, found AS h, '' AS proof FROM leaves
UNION ALL SELECT c.tree, c.leaf_i, c.lvl + 1, c.i // 8, sha256(s.lefts || c.h || s.rights), c.proof || s.lefts || s.rights FROM climbed c JOIN steps s ON s.tree = c.tree AND s.lvl = c.lvl AND s.i = c.i),
folded AS (SELECT tree, leaf_i, h, proof FROM climbed QUALIFY row_number() OVER (PARTITION BY tree, leaf_i ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, tops.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN tops ON tops.tree = l.tree JOIN folded f ON f.tree = l.tree AND f.leaf_i = l.i, (SELECT h FROM over WHERE n = 1) r"""

SQL = {
    "op5_line_winnow": LINE_RUNS,
    "op6_mix_weights": mixed_sql(),
    "op7_decontaminate": CONTAMINATION,
    "op8_unit_dedup": UNITS,
    "op9_license_scan": licenses(),
    "op10_minhash": NEAR_DUPLICATES,
    "op13_merkle": MERKLE,
}
