"""DuckDB SQL for the results that SQL can express."""

from spindrift.llm.quality import POLICIES, RULES
from spindrift.llm.url_filter import BLOCKED_LABELS

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (s) WHERE first < w.doc_id)),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g) GROUP BY doc_id),
b AS (SELECT d.doc_id, x.p, substr(h, 2 * x.p + 1, 2) AS c FROM d JOIN r USING (doc_id), (SELECT unnest(range(0, (SELECT max(n) FROM d))) AS p) x WHERE x.p < n),
k AS (SELECT b.doc_id, sha256(unhex(string_agg(c, '' ORDER BY b.p))) AS kept FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.p = b.p WHERE g.p IS NULL GROUP BY b.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
CASE WHEN r.doc_id IS NULL THEN sha256(unhex(h)) ELSE coalesce(kept, sha256('')) END AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)"""

_WORDS3 = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3 = f"""
WITH b AS (SELECT item_id, {_WORDS3} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s, least(10, len(w)) AS l
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM iw),
d AS (SELECT doc_id, {_WORDS3} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s, l FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), lens WHERE i + l - 1 <= len(w)),
f AS (SELECT x.doc_id, x.i, x.l, iw.item_id FROM x JOIN iw USING (s, l)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6 = f"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(host, '.'), {list(BLOCKED_LABELS)}) THEN 'block' ELSE 'allow' END AS verdict FROM r"""

_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))
OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT doc_id, i, lead(x, 7) OVER o AS e, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o, lead(x, 6) OVER o, lead(x, 7) OVER o) AS s
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM v WHERE e IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM z WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.n - l.k, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
q AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {POLICIES["v1"].mask}) <> 0 AS base_failed, (failed & {POLICIES["v3"].mask}) = 0 AS kept, failed FROM q"""

OP13 = """
WITH e AS (SELECT sale_id, min(shipped_at) AS s FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id),
c AS (SELECT client_id, min(nation_id) AS g FROM clients GROUP BY client_id),
x AS (SELECT coalesce(c.g, -1) AS g, epoch(date_trunc('minute', sold_at))::BIGINT AS a, epoch(date_trunc('minute', e.s))::BIGINT + 604800 AS b, coalesce(floor(100 * total + 0.5)::BIGINT, 0) AS v
  FROM sales LEFT JOIN e USING (sale_id) LEFT JOIN c USING (client_id) WHERE sold_at IS NOT NULL),
y AS (SELECT * FROM x WHERE b IS NULL OR b > a),
z AS (SELECT * FROM y UNION ALL SELECT -2, a, b, v FROM y),
m AS (SELECT g, a AS t, 1 AS n, v FROM z UNION ALL SELECT g, b, -1, -v FROM z WHERE b IS NOT NULL),
d AS (SELECT g, t, sum(n) AS n, sum(v) AS v FROM m GROUP BY g, t HAVING sum(n) <> 0 OR sum(v) <> 0),
r AS (SELECT g, t, lead(t) OVER w AS u, (sum(n) OVER w)::BIGINT AS n_open, (sum(v) OVER w)::BIGINT AS open_cents FROM d WINDOW w AS (PARTITION BY g ORDER BY t))
SELECT g::INTEGER AS nation_id, t AS from_s, u AS to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY g ORDER BY t) AS high_open, open_cents = max(open_cents) OVER (PARTITION BY g) AS is_peak FROM r"""

ORACLES: dict[str, str] = {"op2_suffix_dedup": OP2, "op3_decontamination": OP3, "op6_url_filter": OP6, "op7_quality_rules": OP7, "op13_peak_concurrency": OP13}
