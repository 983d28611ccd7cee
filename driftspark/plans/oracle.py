"""The registered queries once more, as SQL for an independent engine.

Only the inputs are shared with :mod:`driftspark.plans.tables`; what is computed from them is
written from the rules again, mostly in a different shape (JSON walks, recursion, plain cases).
"""

from __future__ import annotations

from driftspark.operators.routes import NO_HANDLER, WRAPPED
from driftspark.plans import tables as T

_EVENT_PAYLOADS = f"p AS (SELECT ts, {T.payload_sql(T.EVENT_PAYLOAD)} FROM events)"
_ORDER_PAYLOADS = f"p AS (SELECT o_orderdate AS ts, {T.payload_sql(T.ORDER_PAYLOAD)} FROM orders)"


def _tag(kind: str, number: str) -> str:
    return (
        f"CASE {kind} WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' "
        f"WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN CASE WHEN isfinite({number}) AND {number} % 1 = 0 THEN 'integer' ELSE 'number' END ELSE 'integer' END"
    )


def _nodes(source: str, carry: str) -> str:
    kept = ", ".join(f"s.{name.strip()}" for name in carry.split(","))
    return f"""
    w AS (SELECT {kept}, s.body, t.fullkey, t.atom, {_tag('t.type', 'try_cast(t.atom AS DOUBLE)')} AS type
          FROM {source} s, json_tree(CASE WHEN json_valid(s.body) THEN s.body END) t),
    k AS (SELECT *, ltrim(replace(replace(substr(fullkey, 2), '[0]', '/[]'), '.', '/'), '/') AS node
          FROM w WHERE NOT regexp_matches(fullkey, '\\[[1-9]')),
    full_n AS (SELECT {carry}, node, type, atom FROM k
               UNION ALL
               SELECT {carry}, node || '/[]', NULL, NULL FROM k WHERE type = 'array' AND json_array_length(body, fullkey) = 0),
    n AS (SELECT * FROM (SELECT *, CASE WHEN node = '' THEN 0 ELSE len(string_split(node, '/')) END AS depth FROM full_n) WHERE depth <= 7)"""


_TYPE_TAGS = """
SELECT priority, CASE WHEN NOT json_valid(value) THEN 'unreadable' ELSE {tag} END AS type, count(*) AS samples
FROM (SELECT o_orderpriority AS priority,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN cast(o_totalprice AS varchar) WHEN '2' THEN '"' || o_orderstatus || '"'
  WHEN '3' THEN o_orderkey || 'e' || (o_custkey % 7 - 3)
  WHEN '4' THEN CASE o_orderstatus WHEN 'F' THEN 'null' WHEN 'O' THEN 'true' ELSE '[' || o_custkey || ']' END
  ELSE CASE o_orderstatus WHEN 'F' THEN '{{}}' WHEN 'O' THEN '{{broken' ELSE o_orderkey || '.0' END END AS value FROM orders)
GROUP BY ALL
""".format(tag=_tag("json_type(CASE WHEN json_valid(value) THEN value END)", "try_cast(value AS DOUBLE)"))

_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"

_ARRAY_ITEMS = """
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS a, l_suppkey AS b, l_partkey AS c, l_quantity AS d, l_returnflag AS f, l_tax AS g,
    CASE l_returnflag WHEN 'R' THEN '"' || l_linestatus || '"' WHEN 'A' THEN cast(l_quantity + l_tax AS varchar)
    ELSE '{"line":' || l_linenumber || '}' END AS e FROM lineitem),
r AS (SELECT k, CASE f WHEN 'R' THEN 'string' WHEN 'A' THEN CASE WHEN cast(e AS double) % 1 = 0 THEN 'integer' ELSE 'number' END ELSE 'object' END AS tag,
    row_number() OVER (PARTITION BY k ORDER BY a, b, c, d, f, g, e) - 1 AS i FROM e),
h AS (SELECT * FROM r WHERE i < 3),
m AS (SELECT k, count(DISTINCT tag) > 1 AS mixed, min(tag) AS tag FROM h GROUP BY k),
rows AS (
  SELECT '' AS node, '' AS trail, 'array' AS type FROM m
  UNION ALL SELECT '[]', 'i', CASE WHEN mixed THEN NULL ELSE tag END FROM m
  UNION ALL SELECT '[]/line', 'ip', 'integer' FROM m WHERE NOT mixed AND tag = 'object'
  UNION ALL SELECT '[]/oneOf#' || i, 'io', h.tag FROM h JOIN m USING (k) WHERE mixed
  UNION ALL SELECT '[]/oneOf#' || i || '/line', 'iop', 'integer' FROM h JOIN m USING (k) WHERE mixed AND h.tag = 'object')
SELECT node, trail, type, count(*) AS samples FROM rows GROUP BY ALL
"""

_ELIGIBILITY = f"""
WITH {_EVENT_PAYLOADS}, c AS (SELECT method, path, CASE
    WHEN method NOT IN ('GET', 'DELETE') THEN ['skipped', method || ' skipped (write methods are not sampled)']
    WHEN content_type IS NULL THEN ['failed', 'Not JSON (content-type: none)']
    WHEN NOT contains(content_type, 'application/json') THEN ['failed', 'Not JSON (content-type: ' || content_type || ')']
    WHEN NOT json_valid(body) THEN ['failed', 'Request failed: body is not valid JSON']
    ELSE ['sampled', NULL] END AS r FROM p)
SELECT method, path, r[1] AS outcome, r[2] AS reason, count(*) AS payloads FROM c GROUP BY ALL
"""


def _merge(base: str, observed: str, out: str) -> str:
    """Top-down recursion over both trees; ``out`` has the merged rows."""
    key = "owner, app, path"
    return f"""
    {out}_j AS (SELECT coalesce(b.owner, o.owner) AS owner, coalesce(b.app, o.app) AS app, coalesce(b.path, o.path) AS path,
        coalesce(b.p, o.p) AS p, coalesce(b.trail, o.trail) AS trail, b.type AS bt, o.type AS ot, b.source AS bs,
        b.sampled_type AS bst, b.note AS bn, b.p IS NOT NULL AS has_b, o.p IS NOT NULL AS has_o
        FROM {base} b FULL JOIN {observed} o ON b.owner = o.owner AND b.app = o.app AND b.path = o.path AND b.p = o.p),
    {out}_c AS (SELECT *, CASE WHEN trail = '' THEN NULL WHEN len(trail) = 1 THEN '' ELSE array_to_string(string_split(p, '/')[:-2], '/') END AS parent FROM {out}_j),
    {out}_w AS (
        SELECT *, CASE WHEN NOT has_b THEN 'add' WHEN NOT has_o THEN 'base' WHEN bt = 'unknown' THEN 'replace'
            WHEN bt = 'object' AND ot = 'object' THEN 'obj' WHEN bt = 'array' AND ot = 'array' THEN 'arr'
            WHEN bt <> ot THEN 'conflict' ELSE 'keep' END AS act FROM {out}_c WHERE trail = ''
        UNION ALL
        SELECT c.*, CASE
            WHEN w.act IN ('add', 'copy') THEN 'copy'
            WHEN w.act IN ('replace', 'mark') THEN CASE WHEN c.trail LIKE '%p' THEN 'mark' ELSE 'copy' END
            WHEN w.act IN ('base', 'keep', 'conflict', 'stay') THEN 'stay'
            WHEN w.act IN ('drop', 'empty') THEN 'drop'
            WHEN NOT c.has_b THEN CASE WHEN c.trail LIKE '%i' THEN 'empty' ELSE 'add' END
            WHEN NOT c.has_o THEN CASE WHEN c.trail LIKE '%p' AND (w.bs = 'sampled' OR c.bs = 'sampled') THEN 'drop' ELSE 'base' END
            WHEN c.bt = 'unknown' THEN 'replace' WHEN c.bt = 'object' AND c.ot = 'object' THEN 'obj'
            WHEN c.bt = 'array' AND c.ot = 'array' THEN 'arr' WHEN c.bt <> c.ot THEN 'conflict' ELSE 'keep' END
        FROM {out}_w w JOIN {out}_c c ON c.owner = w.owner AND c.app = w.app AND c.path = w.path AND c.parent = w.p),
    {out} AS (SELECT {key}, p, trail,
        CASE WHEN act IN ('add', 'replace', 'copy', 'mark') THEN ot WHEN act = 'empty' THEN NULL ELSE bt END AS type,
        CASE WHEN act IN ('add', 'replace', 'mark', 'obj') THEN 'sampled' WHEN act IN ('copy', 'empty') THEN NULL ELSE bs END AS source,
        CASE WHEN act = 'conflict' THEN ot WHEN act IN ('add', 'replace', 'copy', 'mark', 'empty') THEN NULL ELSE bst END AS sampled_type,
        CASE WHEN act = 'conflict' THEN 'Static type: ' || bt || ', runtime sample saw: ' || ot
             WHEN act IN ('add', 'replace', 'copy', 'mark', 'empty') THEN NULL ELSE bn END AS note
        FROM {out}_w WHERE act <> 'drop' AND CASE WHEN act IN ('copy', 'mark') THEN has_o WHEN act = 'stay' THEN has_b ELSE true END)"""


_PARTS = f"""WITH RECURSIVE {T.part_ctes()},
    base AS (SELECT *, NULL::varchar AS sampled_type, NULL::varchar AS note FROM b), {_merge('base', 'o', 'm')}"""
_SUMMARY = """
    fields AS (SELECT owner, app, path, p AS name, 'new' AS change FROM m WHERE trail = 'p' AND (owner, app, path, p) NOT IN (SELECT owner, app, path, p FROM b)
      UNION ALL SELECT owner, app, path, p, 'removed' FROM b WHERE trail = 'p' AND (owner, app, path, p) NOT IN (SELECT owner, app, path, p FROM m))"""

_ACCEPT = f"""
WITH s AS (SELECT {T.payload_sql(T.ENDPOINT_OF_PART)}, p_size,
    CASE WHEN p_type = 'LARGE' THEN NULL WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'unknown' WHEN p_type = 'SMALL' THEN 'array' ELSE 'object' END AS scanned,
    CASE WHEN p_size >= 40 THEN NULL WHEN p_size < 10 THEN 'unknown' ELSE 'object' END AS baseline FROM part),
c AS (SELECT *, coalesce(scanned, 'unknown') = 'unknown' AND coalesce(baseline, 'unknown') <> 'unknown' AS carried FROM s),
a AS (SELECT owner, app, path, CASE WHEN p_size BETWEEN 15 AND 25 THEN baseline WHEN carried THEN baseline ELSE scanned END AS type,
    CASE WHEN p_size BETWEEN 15 AND 25 THEN 'runtime' WHEN carried THEN 'baseline' ELSE 'scanned' END AS note FROM c)
SELECT owner, app, path, 2::bigint AS version, type, note FROM a WHERE type IS NOT NULL
"""

_ENDPOINT = "owner, app, method, path"
_ENDPOINT_CHANGES = """
endpoint_changes AS (
  SELECT owner, app, method, path, NULL::varchar AS field, 'breaking' AS change_type, 'endpoint_removed' AS kind,
         'Endpoint ' || method || ' ' || path || ' was removed' AS message FROM old_e WHERE path NOT IN (SELECT path FROM new_e)
  UNION ALL
  SELECT owner, app, method, path, NULL, 'non-breaking', 'endpoint_added', 'Endpoint ' || method || ' ' || path || ' was added'
  FROM new_e WHERE path NOT IN (SELECT path FROM old_e))"""
_FIELD_CHANGES = """
both_e AS (SELECT o.owner, o.app, o.method, o.path FROM old_e o JOIN new_e n USING (owner, app, method, path)),
oroot AS (SELECT * FROM old_n WHERE name = ''), nroot AS (SELECT * FROM new_n WHERE name = ''),
places AS (SELECT e.*, l.location, o.path IS NOT NULL AS had, n.path IS NOT NULL AS has, l.location <> 'response' AS request
  FROM both_e e CROSS JOIN (VALUES ('body'), ('query'), ('response')) l(location)
  LEFT JOIN oroot o ON o.path = e.path AND o.location = l.location LEFT JOIN nroot n ON n.path = e.path AND n.location = l.location),
of AS (SELECT path, location, name, type, required FROM old_n WHERE name <> ''),
nf AS (SELECT path, location, name, type, required FROM new_n WHERE name <> ''),
pairs AS (SELECT p.owner, p.app, p.method, p.path, p.location, p.request, f.name, p.location || '.' || f.name AS field,
    o.name IS NOT NULL AS had, n.name IS NOT NULL AS has, o.type AS ot, n.type AS nt, o.required AS oreq, n.required AS nreq
  FROM places p JOIN (SELECT path, location, name FROM of UNION SELECT path, location, name FROM nf) f ON f.path = p.path AND f.location = p.location
  LEFT JOIN of o ON o.path = f.path AND o.location = f.location AND o.name = f.name
  LEFT JOIN nf n ON n.path = f.path AND n.location = f.location AND n.name = f.name WHERE p.had AND p.has),
field_changes AS (
  SELECT owner, app, method, path, location AS field, CASE WHEN request THEN 'additive' ELSE 'non-breaking' END AS change_type, 'schema_added' AS kind,
    location || ' schema added' AS message FROM places WHERE NOT had AND has
  UNION ALL SELECT owner, app, method, path, location, 'breaking', 'schema_removed', location || ' schema removed' FROM places WHERE had AND NOT has
  UNION ALL SELECT owner, app, method, path, field, 'breaking', 'field_removed', 'Field "' || field || '" was removed' FROM pairs WHERE had AND NOT has
  UNION ALL SELECT owner, app, method, path, field, 'breaking', 'required_field_added', 'Required field "' || field || '" was added to request body'
    FROM pairs WHERE NOT had AND has AND request AND nreq
  UNION ALL SELECT owner, app, method, path, field, 'non-breaking', 'field_added', 'Field "' || field || '" was added'
    FROM pairs WHERE NOT had AND has AND NOT (request AND nreq)
  UNION ALL SELECT owner, app, method, path, field, 'non-breaking', 'type_refined', 'Field "' || field || '" type refined from unknown to ' || nt
    FROM pairs WHERE had AND has AND ot = 'unknown' AND nt <> 'unknown'
  UNION ALL SELECT owner, app, method, path, field, 'breaking', CASE nt WHEN 'unknown' THEN 'type_lost' ELSE 'type_changed' END,
    'Field "' || field || '" type changed from ' || ot || ' to ' || nt FROM pairs WHERE had AND has AND ot <> 'unknown' AND ot <> nt
  UNION ALL SELECT owner, app, method, path, field, 'non-breaking', 'now_optional', 'Field "' || field || '" changed from required to optional'
    FROM pairs WHERE had AND has AND oreq AND NOT nreq
  UNION ALL SELECT owner, app, method, path, field, 'breaking', 'now_required', 'Field "' || field || '" changed from optional to required in request body'
    FROM pairs WHERE had AND has AND NOT oreq AND nreq AND request
  UNION ALL SELECT owner, app, method, path, field, 'non-breaking', 'now_required', 'Field "' || field || '" is now required in response'
    FROM pairs WHERE had AND has AND NOT oreq AND nreq AND NOT request)"""
_STATUS_CHANGES = """
codes AS (SELECT o.owner, o.app, o.method, o.path, o.codes AS oc, n.codes AS nc, o.description AS od, n.description AS nd
  FROM old_e o JOIN new_e n USING (owner, app, method, path)),
status_changes AS (
  SELECT DISTINCT owner, app, method, path, 'statusCode.' || c AS field, 'breaking' AS change_type, 'status_removed' AS kind, 'Status code ' || c || ' was removed' AS message
  FROM (SELECT *, unnest(oc) AS c FROM codes) WHERE NOT list_contains(nc, c)
  UNION ALL SELECT DISTINCT owner, app, method, path, 'statusCode.' || c, 'non-breaking', 'status_added', 'Status code ' || c || ' was added'
  FROM (SELECT *, unnest(nc) AS c FROM codes) WHERE NOT list_contains(oc, c)
  UNION ALL SELECT owner, app, method, path, 'description', 'additive', 'description_updated', 'Description updated'
  FROM codes WHERE od IS DISTINCT FROM nd AND nd <> '')"""
_CONTRACTS = f"WITH {T.contract_ctes()}"

_DRIFT = f"""
WITH {_ORDER_PAYLOADS}, x AS (SELECT owner, app, method, path, ts < timestamp '1998-01-01' AS early, ts, {_tag("json_type(body, '$.total')", "try_cast(json_extract_string(body, '$.total') AS DOUBLE)")} AS total FROM p),
g AS (SELECT owner, app, path, early, total, min(ts) AS first_seen, count(*) AS c FROM x GROUP BY ALL),
t AS (SELECT owner, app, path, early, total FROM g QUALIFY row_number() OVER (PARTITION BY owner, app, path, early ORDER BY first_seen, c DESC, total) = 1),
v AS (SELECT o.owner, o.app, o.path, o.total AS ot, n.total AS nt FROM t o JOIN t n USING (owner, app, path) WHERE o.early AND NOT n.early)
SELECT owner, app, path, 'response.customer' AS field, 'breaking' AS change_type, 'Field "response.customer" was removed' AS message FROM v
UNION ALL SELECT owner, app, path, 'response.' || f, 'non-breaking', 'Field "response.' || f || '" was added' FROM v CROSS JOIN (VALUES ('client'), ('tags')) l(f)
UNION ALL SELECT owner, app, path, 'response.total', 'breaking', 'Field "response.total" type changed from ' || ot || ' to ' || nt FROM v WHERE ot <> nt
"""

# Routes a part file stands for, from how the file was put together.
_ROUTES = f"""
{T.files_cte()},
made AS (
  SELECT repo, rel_path, p_partkey, p_size, p_type, p_name, p_brand, 'app' AS router_type, false AS branching,
    '/api/parts/p' || p_partkey || CASE WHEN p_size <= 5 THEN '/[id]/[...rest]' WHEN p_size <= 10 THEN '/[id]' ELSE '' END AS path,
    unnest(CASE p_type WHEN 'ECONOMY' THEN ['GET', 'DELETE'] WHEN 'PROMO' THEN ['POST'] WHEN 'SMALL' THEN [] ELSE ['PUT'] END) AS method
  FROM f WHERE p_size <= 20
  UNION ALL
  SELECT repo, rel_path, p_partkey, p_size, p_type, p_name, p_brand, 'pages', p_type <> 'PROMO',
    '/api/' || p_type || '/p' || p_partkey || CASE WHEN p_size BETWEEN 26 AND 30 THEN '/[id]' ELSE '' END,
    unnest(CASE p_type WHEN 'SMALL' THEN [] WHEN 'LARGE' THEN ['GET', 'PATCH'] ELSE ['GET'] END)
  FROM f WHERE p_size BETWEEN 21 AND 40 AND p_size NOT IN (31, 32)),
signals AS (SELECT *, CASE WHEN router_type = 'app' AND p_type = 'PROMO' THEN 'wrapper' ELSE 'found' END AS inferability,
    CASE WHEN router_type = 'pages' THEN 'Handler for ' || p_name || '.' WHEN p_type = 'PROMO' OR method = 'DELETE' THEN NULL ELSE p_name || '.' END AS description,
    CASE WHEN router_type = 'app' AND p_type = 'PROMO' THEN '{WRAPPED}' END AS note,
    CASE WHEN router_type = 'app' THEN CASE WHEN method = 'GET' THEN p_brand ELSE '' END
         WHEN p_type = 'PROMO' THEN CASE WHEN path LIKE '%[id]' THEN 'size' ELSE 'id,size' END
         WHEN path LIKE '%[id]' THEN 'page' ELSE 'id,page' END AS query_names,
    CASE WHEN router_type = 'app' AND method = 'GET' THEN cast(200 + p_size AS varchar)
         WHEN router_type = 'app' OR p_type = 'PROMO' THEN '200'
         ELSE (200 + p_size) || CASE p_type WHEN 'LARGE' THEN ',405' ELSE '' END END AS status_codes FROM made)"""

# What each case of handler files shows, read off the cases by hand: case, method, inferability, description,
# names, codes. ``own`` is the part's status.
HANDLER_SIGNALS = [
    (0, "GET", "found", 'Lists "parts".', "q", "own"),
    (0, "PUT", "not-found", None, "", "200"),
    (1, "POST", "found", None, "", "own"),
    (1, "GET", "not-found", None, "", "200"),
    (2, "GET", "found", None, "", "200,own"),
    (3, "PUT", "found", "Second; wins.", "", "own"),
    (4, "GET", "found", None, "page", "own"),
    (4, "DELETE", "found", None, "", "200"),
    (5, "GET", "found", None, 'b,it\'s, (a) "name"', "200"),
    (6, "DELETE", "not-found", None, "", "200"),
    (6, "POST", "wrapper", None, "", "200"),
    (7, "GET", "found", None, "x", "200"),
    (7, "PATCH", "found", None, "", "200"),
]


def _literal(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


_HANDLERS = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in HANDLER_SIGNALS)
_HANDLER_SIGNALS = f"""
SELECT 'org/' || p_type AS repo, '/api/h' || p_partkey AS path, method, inferability, cast(description AS varchar) AS description,
  CASE inferability WHEN 'wrapper' THEN '{WRAPPED}' WHEN 'not-found' THEN '{NO_HANDLER}' END AS note, query_names,
  replace(status_codes, 'own', cast(500 + p_size AS varchar)) AS status_codes
FROM part JOIN (VALUES {_HANDLERS}) c(k, method, inferability, description, query_names, status_codes) ON p_partkey % 8 = k"""

_SPACE = "[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_REFS = f"""
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS field FROM benchmark),
wanted AS (SELECT l.repo, w.field FROM words w CROSS JOIN (VALUES ('en'), ('fr'), ('de'), ('es')) l(repo)),
lines AS (SELECT lang AS repo, 'src/' || source || '/' || doc_id || '.ts' AS file, unnest(string_split(text, chr(10))) AS raw,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
tokens AS (SELECT DISTINCT repo, file, line, raw, unnest(regexp_extract_all(raw, '[A-Za-z0-9_]+')) AS field FROM lines),
refs AS (SELECT t.repo, t.field, t.file, t.line, substr(regexp_replace(t.raw, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, 120) AS text
  FROM tokens t JOIN wanted w USING (repo, field)),
listed AS (SELECT *, count(*) OVER (PARTITION BY repo, field) AS total FROM refs
  QUALIFY row_number() OVER (PARTITION BY repo, field ORDER BY file, line) <= 12)"""

_PUBLISHED = """
published AS (SELECT 'user' || (o_custkey % 97) AS owner, 'App-' || o_custkey AS app, o_orderkey AS version,
  CASE o_orderstatus WHEN 'F' THEN 'nextjs-app-router' WHEN 'O' THEN 'nextjs-pages-router' ELSE 'nextjs-hybrid' END AS stack FROM orders),
current AS (SELECT * FROM published QUALIFY row_number() OVER (PARTITION BY owner, app ORDER BY version DESC) = 1)"""

_TOOL = "lower(method) || '_' || regexp_replace(regexp_replace(replace(replace(replace({path}, '/', '_'), '[', ''), ']', ''), '^_', ''), '_+', '_', 'g')"

_SESSIONS = """
e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
s AS (SELECT *, CASE WHEN us - (lag(us) OVER (PARTITION BY user_id ORDER BY us)) < 1800000000 THEN 0 ELSE 1 END AS starts FROM e),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM s),
sessions AS (SELECT user_id, min(us) AS first, max(us) AS last, count(*) AS events FROM i GROUP BY user_id, island)"""

# The first batch adopts what it sees; the second drops what only the code knew of objects sampled before.
_CONTINUOUS = f"""
WITH p AS (SELECT event_id % 3 AS batch, ts, {T.payload_sql(T.EVENT_PAYLOAD)} FROM events),
ok AS (SELECT batch, path, replace(path, '/api/events/', '') AS event, json_exists(body, '$.high') AS high FROM p
    WHERE method <> 'POST' AND content_type LIKE '%application/json%' AND json_valid(body)),
seen AS (SELECT batch, path, event, bool_or(high) AS high FROM ok GROUP BY ALL),
drift AS (
  SELECT batch, path, 'response' AS field, 'non-breaking' AS change_type, 'schema_added' AS kind, 'response schema added' AS message FROM seen WHERE batch = 0 AND event = 'error'
  UNION ALL SELECT batch, path, 'response.k', 'non-breaking', 'field_added', 'Field "response.k" was added' FROM seen WHERE batch = 0 AND event = 'click'
  UNION ALL SELECT batch, path, 'response.high', 'non-breaking', 'field_added', 'Field "response.high" was added' FROM seen WHERE batch = 0 AND high AND event IN ('click', 'view', 'purchase')
  UNION ALL SELECT batch, path, 'response.gone', 'breaking', 'field_removed', 'Field "response.gone" was removed' FROM seen WHERE batch = 0 AND event = 'view'
  UNION ALL SELECT batch, path, 'response.kept', 'breaking', 'field_removed', 'Field "response.kept" was removed' FROM seen WHERE batch = 1 AND event = 'purchase')
"""

_MERGED = "owner, app, path, type, source, sampled_type, note, p AS node"

_ALTERNATIVES = f"""
WITH a AS (SELECT {T.payload_sql(T.ENDPOINT_OF_ORDER)}, o_totalprice > 400000 AS big,
    {T.alternatives_sql(T.ALTERNATIVES_OLD, '[', ']')} AS was, {T.alternatives_sql(T.ALTERNATIVES_NEW, '[', ']')} AS given FROM orders),
m AS (SELECT * EXCLUDE given, list_transform(given, lambda x: CASE WHEN x = 'error' AND big THEN 'error of numbers' ELSE x END) AS now FROM a),
c AS (SELECT *, unnest(list_filter(was, lambda x: NOT list_contains(now, x))) AS label, 'removed' AS verb, 'non-breaking' AS change_type FROM m
    UNION ALL SELECT *, unnest(list_filter(now, lambda x: NOT list_contains(was, x))), 'added', 'breaking' FROM m)
SELECT owner, app, method, path, 'response' AS field, change_type, 'alternative_' || verb AS kind,
    'Alternative ' || CASE label WHEN 'list' THEN 'array' ELSE 'object' END || ' of "response" was ' || verb AS message FROM c
"""

ORACLE: dict[str, str] = {
    "contract_diff_alternatives": _ALTERNATIVES,
    "contract_diff_stored_hashes": f"""SELECT {T.payload_sql(T.ENDPOINT_OF_ORDER)}, 'response.status' AS field, 'breaking' AS change_type,
      'Field "response.status" type changed from integer to boolean' AS message FROM orders WHERE o_totalprice <= 480000 AND o_custkey % 10 = 7""",
    "payload_type_tags": _TYPE_TAGS,
    "payload_field_types": f"WITH {_EVENT_PAYLOADS}, {_nodes('p', 'ts, path')} SELECT path, node, type, count(*) AS samples, "
    f"strftime(min(ts), {_STAMP}) AS first_seen, strftime(max(ts), {_STAMP}) AS last_seen FROM n GROUP BY path, node, type",
    "payload_observations": f"WITH {_EVENT_PAYLOADS}, q AS (SELECT * FROM p WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'), "
    f"{_nodes('q', 'ts, path')} SELECT path, node, type, count(*) AS samples, "
    f"strftime(min(ts), {_STAMP}) AS first_seen, strftime(max(ts), {_STAMP}) AS last_seen FROM n GROUP BY path, node, type",
    "payload_nested_types": f"WITH {_ORDER_PAYLOADS}, {_nodes('p', 'owner, app')} "
    "SELECT owner, app, node, cast(depth AS integer) AS depth, type, count(*) AS samples FROM n GROUP BY ALL",
    "payload_array_items": _ARRAY_ITEMS,
    "payload_examples": f"WITH {_ORDER_PAYLOADS}, {_nodes('p', 'owner, app')}, "
    "v AS (SELECT owner, app, node, type, CASE type WHEN 'integer' THEN cast(cast(cast(atom AS double) AS bigint) AS varchar) ELSE cast(atom AS varchar) END AS example "
    "FROM n WHERE type IN ('string', 'integer', 'number', 'boolean')) SELECT owner, app, node, type, min(example) AS example FROM v GROUP BY ALL",
    "payload_latest_schema": f"WITH {_ORDER_PAYLOADS}, l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY owner, app ORDER BY ts DESC, body DESC) = 1), "
    f"{_nodes('l', 'owner, app, ts')} SELECT owner, app, strftime(ts, {_STAMP}) AS ts, node, type FROM n",
    "payload_eligibility": _ELIGIBILITY,
    "sampling_targets": f"SELECT {T.payload_sql(T.ENDPOINT_OF_PART)} FROM part WHERE p_size > 40",
    "merge_provenance": f"{_PARTS} SELECT {_MERGED} FROM m",
    "merge_twice": f"{_PARTS}, {_merge('m', 'o', 'mm')} SELECT {_MERGED} FROM mm",
    "sample_field_summary": f"{_PARTS}, {_SUMMARY} SELECT * FROM fields",
    "sample_applied": f"{_PARTS}, {_SUMMARY}, changed AS (SELECT DISTINCT owner, app, path FROM fields) "
    "SELECT owner, app, path, type, source, p AS node FROM m WHERE (owner, app, path) IN (SELECT * FROM changed) "
    "UNION ALL SELECT owner, app, path, type, source, p FROM b WHERE (owner, app, path) NOT IN (SELECT * FROM changed)",
    "carry_forward_accept": _ACCEPT,
    "contract_diff_endpoints": f"{_CONTRACTS}, {_ENDPOINT_CHANGES} SELECT {_ENDPOINT}, change_type, kind, message FROM endpoint_changes",
    "contract_diff_fields": f"{_CONTRACTS}, {_FIELD_CHANGES} SELECT * FROM field_changes",
    "contract_diff_status_desc": f"{_CONTRACTS}, {_STATUS_CHANGES} SELECT * FROM status_changes",
    "duplicate_endpoints": "SELECT '/api/parts/' || l_partkey AS path, max(l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100) AS ordinal, "
    "max(l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100) AS endpoint_ordinal, true AS has_nodes FROM lineitem GROUP BY l_partkey",
    "drift_report_gate": f"{_CONTRACTS}, {_ENDPOINT_CHANGES}, {_FIELD_CHANGES}, {_STATUS_CHANGES}, "
    "all_changes AS (SELECT * FROM endpoint_changes UNION ALL SELECT * FROM field_changes UNION ALL SELECT * FROM status_changes), "
    "apps AS (SELECT DISTINCT owner, app FROM old_e UNION SELECT owner, app FROM all_changes WHERE (owner, app) IN (SELECT owner, app FROM old_e)) "
    "SELECT a.owner, a.app, count(*) FILTER (change_type = 'breaking') AS breaking, count(*) FILTER (change_type = 'non-breaking') AS non_breaking, "
    "count(*) FILTER (change_type = 'additive') AS additive, count(*) FILTER (change_type = 'breaking') > 0 AS failed "
    "FROM apps a LEFT JOIN all_changes c USING (owner, app) GROUP BY a.owner, a.app",
    "payload_drift": _DRIFT,
    "corpus_files": f"WITH {T.files_cte()} SELECT repo, count(*) AS files, cast(sum(length(content)) AS bigint) AS characters FROM f "
    "WHERE rel_path NOT LIKE 'node_modules/%' GROUP BY repo",
    "repo_stacks": f"WITH {T.files_cte()}, g AS (SELECT repo, bool_or(rel_path LIKE 'app/api/%') AS a, bool_or(rel_path LIKE 'pages/api/%') AS p FROM f GROUP BY repo) "
    "SELECT repo, CASE WHEN a AND p THEN 'hybrid' WHEN a THEN 'app' WHEN p THEN 'pages' ELSE 'none' END AS router, "
    "CASE WHEN a AND p THEN 'nextjs-hybrid' WHEN p THEN 'nextjs-pages-router' ELSE 'nextjs-app-router' END AS stack FROM g",
    "route_methods": f"WITH {_ROUTES} SELECT repo, rel_path, path, method, router_type, branching FROM made",
    "route_parameters": f"WITH {_ROUTES} SELECT repo, path, method, 0 AS ordinal, 'id' AS name, 'string' AS type, true AS required FROM made WHERE contains(path, '[id]') "
    "UNION ALL SELECT repo, path, method, 1, 'rest', 'array', true FROM made WHERE contains(path, '[...rest]')",
    "route_resolution": f"WITH {_ROUTES} SELECT repo, path, method, replace(path, '[id]', repo) AS resolved, "
    "CASE WHEN contains(path, '[...rest]') THEN '...rest' ELSE '' END AS missing FROM made",
    "source_signals": f"WITH {_ROUTES} SELECT repo, path, method, inferability, description, note, query_names, status_codes FROM signals",
    "handler_signals": _HANDLER_SIGNALS,
    "broken_fields": f"{_CONTRACTS}, {_FIELD_CHANGES} SELECT owner, replace(field, 'response.', '') AS field_name, count(*) AS changes FROM field_changes "
    "WHERE change_type = 'breaking' AND field LIKE 'response.%' GROUP BY ALL",
    "consumer_refs": f"WITH {_REFS} SELECT repo, field, file, cast(line AS integer) AS line FROM refs",
    "consumer_listing": f"WITH {_REFS} SELECT repo, field, file, cast(line AS integer) AS line, text, total FROM listed",
    "impact_table": f"WITH {_REFS} SELECT w.repo, w.field, coalesce(max(r.total), 0) AS \"references\", "
    "coalesce(string_agg('  ' || r.file || ':' || r.line || '  ' || r.text, chr(10) ORDER BY r.file, r.line), 'none found') AS listing "
    "FROM wanted w LEFT JOIN listed r USING (repo, field) GROUP BY w.repo, w.field",
    "contract_as_of": f"WITH {_PUBLISHED} SELECT owner, app, coalesce(max(version) FILTER (version <= 3000), -1) AS found_version, "
    "CASE WHEN min(version) <= 3000 THEN 'found' ELSE 'missing' END AS status FROM published GROUP BY owner, app",
    "payload_versions": f"""WITH {_EVENT_PAYLOADS},
v AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS since FROM events WHERE value > 100
  QUALIFY row_number() OVER (PARTITION BY since ORDER BY event_id DESC) = 1),
met AS (SELECT p.*, v.event_id AS version, v.user_id FROM p ASOF LEFT JOIN v ON p.ts >= v.since),
judged AS (SELECT method, path, coalesce(version, -1) AS version, status, ts, CASE
  WHEN version IS NULL THEN 'no contract'
  WHEN path LIKE '%/view' THEN 'unknown endpoint'
  WHEN path LIKE '%/purchase' AND user_id % 5 = 0 THEN 'unknown status'
  WHEN path LIKE '%/error' AND user_id % 3 = 0 THEN 'unknown status'
  ELSE 'documented' END AS verdict FROM met)
SELECT method, path, version, status, verdict, count(*) AS calls, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_call,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_call FROM judged GROUP BY ALL""",
    "registry_current": f"WITH {_PUBLISHED} SELECT owner, app, version, stack, CASE WHEN stack = 'nextjs-hybrid' THEN lower(app) ELSE replace(lower(app), '-', '') END AS name FROM current",
    "registry_search": f"WITH {_PUBLISHED} SELECT owner || '/' || app AS slug, version, stack FROM current "
    "WHERE contains(lower(owner || '/' || app), 'r1') AND stack = 'nextjs-app-router'",
    "registry_search_top": f"WITH {_PUBLISHED} SELECT owner || '/' || app AS slug, version, stack, count(*) OVER () AS matches FROM current "
    "WHERE contains(lower(owner || '/' || app), 'r1') AND stack = 'nextjs-app-router' ORDER BY slug LIMIT 50",
    "registry_lookup": f"WITH {_PUBLISHED} SELECT owner, app, version, stack FROM current WHERE owner = 'user5' AND app = 'App-5'",
    "tool_catalog": f"WITH {_ROUTES}, t AS (SELECT repo AS app, method, path, {_TOOL.format(path='path')} AS tool, coalesce(description, method || ' ' || path) AS description FROM signals) "
    "SELECT *, count(*) OVER (PARTITION BY app, tool) AS name_count FROM t",
    "tool_inputs": f"{_CONTRACTS}, f AS (SELECT *, CASE location WHEN 'path' THEN 1 WHEN 'query' THEN 2 ELSE 3 END AS priority FROM all_n WHERE name <> '' AND location <> 'response') "
    f"SELECT {_ENDPOINT}, {_TOOL.format(path='path')} AS tool, name, arg_max(type, priority) AS type, arg_max(location, priority) AS location, "
    "bool_or(location = 'path' OR location = 'body' AND required) AS required FROM f GROUP BY owner, app, method, path, name",
    "tool_schemas": f"{_CONTRACTS}, f AS (SELECT *, CASE location WHEN 'path' THEN 1 WHEN 'query' THEN 2 ELSE 3 END AS priority FROM all_n WHERE name <> '' AND location <> 'response'), "
    f"w AS (SELECT {_ENDPOINT}, name, arg_max(type, priority) AS type, arg_max(location, priority) AS location, "
    "bool_or(location = 'path' OR location = 'body' AND required) AS required FROM f GROUP BY owner, app, method, path, name) "
    f"SELECT {_ENDPOINT}, name, location, required, '{{\"type\":\"' || type || '\"' || CASE WHEN location = 'body' AND name = 'customer' "
    "THEN ',\"required\":[\"id\"],\"properties\":{\"id\":{\"type\":\"string\"}}' ELSE '' END || '}' AS schema FROM w",
    "snapshot_tables": f"{_CONTRACTS} SELECT owner, app, location, name, type, count(*) AS nodes, count(DISTINCT path) AS endpoints "
    "FROM all_n GROUP BY owner, app, location, name, type",
    "snapshot_documents": f"{_CONTRACTS} SELECT owner, app, location, name, type, required, CASE WHEN name = 'total' THEN 'sampled' END AS source, "
    "CASE WHEN location = 'body' AND name = '' THEN 'nowhere' END AS required_names, count(*) AS nodes, count(DISTINCT path) AS endpoints "
    "FROM all_n GROUP BY owner, app, location, name, type, required",
    "payload_deep_arrays": f"WITH p AS (SELECT {T.payload_sql(T.DEEP_PAYLOAD)}, cast(o_custkey % 15 AS integer) AS n FROM orders) "
    "SELECT path, depth, CASE WHEN depth <= n THEN repeat('i', depth) ELSE repeat('i', n) || 'p' END AS trail, "
    "CASE WHEN depth < n THEN 'array' WHEN depth = n THEN 'object' ELSE 'integer' END AS type, count(*) AS samples "
    "FROM (SELECT path, n, cast(unnest(range(0, CASE WHEN n > 6 THEN n + 1 ELSE n + 2 END)) AS integer) AS depth FROM p) GROUP BY ALL",
    "sample_status": f"""WITH {_EVENT_PAYLOADS},
      c AS (SELECT *, replace(path, '/api/events/', '') AS event, CASE WHEN method NOT IN ('GET', 'DELETE') THEN 'skipped'
        WHEN coalesce(content_type, '') NOT LIKE '%application/json%' OR NOT json_valid(body) THEN 'failed' ELSE 'sampled' END AS outcome FROM p),
      e AS (SELECT method, path, event, bool_or(outcome = 'sampled') AS ok, bool_or(outcome = 'sampled' AND json_exists(CASE WHEN json_valid(body) THEN body END, '$.high')) AS high FROM c GROUP BY ALL)
      SELECT method, path, CASE WHEN ok THEN 'sampled' ELSE 'skipped' END AS outcome, CASE WHEN NOT ok THEN method || ' skipped (write methods are not sampled)' END AS reason,
        CASE WHEN ok AND event = 'error' THEN 500 WHEN ok THEN 200 END AS status,
        CASE WHEN NOT ok THEN '' ELSE CASE WHEN high THEN 'high' ELSE '' END || CASE WHEN high AND event IN ('click', 'error') THEN ',' ELSE '' END
          || CASE WHEN event IN ('click', 'error') THEN 'k' ELSE '' END END AS new_fields, CASE WHEN ok AND event = 'view' THEN 'gone' ELSE '' END AS removed_fields FROM e
      UNION ALL SELECT method, path || '/archive', 'skipped', 'No payload', NULL, '', '' FROM e""",
    "corpus_duplicates": "SELECT 'org' AS owner, replace(p_brand, '#', '-') AS app, 'GET' AS method, '/api/p' || p_partkey AS path, "
    "CASE WHEN p_size > 25 THEN 'app/api/p' || p_partkey || '/route.ts' ELSE 'pages/api/p' || p_partkey || '.ts' END AS source_file, "
    "CASE WHEN p_size > 25 THEN 'app' ELSE 'pages' END AS router_type FROM part",
    "corpus_read": "SELECT lang, cast(sum(length(text) + 1) AS bigint) AS characters, cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS bigint) AS lines, "
    "cast(sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS bigint) AS words FROM documents GROUP BY lang",
    "late_events": """WITH e AS (SELECT event_id % 3 AS batch, epoch_us(ts) AS us FROM events), n AS (SELECT batch, max(us) AS newest FROM e GROUP BY batch),
      w AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS watermark FROM n)
      SELECT batch, count(*) AS rows, count(*) FILTER (us < watermark) AS late, watermark FROM e JOIN w USING (batch) GROUP BY batch, watermark""",
    "debounced_checks": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "debounced_stream": f"WITH {_SESSIONS} SELECT * FROM sessions WHERE last + 1800000000 <= (SELECT max(us) FROM e) - 600000000",
    "merge_wide_object": """WITH k AS (SELECT 'k' || o_orderkey AS node, o_orderkey % 3 AS r, CASE o_orderstatus WHEN 'O' THEN 'integer' ELSE 'string' END AS seen FROM orders),
      m AS (SELECT '' AS node, 'object' AS type, 'sampled' AS source, NULL AS sampled_type, NULL AS note
        UNION ALL SELECT node, seen, 'sampled', NULL, NULL FROM k WHERE r = 0
        UNION ALL SELECT node, 'string', NULL, CASE WHEN seen <> 'string' THEN seen END,
          CASE WHEN seen <> 'string' THEN 'Static type: string, runtime sample saw: ' || seen END FROM k WHERE r = 2)
      SELECT 'shop' AS owner, 'wide' AS app, '/ids' AS path, * FROM m""",
    "debounced_hot_stream": """WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events),
      s AS (SELECT *, CASE WHEN us - (lag(us) OVER (PARTITION BY event_type ORDER BY us)) < 300000000 THEN 0 ELSE 1 END AS starts FROM e),
      i AS (SELECT *, sum(starts) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM s),
      b AS (SELECT event_type, min(us) AS first, max(us) AS last, count(*) AS events FROM i GROUP BY event_type, island)
      SELECT * FROM b WHERE last + 600000000 <= (SELECT max(us) FROM e) - 600000000""",
    "continuous_drift": f"{_CONTINUOUS} SELECT * FROM drift",
    "continuous_gate": f"{_CONTINUOUS}, files AS (SELECT count(*) AS n FROM documents), b AS (SELECT DISTINCT batch FROM seen) "
    "SELECT b.batch, 'shop' AS owner, 'tracker' AS app, count(*) FILTER (change_type = 'breaking') AS breaking, count(*) FILTER (change_type = 'non-breaking') AS non_breaking, "
    "0::bigint AS additive, count(*) FILTER (change_type = 'breaking') > 0 AS failed, "
    "CASE WHEN b.batch = 0 THEN (SELECT n FROM files) ELSE 0 END AS \"references\", CASE WHEN b.batch = 2 THEN 12::bigint END AS nodes "
    "FROM b LEFT JOIN drift d USING (batch) GROUP BY b.batch",
}
