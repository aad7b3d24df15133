"""SQL of the queries p2 and p3 for DuckDB, put together from parts."""

from __future__ import annotations


def _unwrapped(x: str) -> str:
    """Text that holds the JSON of a list or object as that list or object."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches(json_extract_string({x}, '$'), '^\\s*[\\[{{]') AND json_valid(json_extract_string({x}, '$')) THEN CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"


def _listed(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END"


def _elements(source: str, keep: str, x: str, wrapped: bool = True) -> str:
    """Rows of ``source`` with its list ``x`` cut into (no, e)."""
    e = _unwrapped("e") if wrapped else "e"
    return f"SELECT {keep}, no, {e} AS e FROM (SELECT {keep}, generate_subscripts(l, 1) - 1 AS no, unnest(l) AS e FROM (SELECT {keep}, {_listed('x')} AS l FROM (SELECT {keep}, {_unwrapped(x)} AS x FROM {source})))"


def _child(name: str, source: str, parent: str, key: str) -> str:
    return f"SELECT id AS record_id, '{name}' AS child_table, CAST({parent} AS INT) AS parent_no, CAST(no AS INT) AS child_no, {key} AS child_key FROM ({source}) WHERE e IS NOT NULL AND json_type(e) <> 'NULL'"


_KEY = "coalesce(CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.{k}') END, '')"
_TEXT = "json_extract_string(e, '$')"
_HIT = "CASE WHEN json_type(e) = 'OBJECT' THEN coalesce(json_extract_string(e, '$.object_id'), '') ELSE json_extract_string(e, '$') END"

P2_SQL = f"""
WITH g AS (SELECT DISTINCT graph_id AS id, CASE WHEN json_valid(object_nodes) THEN CAST(object_nodes AS JSON) END AS o, CASE WHEN json_valid(channel_edges) THEN CAST(channel_edges AS JSON) END AS c FROM channel_graph),
n AS ({_elements("g", "id", "o")}), c AS ({_elements("g", "id", "c")}),
nn AS (SELECT id, no AS p, json_extract(e, '$.writer_sites') AS w, json_extract(e, '$.reader_sites') AS r, json_extract(e, '$.members') AS m, json_extract(e, '$.type_facts') AS t FROM n WHERE json_type(e) = 'OBJECT'),
cc AS (SELECT id, no AS p, json_extract(e, '$.constraints') AS k FROM c WHERE json_type(e) = 'OBJECT'),
tf AS (SELECT id, p, {_unwrapped("t")} AS t FROM nn WHERE t IS NOT NULL),
l AS (SELECT DISTINCT chain_id AS id, CASE WHEN json_valid(link_debug) THEN CAST(link_debug AS JSON) END AS raw FROM chains),
ll AS (SELECT id, json_extract(x, '$.object_hits') AS h, json_extract(x, '$.producer_candidates') AS pc, json_extract(x, '$.bridge_functions') AS b FROM (SELECT id, {_unwrapped("raw")} AS x FROM l) WHERE json_type(x) = 'OBJECT')
SELECT DISTINCT * FROM (
{_child("object_node", "SELECT * FROM n", "0", _KEY.format(k="object_id"))}
UNION ALL {_child("channel_edge", "SELECT * FROM c", "0", _KEY.format(k="object_id"))}
UNION ALL {_child("writer_site", _elements("nn", "id, p", "w"), "p", _KEY.format(k="fn"))}
UNION ALL {_child("reader_site", _elements("nn", "id, p", "r"), "p", _KEY.format(k="fn"))}
UNION ALL {_child("member", _elements("nn", "id, p", "m", False), "p", _TEXT)}
UNION ALL {_child("edge_constraint", _elements("cc", "id, p", "k", False), "p", _TEXT)}
UNION ALL SELECT tf.id, 'type_fact', CAST(tf.p AS INT), 0, regexp_replace(replace(replace(fullkey, '[', '.'), ']', ''), '^\\$\\.', '') FROM tf, json_tree(tf.t) WHERE json_tree.type NOT IN ('OBJECT', 'ARRAY', 'NULL')
UNION ALL {_child("object_hit", _elements("ll", "id", "h"), "0", _HIT)}
UNION ALL {_child("producer_candidate", _elements("ll", "id", "pc", False), "0", _TEXT)}
UNION ALL {_child("bridge_function", _elements("ll", "id", "b", False), "0", _TEXT)}
)"""

P3_SQL = r"""
WITH rec AS (
  SELECT DISTINCT 'manifest' dataset, 'sample_id' idf, * FROM manifest UNION ALL SELECT DISTINCT 'artifact', 'artifact_id', * FROM artifact
), good AS (SELECT dataset, feed, file_no, row_no, raw, idf FROM rec WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
kv AS (SELECT dataset, feed, file_no, row_no, json_extract_string(raw, '$.' || idf) id, unnest(json_keys(raw)) k, raw FROM good),
f AS (SELECT dataset, feed, file_no, row_no, id, k, json_extract(raw, '$."' || k || '"') v, CASE json_type(json_extract(raw, '$."' || k || '"')) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END t FROM kv),
cnt AS (SELECT dataset, feed, file_no, k, t, count(*) n FROM f WHERE t IS NOT NULL GROUP BY ALL),
sch AS (SELECT dataset, feed, file_no, k, arg_max(t, n) t FROM cnt GROUP BY ALL),
files AS (SELECT dataset, feed, file_no, row_number() OVER w AS pos, lead(file_no) OVER w AS nxt FROM (SELECT DISTINCT dataset, feed, file_no FROM good) WINDOW w AS (PARTITION BY dataset, feed ORDER BY file_no)),
s AS (SELECT sch.*, pos, nxt FROM sch JOIN files USING (dataset, feed, file_no)),
came AS (SELECT * FROM s WHERE pos > 1 AND NOT EXISTS (SELECT 1 FROM s p WHERE p.dataset = s.dataset AND p.feed = s.feed AND p.k = s.k AND p.pos = s.pos - 1)),
went AS (SELECT s.*, s.nxt new_file FROM s WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s n WHERE n.dataset = s.dataset AND n.feed = s.feed AND n.k = s.k AND n.pos = s.pos + 1)),
pairs AS (
  SELECT w.dataset, w.feed, w.new_file file_no, w.k old_field, c.k new_field, avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END) share
  FROM went w JOIN came c ON w.dataset = c.dataset AND w.feed = c.feed AND w.new_file = c.file_no
  JOIN f a ON a.dataset = w.dataset AND a.feed = w.feed AND a.file_no = w.file_no AND a.k = w.k AND a.t IS NOT NULL
  JOIN f b ON b.dataset = c.dataset AND b.feed = c.feed AND b.file_no = c.file_no AND b.k = c.k AND b.t IS NOT NULL AND b.id = a.id GROUP BY ALL),
ren AS (SELECT * FROM pairs WHERE share >= 0.9)
SELECT dataset, feed, file_no, 'renamed' change_kind, old_field, new_field FROM ren
UNION ALL SELECT dataset, feed, new_file, 'removed', k, '' FROM went w WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.dataset = w.dataset AND r.feed = w.feed AND r.file_no = w.new_file AND r.old_field = w.k)
UNION ALL SELECT dataset, feed, file_no, 'added', '', k FROM came c WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.dataset = c.dataset AND r.feed = c.feed AND r.file_no = c.file_no AND r.new_field = c.k)
UNION ALL SELECT s.dataset, s.feed, s.file_no, 'type_changed', s.k, s.k FROM s JOIN s p ON p.dataset = s.dataset AND p.feed = s.feed AND p.k = s.k AND p.pos = s.pos - 1 WHERE p.t <> s.t"""

P3_UNION_SQL = """
WITH rec AS (SELECT DISTINCT 'manifest' dataset, * FROM manifest UNION ALL SELECT DISTINCT 'artifact', * FROM artifact), kv AS (SELECT dataset, unnest(json_keys(raw)) k, raw FROM rec WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
f AS (SELECT dataset, k, CASE json_type(json_extract(raw, '$."' || k || '"')) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END t FROM kv),
c AS (SELECT dataset, k field, count(*) FILTER (t = 'text') n_text, count(*) FILTER (t = 'number') n_number, count(*) FILTER (t = 'boolean') n_boolean, count(*) FILTER (t = 'array') n_array, count(*) FILTER (t = 'object') n_object FROM f WHERE t IS NOT NULL GROUP BY ALL)
SELECT *, CASE greatest(n_text, n_number, n_boolean, n_array, n_object) WHEN n_text THEN 'text' WHEN n_number THEN 'number' WHEN n_boolean THEN 'boolean' WHEN n_array THEN 'array' ELSE 'object' END main_tag FROM c"""

P3_REFUSED_SQL = """
WITH rec AS (SELECT DISTINCT 'manifest' dataset, * FROM manifest UNION ALL SELECT DISTINCT 'artifact', * FROM artifact)
SELECT dataset, feed, file_no, count(*) AS rows FROM rec WHERE raw IS NULL OR NOT json_valid(raw) OR json_type(CASE WHEN json_valid(raw) THEN raw END) <> 'OBJECT' GROUP BY ALL"""
