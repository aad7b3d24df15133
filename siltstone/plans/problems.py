"""The queries p1 to p4 over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.words import blank_to_null, norm_id, squeezed, stripped, word32
from siltstone.operators.diff import diff_copies
from siltstone.operators.drift import appearing_types, fields_of, id_of, infer_union, records, refused_rows, schema_changes, steady_table
from siltstone.operators.references import orphan_references
from siltstone.operators.shred import Entity, Shape, child_rows, entity_table, listed, open_table, shred
from siltstone.sources.tables import table


def _joined(*parts: str | Column) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Differences between the two systems' bundles and sink root lists."""
    own_id = F.coalesce(F.when(F.col("gt_kind") == "sink", F.col("gt_sink_id")).otherwise(F.col("gt_source_id")), F.col("gt_source_id"), F.col("gt_sink_id"))
    name = stripped(F.col("function_name"))
    address = F.col("address").cast("string")
    word = F.coalesce(word32(address).cast("string"), blank_to_null(stripped(address)))
    bundle = diff_copies(
        table(spark, d, "normalized_gt_bundle"), table(spark, d, "normalized_gt_bundle_copy"),
        key=_joined("gt_kind", "binary_stem", own_id), order="updated_at",
        fields={"address": (word, word), "function_name": (name, name)},
    )
    roots = diff_copies(
        table(spark, d, "sink_roots"), table(spark, d, "sink_roots_copy"),
        key=_joined("binary_stem", "sink_id"), order="updated_at",
        children="sink_roots", child_key="root_id",
        child_fields={n: (lambda c, n=n: squeezed(c[n])) for n in ("expr", "root_role", "status")},
    )
    return bundle.withColumn("dataset", F.lit("normalized_gt_bundle")).unionByName(roots.withColumn("dataset", F.lit("sink_roots"))).select("dataset", "record_key", "field_name", "diff_kind")


P1_SQL = r"""
WITH raw AS (
  SELECT 0 side, gt_kind, binary_stem, coalesce(gt_source_id, gt_sink_id) id, updated_at, function_name, CAST(address AS VARCHAR) address FROM normalized_gt_bundle
  UNION ALL SELECT 1, gt_kind, binary_stem, coalesce(gt_source_id, gt_sink_id), updated_at, function_name, address FROM normalized_gt_bundle_copy
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, gt_kind, binary_stem, id ORDER BY updated_at DESC NULLS LAST) n FROM raw) WHERE n = 1
), norm AS (
  SELECT side, concat(gt_kind, '|', binary_stem, '|', id) k, nullif(regexp_replace(function_name, '^\s+|\s+$', '', 'g'), '') f, lower(trim(address)) a FROM best
), bundle AS (
  SELECT side, k, coalesce(f, '') f, CASE WHEN a IS NULL OR a = '' THEN -1 WHEN a LIKE '0x%' THEN CAST(concat('0x', ltrim(substr(a, 3), '0'), CASE WHEN ltrim(substr(a, 3), '0') = '' THEN '0' ELSE '' END) AS BIGINT) ELSE (CAST(a AS BIGINT) + 4294967296) % 4294967296 END a FROM norm
), b0 AS (SELECT * FROM bundle WHERE side = 0), b1 AS (SELECT * FROM bundle WHERE side = 1),
bj AS (SELECT coalesce(b0.k, b1.k) k, b0.k k0, b1.k k1, b0.f f0, b1.f f1, b0.a a0, b1.a a1 FROM b0 FULL JOIN b1 ON b0.k = b1.k),
rraw AS (
  SELECT 0 side, binary_stem, sink_id, updated_at, sink_roots FROM sink_roots UNION ALL SELECT 1, binary_stem, sink_id, updated_at, sink_roots FROM sink_roots_copy
), rbest AS (
  SELECT side, concat(binary_stem, '|', sink_id) k, sink_roots FROM (SELECT *, row_number() OVER (PARTITION BY side, binary_stem, sink_id ORDER BY updated_at DESC NULLS LAST) n FROM rraw) WHERE n = 1
), el AS (SELECT side, k, unnest(sink_roots) u FROM rbest),
root AS (
  SELECT DISTINCT side, k, coalesce(u.root_id, '') r, regexp_replace(coalesce(u.expr, ''), '\s', '', 'g') e, regexp_replace(coalesce(u.root_role, ''), '\s', '', 'g') o, regexp_replace(coalesce(u.status, ''), '\s', '', 'g') s FROM el WHERE u IS NOT NULL
), r0 AS (SELECT * FROM root WHERE side = 0), r1 AS (SELECT * FROM root WHERE side = 1),
k0 AS (SELECT k FROM rbest WHERE side = 0), k1 AS (SELECT k FROM rbest WHERE side = 1),
kj AS (SELECT coalesce(k0.k, k1.k) k, k0.k a, k1.k b FROM k0 FULL JOIN k1 ON k0.k = k1.k),
rj AS (SELECT coalesce(r0.k, r1.k) k, coalesce(r0.r, r1.r) r, r0.r a, r1.r b, r0.e e0, r1.e e1, r0.o o0, r1.o o1, r0.s s0, r1.s s1 FROM r0 FULL JOIN r1 ON r0.k = r1.k AND r0.r = r1.r),
rr AS (SELECT rj.* FROM rj JOIN kj ON kj.k = rj.k AND kj.a IS NOT NULL AND kj.b IS NOT NULL)
SELECT DISTINCT * FROM (
  SELECT 'normalized_gt_bundle' dataset, k record_key, '*' field_name, CASE WHEN k1 IS NULL THEN 'only_first' ELSE 'only_second' END diff_kind FROM bj WHERE k0 IS NULL OR k1 IS NULL
  UNION ALL SELECT 'normalized_gt_bundle', k, 'address', 'changed' FROM bj WHERE k0 IS NOT NULL AND k1 IS NOT NULL AND a0 <> a1
  UNION ALL SELECT 'normalized_gt_bundle', k, 'function_name', 'changed' FROM bj WHERE k0 IS NOT NULL AND k1 IS NOT NULL AND f0 <> f1
  UNION ALL SELECT 'sink_roots', k, '*', CASE WHEN b IS NULL THEN 'only_first' ELSE 'only_second' END FROM kj WHERE a IS NULL OR b IS NULL
  UNION ALL SELECT 'sink_roots', k, r, CASE WHEN b IS NULL THEN 'only_first' ELSE 'only_second' END FROM rr WHERE a IS NULL OR b IS NULL
  UNION ALL SELECT 'sink_roots', k, concat(r, '.expr'), 'changed' FROM rr WHERE a IS NOT NULL AND b IS NOT NULL AND e0 <> e1
  UNION ALL SELECT 'sink_roots', k, concat(r, '.root_role'), 'changed' FROM rr WHERE a IS NOT NULL AND b IS NOT NULL AND o0 <> o1
  UNION ALL SELECT 'sink_roots', k, concat(r, '.status'), 'changed' FROM rr WHERE a IS NOT NULL AND b IS NOT NULL AND s0 <> s1
)"""


GRAPH_DOCUMENTS = {
    "object_nodes": Shape(
        lists=frozenset({"object_nodes", "object_nodes/*/writer_sites", "object_nodes/*/reader_sites", "object_nodes/*/members"}),
        plain_lists=frozenset({"object_nodes/*/members"}),
        open_parts=frozenset({"object_nodes/*/type_facts"}),
    ),
    "channel_edges": Shape(lists=frozenset({"channel_edges", "channel_edges/*/constraints"}), plain_lists=frozenset({"channel_edges/*/constraints"})),
}
LINK_DOCUMENTS = {
    "link_debug": Shape(
        lists=frozenset({"link_debug/object_hits", "link_debug/producer_candidates", "link_debug/bridge_functions"}),
        plain_lists=frozenset({"link_debug/producer_candidates", "link_debug/bridge_functions"}),
    )
}
GRAPH_ENTITIES = [
    Entity("object_node", "object_nodes", "object_id"),
    Entity("channel_edge", "channel_edges", "object_id"),
    Entity("writer_site", "object_nodes/*/writer_sites", "fn"),
    Entity("reader_site", "object_nodes/*/reader_sites", "fn"),
    Entity("member", "object_nodes/*/members", bare=True),
    Entity("edge_constraint", "channel_edges/*/constraints", bare=True),
    Entity("type_fact", "object_nodes/*/type_facts", open_part=True),
]
LINK_ENTITIES = [
    Entity("object_hit", "link_debug/object_hits", "object_id", bare=True),
    Entity("producer_candidate", "link_debug/producer_candidates", bare=True),
    Entity("bridge_function", "link_debug/bridge_functions", bare=True),
]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every list element and type fact within graph documents and chain diagnostics, by parent and place."""
    graphs = child_rows(shred(table(spark, d, "channel_graph"), "graph_id", GRAPH_DOCUMENTS), GRAPH_ENTITIES)
    links = child_rows(shred(table(spark, d, "chains"), "chain_id", LINK_DOCUMENTS), LINK_ENTITIES)
    return graphs.unionByName(links)


SITE_FIELDS = ["context", "fn", "fn_addr", "site_addr", "access_kind", "target_addr"]


def _graph_part(spark: SparkSession, d: str, doc: str) -> DataFrame:
    return shred(table(spark, d, "channel_graph"), "graph_id", {doc: GRAPH_DOCUMENTS[doc]})


def _links(spark: SparkSession, d: str) -> DataFrame:
    return shred(table(spark, d, "chains"), "chain_id", LINK_DOCUMENTS)


def p2_object_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Object nodes as a flat table, one row per node of a graph document, with address range and contexts."""
    adjacency = _graph_part(spark, d, "object_nodes")
    nodes = entity_table(adjacency, "object_nodes", ["object_id", "region_kind", "confidence", "notes"]).alias("n")
    lists = listed(adjacency, "object_nodes", ["addr_range", "producer_contexts", "consumer_contexts"]).alias("l")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("record_id", "doc_key", "child_no")]
    contexts = [F.array_join(f"l.{c}", ",").alias(c) for c in ("producer_contexts", "consumer_contexts")]
    return nodes.join(lists, same, "left").select("n.*", F.get("l.addr_range", F.lit(0)).alias("addr_lo"), F.get("l.addr_range", F.lit(1)).alias("addr_hi"), *contexts)


def p2_sites(spark: SparkSession, d: str) -> DataFrame:
    """Writer sites as a flat table whose rows point to graph, node and place."""
    return entity_table(_graph_part(spark, d, "object_nodes"), "object_nodes/*/writer_sites", SITE_FIELDS)


def p2_reader_sites(spark: SparkSession, d: str) -> DataFrame:
    """Reader sites as a flat table whose rows point to graph, node and place."""
    return entity_table(_graph_part(spark, d, "object_nodes"), "object_nodes/*/reader_sites", SITE_FIELDS)


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of object nodes."""
    return entity_table(_graph_part(spark, d, "object_nodes"), "object_nodes/*/members", [], "member")


def p2_type_facts(spark: SparkSession, d: str) -> DataFrame:
    """Type facts of object nodes by name or trail."""
    return open_table(_graph_part(spark, d, "object_nodes"), "object_nodes/*/type_facts")


def p2_channel_edges(spark: SparkSession, d: str) -> DataFrame:
    """Channel edges as a flat table, one row per edge of a graph document."""
    return entity_table(_graph_part(spark, d, "channel_edges"), "channel_edges", ["object_id", "src_context", "dst_context", "edge_kind", "score", "ambiguity_penalty", "object_quality"])


def p2_edge_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of channel edges."""
    return entity_table(_graph_part(spark, d, "channel_edges"), "channel_edges/*/constraints", [], "constraint_text")


def p2_object_hits(spark: SparkSession, d: str) -> DataFrame:
    """Object hits of chains; a bare one is its object's id."""
    return entity_table(_links(spark, d), "link_debug/object_hits", ["object_id", "quality"], "object_id")


def p2_producer_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Producer candidates of chains."""
    return entity_table(_links(spark, d), "link_debug/producer_candidates", [], "candidate")


def p2_bridge_functions(spark: SparkSession, d: str) -> DataFrame:
    """Bridge functions of chains."""
    return entity_table(_links(spark, d), "link_debug/bridge_functions", [], "function_name")


FEEDS = {"manifest": "sample_id", "artifact": "artifact_id"}
MANIFEST_COLUMNS = ["sample_id", "dataset", "binary_path", "gt_stem", "output_stem", "unstripped_output_stem", "eval_scope", "has_gt", "n_functions", "notes"]
ARTIFACT_COLUMNS = ["artifact_id", "artifact_name", "binary_stem", "binary_sha", "schema_version", "status", "stage_required", "row_count"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field between consecutive files of a feed."""
    # Both kinds of record go through one plan; a feed's name carries the kind it belongs to.
    both = [table(spark, d, name).withColumn("feed", F.concat(F.lit(f"{name}|"), "feed")) for name in FEEDS]
    ident = F.coalesce(*[F.when(F.col("feed").startswith(f"{name}|"), id_of(key)) for name, key in FEEDS.items()])
    found = schema_changes(both[0].unionByName(both[1]), ident)
    parts = F.split("feed", r"\|", 2)
    return found.select(parts[0].alias("dataset"), parts[1].alias("feed"), "file_no", "change_kind", "old_field", "new_field")


def p3_manifest(spark: SparkSession, d: str) -> DataFrame:
    """All manifest files as one table of steady columns."""
    df = table(spark, d, "manifest")
    return steady_table(df, "sample_id", MANIFEST_COLUMNS, schema_changes(df, "sample_id")).withColumn("_other", F.to_json("_other"))


def p3_artifact(spark: SparkSession, d: str) -> DataFrame:
    """All artifact files as one table of steady columns."""
    df = table(spark, d, "artifact")
    return steady_table(df, "artifact_id", ARTIFACT_COLUMNS, schema_changes(df, "artifact_id")).withColumn("_other", F.to_json("_other"))


def p3_refused(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each file are left out because they hold no JSON object."""
    parts = [refused_rows(table(spark, d, name), ["feed", "file_no"]).select(F.lit(name).alias("dataset"), "*") for name in FEEDS]
    return parts[0].unionByName(parts[1])


def p3_union_types(spark: SparkSession, d: str) -> DataFrame:
    """The fused schema of each kind of record: per field, how many values of each type."""
    parts = [infer_union(fields_of(records(table(spark, d, name)), []), []).withColumn("dataset", F.lit(name)) for name in FEEDS]
    return parts[0].unionByName(parts[1])


def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every type that appears beside the first one of a path, nested ones too, with the file it begins in."""
    parts = [appearing_types(table(spark, d, name)).select(F.lit(name).alias("dataset"), "*") for name in FEEDS]
    return parts[0].unionByName(parts[1])


def _chain_references(chains: DataFrame) -> DataFrame:
    """A row per reference of a ground-truth chain: chain, field, kind of item, normalised id, time."""
    lists = {"required_source_ids": "source", "required_object_ids": "object", "required_root_ids": "root"}
    one = lambda name, kind, ids: F.struct(F.lit(name).alias("ref_field"), F.lit(kind).alias("item_kind"), ids.alias("ids"))
    groups = F.array(one("sink_id", "sink", F.array("sink_id")), *[one(n, k, F.col(n)) for n, k in lists.items()])
    rows = chains.select("binary_stem", "chain_id", "recorded_at", F.explode(groups).alias("g")).select("binary_stem", "chain_id", "recorded_at", "g.ref_field", "g.item_kind", F.explode("g.ids").alias("id"))
    return rows.select("binary_stem", "chain_id", "recorded_at", "ref_field", "item_kind", norm_id(F.col("id")).alias("ref_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every id that a ground-truth chain requires and that stands for no item at the chain's time."""
    items = table(spark, d, "gt_items").select("binary_stem", F.col("item_kind"), norm_id(F.col("item_id")).alias("ref_id"), F.col("recorded_at").alias("born"), "deleted_at")
    found = orphan_references(_chain_references(table(spark, d, "gt_chains")), items, ["binary_stem", "item_kind", "ref_id"], "recorded_at", "born", "deleted_at")
    return found.select("binary_stem", "chain_id", "ref_field", "ref_id", "reason", F.date_format("recorded_at", "yyyy-MM").alias("period_month"))


def p4_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per field, month and reason."""
    return p4_found(spark, d).groupBy("ref_field", "period_month", "reason").agg(F.count("*").alias("orphans"))


P4_SQL = r"""
WITH refs AS (
  SELECT DISTINCT binary_stem, chain_id, recorded_at, ref_field, kind, lower(trim(id)) ref_id FROM (
    SELECT binary_stem, chain_id, recorded_at, 'sink_id' ref_field, 'sink' kind, sink_id id FROM gt_chains
    UNION ALL SELECT binary_stem, chain_id, recorded_at, 'required_source_ids', 'source', unnest(required_source_ids) FROM gt_chains
    UNION ALL SELECT binary_stem, chain_id, recorded_at, 'required_object_ids', 'object', unnest(required_object_ids) FROM gt_chains
    UNION ALL SELECT binary_stem, chain_id, recorded_at, 'required_root_ids', 'root', unnest(required_root_ids) FROM gt_chains
  ) WHERE id IS NOT NULL AND trim(id) <> ''
), items AS (SELECT DISTINCT binary_stem, item_kind kind, lower(trim(item_id)) ref_id, recorded_at, deleted_at FROM gt_items),
judged AS (
  SELECT r.binary_stem, r.chain_id, r.ref_field, r.ref_id, r.recorded_at,
    count(i.ref_id) n, count(CASE WHEN i.recorded_at <= r.recorded_at THEN 1 END) born,
    count(CASE WHEN i.recorded_at <= r.recorded_at AND (i.deleted_at IS NULL OR i.deleted_at > r.recorded_at) THEN 1 END) held
  FROM refs r LEFT JOIN items i ON i.binary_stem = r.binary_stem AND i.kind = r.kind AND i.ref_id = r.ref_id GROUP BY ALL
)
SELECT binary_stem, chain_id, ref_field, ref_id, CASE WHEN n = 0 THEN 'missing' WHEN born = 0 THEN 'late' ELSE 'deleted' END reason, strftime(recorded_at, '%Y-%m') period_month FROM judged WHERE held = 0"""
P4_MONTH_SQL = f"SELECT ref_field, period_month, reason, count(*) orphans FROM ({P4_SQL}) GROUP BY ALL"
