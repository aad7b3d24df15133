"""The entity tables hold the places that p2_found lists, and all their scalars."""

import json

import pytest

from siltstone.plans import problems, registry

TABLES = {"object_node": "object_nodes", "channel_edge": "channel_edges", "writer_site": "sites", "reader_site": "reader_sites", "member": "members", "edge_constraint": "edge_constraints", "type_fact": "type_facts", "object_hit": "object_hits", "producer_candidate": "producer_candidates", "bridge_function": "bridge_functions"}


@pytest.fixture
def tables(spark, monkeypatch):
    nodes = [None, {"object_id": "o", "region_kind": "R", "notes": "n", "confidence": 0.50, "addr_range": ["0x1", "0x2"], "producer_contexts": ["MAIN", "ISR", "MAIN"], "members": ["m"], "type_facts": {"k": {"l": 2}}, "reader_sites": [{"context": "ISR", "fn": "f", "fn_addr": "0x3", "site_addr": "0x4", "access_kind": "load", "target_addr": None}]}, {"object_id": "p"}]
    edges = [{"object_id": "o", "src_context": "ISR", "dst_context": "MAIN", "edge_kind": "DATA", "score": 0.9, "ambiguity_penalty": 0.1, "object_quality": 0.7, "constraints": ["c", None]}]
    hits = {"object_hits": ["a", {"object_id": "b", "quality": 0.25}, None], "producer_candidates": ["q"], "bridge_functions": "g"}
    frames = {"channel_graph": spark.createDataFrame([(None, json.dumps(nodes), json.dumps(edges))], "graph_id string, object_nodes string, channel_edges string"), "chains": spark.createDataFrame([("c", json.dumps(hits))], "chain_id string, link_debug string")}
    monkeypatch.setattr(problems, "table", lambda s, d, n: frames[n])
    return lambda name: [tuple(r)[2:] for r in registry.queries()[f"p2_{name}"](spark, "").orderBy("parent_no", "child_no" if name != "type_facts" else "trail").collect()]


def test_columns_of_all_entities(tables):
    assert tables("object_nodes") == [(0, 1, "o", "R", "0.5", "n", "0x1", "0x2", "MAIN,ISR,MAIN", ""), (0, 2, "p", None, None, None, None, None, None, None)]
    assert tables("reader_sites") == [(1, 0, "ISR", "f", "0x3", "0x4", "load", None)]
    assert tables("channel_edges") == [(0, 0, "o", "ISR", "MAIN", "DATA", "0.9", "0.1", "0.7")]
    assert tables("object_hits") == [(0, 0, "a", None), (0, 1, "b", "0.25")]
    assert tables("members") == [(1, 0, "m")] and tables("edge_constraints") == [(0, 0, "c")] and tables("type_facts") == [(1, "k.l", "2")]
    assert tables("producer_candidates") == [(0, 0, "q")] and tables("bridge_functions") == [(0, 0, "g")]


def test_places_of_found(spark, data):
    found = problems.p2_found(spark, data).distinct()
    for name, query in TABLES.items():
        place = ["record_id", "parent_no", *(["child_key"] if name == "type_fact" else ["child_no"])]
        want = found.filter(f"child_table = '{name}'").select(*place).distinct()
        got = registry.queries()[f"p2_{query}"](spark, data).withColumnRenamed("trail", "child_key").select(*place).distinct()
        rows = sorted(map(str, got.collect()))
        assert rows and rows == sorted(map(str, want.collect())), name
