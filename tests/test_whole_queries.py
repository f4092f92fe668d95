"""Queries within the reference's own bounds, against plain searches of small graphs."""

import os

import pytest

import __spark_entry__ as entry
from gneiss.plans import graph_queries as q
from tests.oracle import differing
from tests.test_graph import dfs_cycles, make

MORE = "/root/testdata/sf0.01"


def test_cycles_of_more_than_six_edges_and_past_the_tenth(spark, monkeypatch):
    ring = [("s0", f"r{i}", "CALLS", f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    pairs = [("s0", f"{k}{i:02d}", "CALLS", *((f"p{i:02d}", f"q{i:02d}")[:: 1 if k == "a" else -1])) for i in range(12) for k in "ab"]
    monkeypatch.setattr(q.model, "stored_edges", lambda *_: make(spark, ring + pairs))
    want = dfs_cycles(ring + pairs, 12)
    got = q.cycles_d12(spark, "").collect()
    assert {(r.nodes, r.edges) for r in got} == {(">".join(n), ">".join(e)) for n, e in want} and len(want) == 13 and not any(r.truncated for r in got)
    assert {r.node: r.cycles for r in q.cycle_participation(spark, "").collect()} == {n: 1 for e in ring + pairs for n in e[3:5]}
    assert {(r.nodes, r.edges) for r in q.cycles(spark, "").collect()} == {(r.nodes, r.edges) for r in got}


@pytest.mark.skipif(not os.path.isdir(MORE), reason="no test data")
@pytest.mark.parametrize("name", ["cycles", "cycles_d12", "cycle_participation"])
def test_longer_cycles_equal_their_sql_on_more_data(spark, name):
    assert differing(spark, entry.queries()[name], entry.oracle_sql()[name], MORE) == ([], [])


def test_every_node_is_a_start(spark, monkeypatch):
    line = [("s0", f"e{i}", "CALLS", f"method{i}", f"method{i + 1}") for i in range(3)]
    nodes = [("s0", f"method{i}", "Method") for i in range(4)]
    monkeypatch.setattr(q.model, "stored_edges", lambda *_: make(spark, line))
    monkeypatch.setattr(q.model, "stored_nodes", lambda *_: spark.createDataFrame(nodes, "snapshotStableKey string, stableKey string, nodeKind string"))
    assert q.transitive_dependencies_d3(spark, "").count() == 0
    assert {(r.start, r.edge, r.depth) for r in q.transitive_dependencies_d3_every_node(spark, "").collect()} == {(f"method{i}", f"e{j}", j - i) for i in range(3) for j in range(i, 3)}
    assert {(r.start, r.edge) for r in q.direct_dependents_every_node(spark, "").collect()} == {(f"method{i + 1}", f"e{i}") for i in range(3)}


def test_dependents_up_to_a_hundred_edges_and_the_flag_beyond(spark, monkeypatch):
    star = [("s0", f"e{i:03d}", "CALLS", f"m{i:03d}", hub) for hub, n in (("hub60", range(60)), ("hub120", range(60, 180))) for i in n]
    nodes = [("s0", x, "Type") for x in ("hub60", "hub120")]
    monkeypatch.setattr(q.model, "stored_edges", lambda *_: make(spark, star))
    monkeypatch.setattr(q.model, "stored_nodes", lambda *_: spark.createDataFrame(nodes, "snapshotStableKey string, stableKey string, nodeKind string"))
    rows = q.transitive_dependents_d6_every_node(spark, "").collect()
    assert sorted((r.start, r.truncated) for r in rows) == [("hub120", True)] * 100 + [("hub60", False)] * 60
