import random
from collections import deque

import pandas as pd
import pytest

from gneiss.operators import graph as g
from gneiss.operators import walks

EDGE = "snapshotStableKey string, stableKey string, edgeKind string, source string, target string, evidenceStableKeys array<string>, confidence double"


def make(spark, edges):
    return spark.createDataFrame([(s, k, kind, a, b, [f"ev-{k}", None], 0.5) for s, k, kind, a, b in edges], EDGE)


def random_edges(seed, nodes=7, count=14, scopes=2):
    rng = random.Random(seed)
    return [(f"s{s}", f"e{s}-{i:02d}", rng.choice(["REFERENCES", "CALLS", "CONTAINS"]), f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for s in range(scopes) for i in range(count)]


def bfs_path(edges, source, target, depth):
    out = {}
    for s, k, kind, a, b in sorted(edges, key=lambda e: e[1]):
        out.setdefault(a, []).append((k, b))
    queue, seen = deque([(source, [source], [])]), {source}
    while queue:
        here, ns, es = queue.popleft()
        if len(es) == depth:
            continue
        for k, b in out.get(here, []):
            if b == target:
                return ns + [b], es + [k]
            if b not in seen:
                seen.add(b)
                queue.append((b, ns + [b], es + [k]))
    return None


@pytest.mark.parametrize(("seed", "task"), [(1, 10_000), (2, 0)])
def test_shortest_paths_by_a_plain_walk(spark, seed, task):
    edges = random_edges(seed)
    names = sorted({e[3] for e in edges} | {e[4] for e in edges})
    wanted = [(s, a, b) for s in ("s0", "s1") for a in names for b in names] + [("empty", "a", "b")]
    df = g.shortest_paths(make(spark, edges), spark.createDataFrame(wanted, "snapshotStableKey string, source string, target string"), task_edges=task)
    rows = df.collect()
    assert len(rows) == len(wanted)
    for r in rows:
        followed = [e for e in edges if e[0] == r.snapshotStableKey and e[2] != "CONTAINS"]
        path = bfs_path(followed, r.source, r.target, 6)
        if not followed:
            assert r.state == "unavailable"
        elif path is None:
            assert r.state == "notFound" and r.nodes is None and r.hops is None
        else:
            assert (r.state, list(r.nodes), list(r.edges), r.hops) == ("found", path[0], path[1], len(path[1]))


def dfs_cycles(edges, depth):
    out = {}
    for s, k, kind, a, b in edges:
        out.setdefault(a, []).append((k, b))
    found = set()

    def walk(start, here, ns, es):
        for k, b in out.get(here, []):
            if b < start:
                continue
            if b == start and es:
                if len(es) < depth:
                    found.add((tuple(ns + [b]), tuple(es + [k])))
            elif (b not in ns or b == start and not es) and len(es) + 1 < depth:
                walk(start, b, ns + [b], es + [k])

    for n in out:
        walk(n, n, [n], [])
    return found


@pytest.mark.parametrize(("seed", "task"), [(3, 10_000), (4, 10_000), (4, 0)])
def test_cycles_by_a_plain_search(spark, seed, task):
    edges = random_edges(seed, 5, 11, 1) + [("s0", "loop", "CALLS", "n0", "n0"), ("s0", "p1", "CALLS", "n0", "n1"), ("s0", "p2", "CALLS", "n0", "n1")]
    rows = g.simple_cycles(make(spark, edges), 5, 500, task).collect()
    assert {(tuple(r.nodes), tuple(r.edges)) for r in rows} == dfs_cycles(edges, 5)
    assert not any(r.truncated for r in rows) and all(r.confidence == 0.5 and list(r.evidence) == sorted({f"ev-{e}" for e in r.edges}) for r in rows)


@pytest.mark.parametrize("seed", range(30))
def test_cycles_of_a_task_are_whole_and_in_order(seed):
    rng = random.Random(seed)
    names = ["n", "n1", "n1a", "n-", "n>", "na"][: 5 if seed % 2 else 6]
    edges = [("s", f"e{i}", "CALLS", rng.choice(names), rng.choice(names)) for i in range(12)]
    ways = pd.DataFrame([(s, k, a, b) for s, k, _, a, b in edges], columns=["snapshotStableKey", "edge", "here", "there"])
    got = [(tuple(r.nodes), tuple(r.edges)) for r in walks.cycles(ways, 4, 10**6).itertuples()]
    want = sorted(dfs_cycles(edges, 4), key=lambda c: (">".join(c[0]), ">".join(c[1])))
    assert got == want
    assert [(tuple(r.nodes), tuple(r.edges)) for r in walks.cycles(ways, 4, 3).itertuples()] == want[:3]


def test_reach_of_a_task_equals_that_by_rounds(spark):
    edges = make(spark, random_edges(6, 9, 20) + [("t", f"l{i}", "CALLS", f"m{i:02d}", f"m{i + 1:02d}") for i in range(15)])
    for depth in (1, 2, 12):
        assert sorted(g.reach(edges, depth).collect()) == sorted(g.reach(edges, depth, 0).collect())


def test_loop_quirk_and_limit(spark):
    edges = make(spark, [("s", "ab", "CALLS", "A", "B"), ("s", "ba", "CALLS", "B", "A"), ("s", "aa", "CALLS", "A", "A"), ("s", "bb", "CALLS", "B", "B")])
    got = {tuple(r.nodes) for r in g.simple_cycles(edges, 12, 100).collect()}
    assert got == {("A", "A", "A"), ("A", "A", "B", "A"), ("A", "B", "A"), ("B", "B", "B")}
    cut = g.simple_cycles(edges, 12, 2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)
    part = {(r.node, r.cycles) for r in g.cycle_participation(g.simple_cycles(edges, 12, 100)).collect()}
    assert part == {("A", 3), ("B", 3)}


def test_reach_counts_a_way_back_and_marks_truncation(spark):
    ring = [("s", f"e{i}", "CALLS", f"n{i}", f"n{(i + 1) % 3}") for i in range(3)]
    line = [("t", f"l{i}", "CALLS", f"m{i:02d}", f"m{i + 1:02d}") for i in range(15)]
    got = {(r.snapshotStableKey, r.node): (r.depth, r.reached, r.truncated) for r in g.reach(make(spark, ring + line)).collect()}
    assert got["s", "n0"] == (3, 3, False)
    assert got["t", "m00"] == (12, 12, True) and got["t", "m03"] == (12, 12, False) and got["t", "m14"] == (1, 1, False)


def test_traversal_limits_and_errors(spark):
    edges = make(spark, [("s", f"e{i}", "CALLS", "a", f"b{i}") for i in range(5)] + [("s", "z", "CONTAINS", "a", "c")])
    starts = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "nowhere")], "snapshotStableKey string, start string")
    rows = g.traverse(edges, starts, "Outgoing", 2, take=3).collect()
    assert [(r.edge, r.truncated) for r in sorted(rows, key=lambda r: r.position)] == [("e0", True), ("e1", True), ("e2", True)]
    assert g.traverse(edges, starts, "Outgoing", 1, kinds=None).count() == 6
    for bad in ({"max_depth": 7}, {"max_depth": 0}, {"take": 501}, {"direction": "Sideways"}):
        with pytest.raises(ValueError):
            g.traverse(edges, starts, **bad).count()


def test_empty_edges(spark):
    none = make(spark, [])
    starts = spark.createDataFrame([("s", "a")], "snapshotStableKey string, start string")
    assert g.traverse(none, starts).count() == 0 and g.reach(none).count() == 0 and g.simple_cycles(none).count() == 0
