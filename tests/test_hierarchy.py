import random

import pytest

from gneiss.operators import hierarchy as h

SCHEMA = "s string, c string, p string, extra int"


def brute(pairs):
    """Roots, depths and paths of (scope, child, parent) by walking up."""
    up, nodes = {}, set()
    for s, c, p in pairs:
        if None in (s, c, p):
            continue
        up[s, c] = min(p, up.get((s, c), p))
    for (s, c), p in up.items():
        nodes |= {(s, c), (s, p)}
    out = {}
    for s, n in nodes:
        way = [n]
        while (s, way[-1]) in up and up[s, way[-1]] not in way:
            way.append(up[s, way[-1]])
        if (s, way[-1]) in up:
            cycle = way[way.index(up[s, way[-1]]) :]
            out[s, n] = (min(cycle), None, True, None)
        else:
            out[s, n] = (way[-1], len(way) - 1, False, tuple(reversed(way)))
    return out


def run(spark, pairs, bound, paths=True):
    df = spark.createDataFrame([(*p, 1) for p in pairs], SCHEMA)
    rows = h.hierarchy(df, "s", "c", "p", paths, bound).collect()
    got = {(r.scope, r.node): (r.root, r.depth, r.in_cycle, tuple(r.path) if r.path else None) for r in rows}
    assert len(rows) == len(got)
    return got


def wild(seed, n, scopes=3, chain=False):
    rng = random.Random(seed)
    pairs = []
    for s in range(scopes):
        names = [f"n{i}" for i in rng.sample(range(10_000), n)]
        for i, c in enumerate(names):
            if chain:
                if i:
                    pairs.append((f"s{s}", c, names[i - 1]))
            elif rng.random() < 0.9:
                pairs.append((f"s{s}", c, rng.choice(names)))
    return pairs + pairs[:5] + [("s0", None, "x"), (None, "a", "b")]


@pytest.mark.parametrize("bound", [1_000_000, 25, 7])
def test_random_forests_with_cycles(spark, bound):
    pairs = wild(1, 60)
    assert run(spark, pairs, bound) == brute(pairs)


def test_one_long_chain_over_many_buckets(spark):
    pairs = wild(2, 150, 1, chain=True)
    assert run(spark, pairs, 10) == brute(pairs)


def test_doubling_alone_agrees(spark, monkeypatch):
    pairs = wild(3, 40, 2)
    real = h.resolve

    def doubled(links, paths=False, bound=h.BUCKET_LINKS, _depth=0):
        return h._doubled(links, paths)

    monkeypatch.setattr(h, "resolve", doubled)
    assert run(spark, pairs, 10) == brute(pairs)
    monkeypatch.setattr(h, "resolve", real)


def test_small_cases(spark):
    pairs = [("a", "x", "x"), ("a", "y", "x"), ("b", "x", "y"), ("b", "y", "z"), ("b", "y", "z"), ("c", "2", "10"), ("c", "10", "2"), ("d", "é", "z"), ("d", "z", "é"), ("e", "m", "q"), ("e", "m", "p")]
    assert run(spark, pairs, 100) == brute(pairs)
    empty = spark.createDataFrame([], SCHEMA)
    assert h.hierarchy(empty, "s", "c", "p").count() == 0
    assert h.hierarchy(spark.createDataFrame([(None, "a", "b", 1), ("s", None, "b", 1)], SCHEMA), "s", "c", "p").count() == 0


def test_clashing_names_and_descendants(spark):
    df = spark.createDataFrame([("s", "b", "a", "junk"), ("s", "c", "b", "junk"), ("s", "loop", "loop", "junk")], "scope string, node string, up string, root string")
    tree = h.hierarchy(df, "scope", "node", "up", True)
    below = {(r.node, r.descendant, r.distance) for r in h.descendants(tree).collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
