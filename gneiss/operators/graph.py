"""Traversals, paths, reach and cycles over edges (scope, stableKey, edgeKind, source, target).

All of them run for many scopes and start nodes at once. Paths, reach and cycles of a scope of up to TASK_EDGES edges are found within one
task, which holds that scope and no more. Larger scopes, and traversals, go by rounds: a round is one join of the frontier with the
edges. Rounds are bounded by the depth asked for, and the frontier is written out between rounds. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import walks
from gneiss.work import staged

SNAP = "snapshotStableKey"
# Kinds that a traversal follows unless told otherwise.
TRAVERSED = ("REFERENCES", "USES_PACKAGE", "DEPENDS_ON", "CALLS_EXTERNAL_SERVICE", "CALLS_API", "USES_DB_CONTEXT", "USES_LINQ_TO_SQL_CONTEXT", "READS_TABLE", "WRITES_TABLE", "CALLS_STORED_PROCEDURE", "EXECUTES_RAW_SQL", "INJECTS", "CALLS")
MAX_TRAVERSAL_DEPTH, MAX_TAKE = 6, 500
MAX_REACH_DEPTH = 12
#: Edges of a scope up to which one task walks it.
TASK_EDGES = 50_000


def _by_size(steps: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of scopes of up to ``bound`` edges, and those of larger scopes if there are any; of the latter there is one for each ``bound`` edges at most."""
    large = staged(steps.groupBy(SNAP).count().filter(F.col("count") > bound).select(SNAP), "large-scopes")
    if large.isEmpty():
        return steps, None
    return steps.join(large, SNAP, "left_anti"), steps.join(large, SNAP, "left_semi")


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as steps (scope, edge, here, there). Both directions give a loop on one node once."""
    out = edges.select(SNAP, F.col("stableKey").alias("edge"), F.col("source").alias("here"), F.col("target").alias("there"))
    back = edges.select(SNAP, F.col("stableKey").alias("edge"), F.col("target").alias("here"), F.col("source").alias("there"))
    if direction == "Outgoing":
        return out
    if direction == "Incoming":
        return back
    if direction != "Both":
        raise ValueError("DirectionInvalid")
    return out.unionByName(back.filter(F.col("here") != F.col("there")))


def traverse(edges: DataFrame, starts: DataFrame, direction: str = "Outgoing", max_depth: int = 3, kinds: Sequence[str] | None = TRAVERSED, take: int = 100) -> DataFrame:
    """Edges around each start of ``starts`` (scope, start): (scope, start, edge, depth, position, truncated).

    An edge belongs to the result if it touches, in the direction asked for, a node fewer than ``max_depth`` steps from the start;
    ``depth`` is that of the nearest such node. Edges are in key order; with more than ``take`` of them all rows say truncated.
    """
    if not 1 <= max_depth <= MAX_TRAVERSAL_DEPTH:
        raise ValueError("DepthInvalid")
    if not 1 <= take <= MAX_TAKE:
        raise ValueError("TakeInvalid")
    followed = edges if kinds is None else edges.filter(F.col("edgeKind").isin(*kinds))
    steps = staged(oriented(followed, direction), "traverse-steps")
    seen = staged(starts.select(SNAP, "start", F.col("start").alias("here"), F.lit(0).alias("depth")).distinct(), "traverse-seen")
    frontier = seen
    for depth in range(1, max_depth):
        reached = frontier.drop("depth").join(steps, [SNAP, "here"]).select(SNAP, "start", F.col("there").alias("here")).distinct()
        frontier = staged(reached.join(seen, [SNAP, "start", "here"], "left_anti").withColumn("depth", F.lit(depth)), "traverse-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = seen.join(steps, [SNAP, "here"]).groupBy(SNAP, "start", "edge").agg(F.min("depth").alias("depth"))
    by_start = Window.partitionBy(SNAP, "start")
    found = found.withColumn("position", F.row_number().over(by_start.orderBy("edge"))).withColumn("truncated", F.count("*").over(by_start) > take)
    return found.filter(F.col("position") <= take)


def traversal_nodes(result: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that a traversal shows: each start and the ends of its edges, as far as they exist: (scope, start, node)."""
    ends = result.join(edges.select(SNAP, F.col("stableKey").alias("edge"), "source", "target"), [SNAP, "edge"]).select(SNAP, "start", F.explode(F.array("source", "target")).alias("node"))
    shown = ends.unionByName(result.select(SNAP, "start", F.col("start").alias("node"))).distinct()
    return shown.join(nodes.select(SNAP, F.col("stableKey").alias("node")), [SNAP, "node"], "left_semi")


def shortest_paths(edges: DataFrame, wanted: DataFrame, max_depth: int = MAX_TRAVERSAL_DEPTH, kinds: Sequence[str] | None = TRAVERSED, task_edges: int = TASK_EDGES) -> DataFrame:
    """For each (scope, source, target) of ``wanted``: (…, state, hops, nodes, edges).

    The path has the fewest hops; of several the one that a breadth-first walk in edge-key order meets first. A target equal to its
    source asks for the shortest way back to it. ``state`` is ``found``, ``notFound`` or, where the scope has no edges that count, ``unavailable``.
    """
    followed = edges if kinds is None else edges.filter(F.col("edgeKind").isin(*kinds))
    steps = staged(followed.select(SNAP, F.col("stableKey").alias("edge"), F.col("source").alias("here"), F.col("target").alias("there")), "paths-steps")
    asked = staged(wanted.select(SNAP, F.col("source").alias("from"), F.col("target").alias("to")).distinct(), "paths-wanted")
    small, large = _by_size(steps, task_edges)
    pairs = asked if large is None else asked.join(large.select(SNAP).distinct(), SNAP, "left_anti")

    def walk(ends: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        return walks.shortest(ends, ways, max_depth)

    found = pairs.groupBy(SNAP).cogroup(small.groupBy(SNAP)).applyInPandas(walk, f"{SNAP} string, `from` string, `to` string, nodes array<string>, edges array<string>")
    if large is not None:
        found = found.unionByName(_paths_by_rounds(large, asked.join(large.select(SNAP).distinct(), SNAP, "left_semi"), max_depth))
    has = steps.select(SNAP).distinct().withColumn("__has", F.lit(True))
    answer = asked.join(found.select(SNAP, "from", "to", "nodes", "edges"), [SNAP, "from", "to"], "left").join(has, SNAP, "left")
    state = F.when(F.col("edges").isNotNull(), "found").when(F.col("__has"), "notFound").otherwise("unavailable")
    return answer.select(SNAP, F.col("from").alias("source"), F.col("to").alias("target"), state.alias("state"), F.when(F.col("edges").isNotNull(), F.size("edges")).alias("hops"), "nodes", "edges")


def _paths_by_rounds(steps: DataFrame, asked: DataFrame, max_depth: int) -> DataFrame:
    """Paths by joins: a row for each node reached holds its place in the queue of its round, and the way there."""
    frontier = asked.select(SNAP, "from", "to", F.col("from").alias("here"), F.lit(1).alias("place"), F.array("from").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    seen = frontier.select(SNAP, "from", "to", "here")
    found = None
    for _ in range(max_depth):
        moved = frontier.join(steps, [SNAP, "here"])
        first = Window.partitionBy(SNAP, "from", "to", "there").orderBy("place", "edge")
        moved = moved.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(
            SNAP, "from", "to", F.col("there").alias("here"), F.struct("place", "edge").alias("queue"), F.concat("nodes", F.array("there")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges")
        )
        moved = staged(moved, "paths-moved")
        hit = moved.filter(F.col("here") == F.col("to"))
        found = hit if found is None else found.unionByName(hit)
        open_ = moved.join(hit.select(SNAP, "from", "to"), [SNAP, "from", "to"], "left_anti").join(seen, [SNAP, "from", "to", "here"], "left_anti")
        order = Window.partitionBy(SNAP, "from", "to").orderBy("queue")
        frontier = staged(open_.withColumn("place", F.row_number().over(order)).drop("queue"), "paths-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(SNAP, "from", "to", "here"))
    return found.select(SNAP, "from", "to", "nodes", "edges")


def reach(edges: DataFrame, max_depth: int = MAX_REACH_DEPTH, task_edges: int = TASK_EDGES // 4) -> DataFrame:
    """For every node with an outgoing edge: (scope, node, depth, reached, truncated).

    ``depth`` is the greatest distance of a node reached within ``max_depth`` steps and ``reached`` their number. The start itself is not
    counted as visited from the outset, so a way back to it counts. ``truncated``: a node at the last depth has an edge further on.
    """
    steps = staged(edges.select(SNAP, F.col("source").alias("here"), F.col("target").alias("there")).distinct(), "reach-steps")
    small, large = _by_size(steps, task_edges)
    found = small.groupBy(SNAP).applyInPandas(lambda ways: walks.reached(ways, max_depth), f"{SNAP} string, node string, depth bigint, reached bigint, truncated boolean")
    return found if large is None else found.unionByName(_reach_by_rounds(large, max_depth))


def _reach_by_rounds(steps: DataFrame, max_depth: int) -> DataFrame:
    frontier = staged(steps.select(SNAP, F.col("here").alias("node"), F.col("there").alias("here"), F.lit(1).alias("depth")).distinct(), "reach-frontier")
    seen = frontier
    for depth in range(2, max_depth + 1):
        moved = frontier.select(SNAP, "node", "here").join(steps, [SNAP, "here"]).select(SNAP, "node", F.col("there").alias("here")).distinct()
        frontier = staged(moved.join(seen, [SNAP, "node", "here"], "left_anti").withColumn("depth", F.lit(depth)), "reach-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    further = steps.select(SNAP, "here").distinct().withColumn("__on", F.lit(True))
    ends = seen.join(further, [SNAP, "here"], "left")
    return ends.groupBy(SNAP, "node").agg(F.max("depth").cast("long").alias("depth"), F.count("*").alias("reached"), F.coalesce(F.bool_or((F.col("depth") == max_depth) & F.col("__on")), F.lit(False)).alias("truncated"))


def cyclic_core(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Edges that may lie on a cycle: nodes without a way in or out are taken away again and again, up to ``rounds`` times."""
    core = staged(edges, "core")
    n = core.count()
    for _ in range(rounds):
        both = core.join(core.select(SNAP, F.col("target").alias("source")).distinct(), [SNAP, "source"], "left_semi")
        core = staged(both.join(both.select(SNAP, F.col("source").alias("target")).distinct(), [SNAP, "target"], "left_semi"), "core")
        left = core.count()
        if left == n:
            break
        n = left
    return core


def simple_cycles(edges: DataFrame, max_depth: int = 12, limit: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """Cycles of each scope: (scope, nodes, edges, evidence, confidence, cycle_key, position, truncated).

    A cycle starts at its least node (binary order) and has at most ``max_depth`` edges, within 2 to 64; parallel edges give cycles of
    their own. A loop on one node is taken only while a way is open: as the first step from the start, which then stands twice in a row.
    Cycles are ordered by their nodes, then edges; each scope shows at most ``limit`` (1 to 500), and says if that leaves some out. A
    task looks for the cycles of its scope in that order and stops after the first that is left out.
    """
    max_depth, limit = min(64, max(2, max_depth)), min(500, max(1, limit))
    steps = staged(edges.select(SNAP, F.col("stableKey").alias("edge"), F.col("source").alias("here"), F.col("target").alias("there"), "evidenceStableKeys", "confidence"), "cycles-steps")
    small, large = _by_size(steps, task_edges)
    found = small.select(SNAP, "edge", "here", "there").groupBy(SNAP).applyInPandas(lambda ways: walks.cycles(ways, max_depth, limit + 1), f"{SNAP} string, nodes array<string>, edges array<string>")
    if large is not None:
        found = found.unionByName(_cycles_by_rounds(large, max_depth))
    text_n, text_e = F.array_join("nodes", ">"), F.array_join("edges", ">")
    order = Window.partitionBy(SNAP).orderBy("text_n", "text_e")
    placed = found.withColumns({"text_n": text_n, "text_e": text_e}).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit + 1)
    placed = staged(placed, "cycles-shown")
    more = placed.filter(F.col("position") > limit).select(SNAP, F.lit(True).alias("more"))
    shown = placed.filter(F.col("position") <= limit)
    parts = shown.select(SNAP, "position", F.explode("edges").alias("edge")).join(steps.select(SNAP, "edge", "evidenceStableKeys", "confidence"), [SNAP, "edge"])
    rolled = parts.groupBy(SNAP, "position").agg(
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.coalesce("evidenceStableKeys", F.array().cast("array<string>"))))))).alias("evidence"), F.min("confidence").alias("confidence")
    )
    key = F.concat(F.lit("cycle://"), F.col(SNAP), F.lit("/"), F.sha2(F.concat("text_n", F.lit("|"), "text_e"), 256))
    out = shown.join(rolled, [SNAP, "position"]).join(more, SNAP, "left")
    return out.select(SNAP, "nodes", "edges", "evidence", "confidence", key.alias("cycle_key"), "position", F.coalesce("more", F.lit(False)).alias("truncated"))


def _cycles_by_rounds(edges: DataFrame, max_depth: int) -> DataFrame:
    """All cycles of large scopes: edges that can be on none are taken away, and ways are made longer by a join for each step."""
    core = cyclic_core(edges.select(SNAP, F.col("edge").alias("stableKey"), F.col("here").alias("source"), F.col("there").alias("target")))
    steps = staged(core.select(SNAP, F.col("stableKey").alias("edge"), F.col("source").alias("here"), F.col("target").alias("there")), "cycles-steps")
    ways = steps.filter(F.col("there") >= F.col("here")).select(SNAP, F.col("here").alias("start"), F.col("there").alias("here"), F.array("here", "there").alias("nodes"), F.array("edge").alias("edges"))
    ways = staged(ways, "cycles-ways")
    found = None
    for length in range(2, max_depth + 1):
        moved = ways.join(steps, [SNAP, "here"]).filter(F.col("there") >= F.col("start"))
        closed = moved.filter(F.col("there") == F.col("start")).select(SNAP, F.concat("nodes", F.array("there")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
        closed = staged(closed, "cycles-closed")
        found = closed if found is None else found.unionByName(closed)
        if length == max_depth:
            break
        on = moved.filter((F.col("there") != F.col("start")) & ~F.array_contains("nodes", F.col("there")))
        ways = staged(on.select(SNAP, "start", F.col("there").alias("here"), F.concat("nodes", F.array("there")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges")), "cycles-ways")
        if ways.isEmpty():
            break
    return found


def cycle_participation(cycles: DataFrame) -> DataFrame:
    """How many of the cycles shown a node lies on: (scope, node, cycles)."""
    members = cycles.select(SNAP, "cycle_key", F.explode(F.array_distinct("nodes")).alias("node"))
    return members.groupBy(SNAP, "node").agg(F.count("*").alias("cycles"))


def impact(edges: DataFrame, starts: DataFrame, max_depth: int = 3, take: int = 100) -> DataFrame:
    """Who is touched by a change of each start: the incoming traversal with (…, impact_depth, confidence), where the depth is 1 for edges that end at the start and else 2, and the confidence the least of the start's edges."""
    found = traverse(edges, starts, "Incoming", max_depth, TRAVERSED, take)
    named = found.join(edges.select(SNAP, F.col("stableKey").alias("edge"), "source", "target", "confidence"), [SNAP, "edge"])
    return named.select(SNAP, "start", "edge", "source", F.when(F.col("target") == F.col("start"), 1).otherwise(2).alias("impact_depth"), F.min("confidence").over(Window.partitionBy(SNAP, "start")).alias("confidence"), "truncated")
