"""Walks over the edges of one scope, held by one task: shortest paths, reach and cycles.

Edges come as a frame with the columns edge, here and there, beside that of the scope.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice, product

import pandas as pd

SNAP = "snapshotStableKey"


def shortest(asked: pd.DataFrame, ways: pd.DataFrame, max_depth: int) -> pd.DataFrame:
    """For each (from, to) that is reached within ``max_depth`` edges the path that a breadth-first walk in edge-key order meets first: (scope, from, to, nodes, edges)."""
    rows = []
    if len(asked) and len(ways):
        scope = asked[SNAP].iloc[0]
        out: dict[str, list[tuple[str, str]]] = {}
        for edge, here, there in sorted(zip(ways["edge"], ways["here"], ways["there"])):
            out.setdefault(here, []).append((edge, there))
        for start, ends in asked.groupby("from")["to"]:
            came = _walk(out, start, max_depth)
            for end in ends:
                if end in came:
                    nodes, edges, at = [end], [], end
                    while True:
                        edge, at = came[at]
                        nodes.append(at)
                        edges.append(edge)
                        if at == start:
                            break
                    rows.append((scope, start, end, nodes[::-1], edges[::-1]))
    return pd.DataFrame(rows, columns=[SNAP, "from", "to", "nodes", "edges"])


def _walk(out: dict[str, list[tuple[str, str]]], start: str, max_depth: int) -> dict[str, tuple[str, str]]:
    """For each node reached the edge and the node it was first reached by; the start too, where a way leads back."""
    came: dict[str, tuple[str, str]] = {}
    queue = deque([(start, 0)])
    while queue:
        here, depth = queue.popleft()
        if depth == max_depth:
            break
        for edge, there in out.get(here, ()):
            if there not in came:
                came[there] = (edge, here)
                if there != start:
                    queue.append((there, depth + 1))
    return came


def reached(ways: pd.DataFrame, max_depth: int) -> pd.DataFrame:
    """(scope, node, depth, reached, truncated) of every node with an outgoing edge, by sets of bits that grow with each step."""
    number: dict[str, int] = {}
    out: dict[int, set[int]] = {}
    for here, there in zip(ways["here"], ways["there"]):
        out.setdefault(number.setdefault(here, len(number)), set()).add(number.setdefault(there, len(number)))
    further = sum(1 << n for n in out)
    near = {n: sum(1 << c for c in children) for n, children in out.items()}
    sets, depths, edge = dict(near), dict.fromkeys(out, 1), dict(near)
    grew = set(out)
    for depth in range(2, max_depth + 1):
        before, now = sets, {}
        for n, children in out.items():
            if grew.isdisjoint(children):
                continue
            bits = near[n]
            for c in children:
                bits |= before.get(c, 0)
            if bits != before[n]:
                now[n] = bits
        if not now:
            break
        for n, bits in now.items():
            depths[n], edge[n] = depth, bits & ~before[n]
        sets, grew = before | now, set(now)
    names = list(number)
    scope = ways[SNAP].iloc[0] if len(ways) else None
    rows = [(scope, names[n], depths[n], sets[n].bit_count(), depths[n] == max_depth and bool(edge[n] & further)) for n in out]
    return pd.DataFrame(rows, columns=[SNAP, "node", "depth", "reached", "truncated"])


def cycles(ways: pd.DataFrame, max_depth: int, most: int) -> pd.DataFrame:
    """The first ``most`` cycles of a scope, ordered by the text of their nodes, then of their edges: (scope, nodes, edges)."""
    links: dict[str, dict[str, list[str]]] = {}
    for edge, here, there in zip(ways["edge"], ways["here"], ways["there"]):
        links.setdefault(here, {}).setdefault(there, []).append(edge)
    rows = list(islice(_in_order(links, max_depth), most))
    scope = ways[SNAP].iloc[0] if len(ways) else None
    return pd.DataFrame([(scope, n, e) for n, e in rows], columns=[SNAP, "nodes", "edges"])


def _in_order(links: dict[str, dict[str, list[str]]], max_depth: int) -> Iterator[tuple[list[str], list[str]]]:
    # the text of a way goes on with a mark after each node but the last; where a name holds that mark itself, texts are put in order at the end
    marked = any(">" in n for n in links)
    found = []
    back: dict[str, list[str]] = {}
    for here, targets in links.items():
        for there in targets:
            back.setdefault(there, []).append(here)
    for start in sorted(links, key=lambda n: n + ">"):
        home = _distances(back, start, max_depth)
        for nodes in _from(links, start, home, max_depth):
            choices = [sorted(links[a][b], key=lambda e: e + ">") for a, b in zip(nodes, nodes[1:])]
            choices[-1] = sorted(choices[-1])
            for edges in product(*choices):
                if marked:
                    found.append((nodes, list(edges)))
                else:
                    yield nodes, list(edges)
    yield from sorted(found, key=lambda x: (">".join(x[0]), ">".join(x[1])))


def _distances(back: dict[str, list[str]], start: str, max_depth: int) -> dict[str, int]:
    """How many edges lead from each node back to the start, over nodes that are not less."""
    home, queue = {start: 0}, deque([start])
    while queue:
        here = queue.popleft()
        if home[here] + 1 >= max_depth:
            continue
        for there in back.get(here, ()):
            if there > start and there not in home:
                home[there] = home[here] + 1
                queue.append(there)
    return home


def _from(links: dict[str, dict[str, list[str]]], start: str, home: dict[str, int], max_depth: int) -> Iterator[list[str]]:
    """The nodes of the cycles from a start, in the order of their text; ways that cannot come home in time are not gone."""

    def steps(here: str, length: int) -> list[str]:
        on = [n for n in links.get(here, ()) if n in home and length + 1 + home[n] <= max_depth and (n != start or length)]
        # the node that closes a cycle ends its text, so no mark follows it
        return sorted(on, key=lambda n: n if n == start else n + ">", reverse=True)

    first = steps(start, 0)
    if start in links.get(start, ()) and max_depth >= 2:  # a loop on the start is gone once, as the first step
        first = sorted([*first, start], key=lambda n: n + ">", reverse=True)
    way, inside = [start], {start}
    open_ = [first]
    while open_:
        if not open_[-1]:
            open_.pop()
            left = way.pop()
            if left != start or len(way) == 0:
                inside.discard(left)
            continue
        there = open_[-1].pop()
        length = len(way) - 1
        if there == start and length > 0:
            yield [*way, there]
        elif there == start or there not in inside:
            way.append(there)
            inside.add(there)
            open_.append(steps(there, length + 1))
