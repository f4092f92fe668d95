"""Parent-child links to full hierarchies.

Each node has at most one container in its scope. Links are spread over buckets of bounded size; a weighted disjoint-set forest in
each bucket gives every node its local root and the distance to it. Scopes that needed several buckets are merged level by level:
the links between local trees are links again, with weights, and go through the same step until a scope fits one bucket. Where a
level does not contract (one chain of millions of links), distance doubling takes over. Each task holds one bucket at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.work import staged

#: Links that one task holds at once.
BUCKET_LINKS = 50_000

_ENTRY = "scope string, node string, up string, dist bigint, least string, cyclic string, path array<string>"


class WeightedForest:
    """Disjoint sets whose members know their distance to the root; a link that would close a cycle labels the set instead."""

    def __init__(self) -> None:
        self.place: dict = {}
        self.keys: list = []
        self.up: list[int] = []
        self.dist: list[int] = []
        self.link: dict[int, tuple[int, int, str, list]] = {}
        self.cycle: dict[int, str] = {}

    def add(self, key) -> int:
        at = self.place.get(key)
        if at is None:
            at = self.place[key] = len(self.keys)
            self.keys.append(key)
            self.up.append(at)
            self.dist.append(0)
        return at

    def find(self, at: int) -> tuple[int, int]:
        """Root and distance of a member; compresses the way."""
        way = []
        while self.up[at] != at:
            way.append(at)
            at = self.up[at]
        total = 0
        for x in reversed(way):
            total += self.dist[x]
            self.up[x], self.dist[x] = at, total
        return at, total

    def unite(self, child, parent, weight: int, least: str, path: list) -> None:
        c, p = self.add(child), self.add(parent)
        if c in self.link:
            return
        self.link[c] = (p, weight, least, path)
        root, _ = self.find(p)
        if root == c:
            smallest, x = least, p
            while x != c:
                smallest = min(smallest, self.link[x][2])
                x = self.link[x][0]
            self.cycle[c] = smallest
        else:
            self.up[c], self.dist[c] = p, weight


def _bytes(key: str) -> bytes:
    return key.encode("utf-8", "surrogatepass")


def _text(key: bytes) -> str:
    return key.decode("utf-8", "surrogatepass")


def _solve(links: pd.DataFrame, paths: bool) -> pd.DataFrame:
    forest = WeightedForest()
    own = [list(p) for p in links["path"]] if paths else [[]] * len(links)
    # keys are compared in binary order, so the least key of a stretch is kept as bytes
    for s, n, u, w, m, way in zip(links["scope"].tolist(), links["node"].tolist(), links["up"].tolist(), links["dist"].tolist(), links["least"].tolist(), own):
        forest.unite((s, n), (s, u), w, _bytes(m), way)
    rows = []
    low: dict[int, bytes] = {}
    known: dict[int, list] = {}
    for at in forest.link:
        way, x = [], at
        while x in forest.link and x not in low and x not in forest.cycle:
            way.append(x)
            x = forest.link[x][0]
        least, tail = low.get(x), known.get(x, [])
        for y in reversed(way):
            least = low[y] = forest.link[y][2] if least is None else min(least, forest.link[y][2])
            if paths:
                tail = known[y] = forest.link[y][3] + tail
        root, dist = forest.find(at)
        cyclic = forest.cycle.get(root)
        scope, node = forest.keys[at]
        rows.append((scope, node, forest.keys[root][1], dist, _text(low.get(at, forest.link[at][2])), None if cyclic is None else _text(cyclic), known.get(at, []) if paths and cyclic is None else None))
    return pd.DataFrame(rows, columns=["scope", "node", "up", "dist", "least", "cyclic", "path"])


def _level(links: DataFrame, paths: bool, bound: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries of one round of bucket-local forests, and the scopes that took several buckets (None if there is none)."""
    sizes = links.groupBy("scope").count()
    total = sizes.agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    n, most = total["n"] or 0, total["most"] or 0
    wide = None
    spread = links.withColumn("sub", F.lit(0))
    if most > bound:
        wide = sizes.filter(F.col("count") > bound).select("scope", F.ceil(F.col("count") / bound).cast("long").alias("subs"))
        # the wide scopes are at most n / bound rows; Spark broadcasts them only below its own threshold
        spread = links.join(wide, "scope", "left").withColumn("sub", F.pmod(F.xxhash64("node", F.lit(depth)), F.coalesce("subs", F.lit(1))))
    buckets = max(1, -(-2 * n // bound))
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("scope", "sub"), F.lit(buckets)))
    solved = spread.groupBy("bucket").applyInPandas(lambda g: _solve(g, paths), _ENTRY)
    return solved, wide


def _doubled(links: DataFrame, paths: bool) -> DataFrame:
    """Roots by doubling the distance each round: exact for chains of any length, with no group larger than a key's own rows."""
    if paths:  # first without paths, as a way round a cycle has no end
        flat = staged(_doubled(links.withColumn("path", F.lit(None).cast("array<string>")), False), "hierarchy-flat")
        tree = links.join(flat.filter(F.col("cyclic").isNull()).select("scope", "node"), ["scope", "node"], "left_semi")
        return _rounds(tree, True).unionByName(flat.filter(F.col("cyclic").isNotNull()))
    return _rounds(links, False)


def _rounds(links: DataFrame, paths: bool) -> DataFrame:
    step = staged(links.withColumn("cyclic", F.lit(None).cast("string")), "hierarchy-doubling")
    n = step.count()
    span, moved = 1, True
    while moved and span <= 2 * n:
        right = step.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("least").alias("least2"), *([F.col("path").alias("path2")] if paths else []))
        joined = step.join(right, ["scope", "up"], "left")
        step = staged(
            joined.select(
                "scope", "node", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.least("least", F.coalesce("least2", "least")).alias("least"), "cyclic",
                (F.concat("path", F.coalesce("path2", F.array().cast("array<string>"))) if paths else F.col("path")).alias("path"), F.col("up2").isNotNull().alias("moved"),
            ),
            "hierarchy-doubling",
        )
        moved = not step.filter("moved").select("node").isEmpty()
        step, span = step.drop("moved"), 2 * span
    heads = step.select("scope", F.col("node").alias("up"), F.col("least").alias("loop"))
    # what still has a way up after that many steps stands on a cycle, and its stretch covers the whole cycle
    return step.join(heads, ["scope", "up"], "left").select("scope", "node", "up", "dist", "least", F.col("loop").alias("cyclic"), F.when(F.col("loop").isNull(), F.col("path")).alias("path"))


def resolve(links: DataFrame, paths: bool = False, bound: int = BUCKET_LINKS, _depth: int = 0) -> DataFrame:
    """For links (scope, node, up, dist, least, path) the entries with ``up`` the top of the chain or, with ``cyclic`` the least key of the cycle it runs into, some key on it."""
    solved, wide = _level(links, paths, bound, _depth)
    if wide is None:
        return solved
    solved = staged(solved, "hierarchy-level")
    # ``wide`` repeats a count; the scopes it names are the only ones with unfinished trees
    tops = solved.filter(F.col("cyclic").isNull()).join(wide.select("scope"), "scope", "left_semi").select("scope", F.col("up").alias("node")).distinct()
    between = staged(solved.filter(F.col("cyclic").isNull()).join(tops, ["scope", "node"], "left_semi").drop("cyclic"), "hierarchy-between")
    left, had = between.count(), links.count()
    if not left:
        upper = between.withColumn("cyclic", F.lit(None).cast("string"))
    elif 2 * left > had:
        upper = _doubled(between, paths)
    else:
        upper = resolve(between, paths, bound, _depth + 1)
    # a local top may itself run into a cycle in its own bucket; what leads to it then does as well
    ringed = solved.filter(F.col("cyclic").isNotNull()).join(tops, ["scope", "node"], "left_semi")
    onward = ringed.select("scope", F.col("node").alias("up"), F.col("cyclic").alias("cyclic3"))
    upper = upper.join(onward, ["scope", "up"], "left").withColumn("cyclic", F.coalesce("cyclic", "cyclic3")).drop("cyclic3")
    upper = upper.withColumn("path", F.when(F.col("cyclic").isNull(), F.col("path"))).unionByName(ringed)
    upper = upper.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("least").alias("least2"), F.col("cyclic").alias("cyclic2"), F.col("path").alias("path2"))
    joined = solved.join(upper, ["scope", "up"], "left")
    return joined.select(
        "scope", "node", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.least("least", F.coalesce("least2", "least")).alias("least"),
        F.coalesce("cyclic", "cyclic2").alias("cyclic"),
        (F.when(F.coalesce("cyclic", "cyclic2").isNull(), F.concat("path", F.coalesce("path2", F.array().cast("array<string>")))) if paths else F.col("path")).alias("path"),
    )


def hierarchy(pairs: DataFrame, scope: str, child: str, parent: str, paths: bool = False, bound: int = BUCKET_LINKS) -> DataFrame:
    """All nodes of the trees that ``pairs`` form within each scope: (scope, node, root, depth, in_cycle, path).

    * A node is anything at either end of a pair that counts; pairs with a null in any of the three columns are left out.
    * ``root`` is the node without a parent at the top of the chain, with ``depth`` 0; where the chain runs into a cycle (a node
      that is its own parent is one) ``root`` is the least key on the cycle in binary order, ``in_cycle`` is true, and ``depth`` and
      ``path`` are null.
    * ``path`` lists the keys from the root down to the node (null unless ``paths``).
    * Repeated pairs count once. Should a node have several parents, the pair with the least one counts.
    * Other columns of ``pairs`` are ignored. An empty table gives an empty table.
    """
    # one aggregation drops repeats and settles several parents at once
    links = pairs.select(F.col(scope).alias("scope"), F.col(child).alias("node"), F.col(parent).alias("up")).dropna().groupBy("scope", "node").agg(F.min("up").alias("up"))
    links = staged(links.select("scope", "node", "up", F.lit(1).cast("long").alias("dist"), F.col("node").alias("least"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("path")), "hierarchy-links")
    entries = resolve(links, paths, bound)
    looped = F.col("cyclic").isNotNull()
    way = F.when(~looped, F.reverse(F.concat("path", F.array("up")))) if paths else F.lit(None).cast("array<string>")
    # read twice below; the forests must not be built again for that
    entries = staged(entries.select("scope", "node", "up", "dist", "cyclic", "path"), "hierarchy-entries")
    members = entries.select("scope", "node", F.coalesce("cyclic", "up").alias("root"), F.when(~looped, F.col("dist")).alias("depth"), looped.alias("in_cycle"), way.alias("path"))
    tops = entries.filter(~looped).select("scope", F.col("up").alias("node")).distinct()
    return members.unionByName(tops.select("scope", "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("in_cycle"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("path")))


def descendants(nodes: DataFrame) -> DataFrame:
    """Of the result of :func:`hierarchy` with paths, one row for each node and each node below it: (scope, node, descendant, distance).

    Nodes whose chain runs into a cycle have no path and give no rows.
    """
    above = nodes.filter(F.col("path").isNotNull()).select("scope", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return above.filter(F.col("at") < F.col("depth")).select("scope", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
