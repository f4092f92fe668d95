"""Queries p2 to p4: hierarchies, snapshot differences and orphan references over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.hierarchy import descendants, hierarchy
from gneiss.operators.orphans import OrphanLedger, orphan_counts, parents_of, references_of
from gneiss.operators.snapshot_delta import consecutive, snapshot_delta
from gneiss.operators.versions import holding
from gneiss.sources.tables import table

_HELD = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY snapshotStableKey, stableKey ORDER BY loadedUtc DESC) = 1"


def _contains(spark: SparkSession, folder: str) -> DataFrame:
    rows = holding(table(spark, folder, "symbol_relationships"), ["kind", "sourceSymbolStableKey", "targetSymbolStableKey"])
    return rows.filter(F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")) == "contains")


def _tree(spark: SparkSession, folder: str, paths: bool) -> DataFrame:
    return hierarchy(_contains(spark, folder), "snapshotStableKey", "targetSymbolStableKey", "sourceSymbolStableKey", paths)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, False).select(F.col("scope").alias("snapshot_key"), F.col("node").alias("symbol_key"), F.col("root").alias("root_key"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = _tree(spark, folder, True)
    return tree.select(F.col("scope").alias("snapshot_key"), F.col("node").alias("symbol_key"), F.col("root").alias("root_key"), "depth", "in_cycle", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    below = descendants(_tree(spark, folder, True))
    return below.select(F.col("scope").alias("snapshot_key"), F.col("node").alias("symbol_key"), F.col("descendant").alias("descendant_key"), "distance")


_LINKS = f"""h AS ({_HELD.format(t="symbol_relationships")}),
l AS (SELECT DISTINCT snapshotStableKey s, targetSymbolStableKey c, sourceSymbolStableKey p FROM h
      WHERE lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) = 'contains' AND targetSymbolStableKey IS NOT NULL AND sourceSymbolStableKey IS NOT NULL),
up(s, n, a) AS (SELECT s, c, p FROM l UNION SELECT u.s, u.n, l.p FROM up u JOIN l ON l.s = u.s AND l.c = u.a),
ring AS (SELECT s, n FROM up WHERE n = a),
sym AS (SELECT s, c n FROM l UNION SELECT s, p FROM l),
tops AS (SELECT u.s, u.n, u.a FROM up u ANTI JOIN l ON l.s = u.s AND l.c = u.a),
loops AS (SELECT u.s, u.n, min(u.a) a FROM up u JOIN ring r ON r.s = u.s AND r.n = u.a GROUP BY ALL)"""

SQL_P2_FOUND = f"""WITH RECURSIVE {_LINKS}
SELECT sym.s AS snapshot_key, sym.n AS symbol_key, coalesce(t.a, c.a, sym.n) AS root_key
FROM sym LEFT JOIN tops t ON t.s = sym.s AND t.n = sym.n LEFT JOIN loops c ON c.s = sym.s AND c.n = sym.n"""

_WALK = """start AS (SELECT sym.s, sym.n FROM sym ANTI JOIN l ON l.s = sym.s AND l.c = sym.n),
walk(s, n, r, d, path) AS (SELECT s, n, n, 0::BIGINT, [n] FROM start UNION ALL SELECT w.s, l.c, w.r, w.d + 1, list_append(w.path, l.c) FROM walk w JOIN l ON l.s = w.s AND l.p = w.n)"""

SQL_P2_PATHS = f"""WITH RECURSIVE {_LINKS}, {_WALK}
SELECT s AS snapshot_key, n AS symbol_key, r AS root_key, d AS depth, false AS in_cycle, array_to_string(path, ' > ') AS path FROM walk
UNION ALL SELECT s, n, a, NULL, true, NULL FROM loops"""

SQL_P2_DESCENDANTS = f"""WITH RECURSIVE {_LINKS}, {_WALK}
SELECT s AS snapshot_key, unnest(path[1:-2]) AS symbol_key, n AS descendant_key, d - generate_subscripts(path[1:-2], 1) + 1 AS distance FROM walk WHERE d > 0"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "snapshots").filter(F.col("status") == "Completed")
    return consecutive(done, "stableKey", "repositoryStableKey", [F.coalesce("completedUtc", "startedUtc"), F.col("startedUtc"), F.col("stableKey")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    delta = snapshot_delta(table(spark, folder, "hotspots"), _pairs(spark, folder), "snapshotStableKey", ["category", "targetStableKey"], F.lower("fingerprint"), "stableKey", "loadedUtc")
    return delta.select(F.col("later").alias("snapshot_key"), "category", F.col("targetStableKey").alias("target_key"), "change")


_P3 = f"""h AS ({_HELD.format(t="hotspots")}), s AS (SELECT DISTINCT stableKey, repositoryStableKey, startedUtc, completedUtc FROM snapshots WHERE status = 'Completed'),
o AS (SELECT stableKey k, lag(stableKey) OVER (PARTITION BY repositoryStableKey ORDER BY coalesce(completedUtc, startedUtc), startedUtc, stableKey) prev FROM s),
a AS (SELECT o.k, h.category c, h.targetStableKey t, lower(h.fingerprint) f FROM o JOIN h ON h.snapshotStableKey = o.k WHERE prev IS NOT NULL),
b AS (SELECT o.k, h.category c, h.targetStableKey t, lower(h.fingerprint) f FROM o JOIN h ON h.snapshotStableKey = o.prev),
d AS (SELECT coalesce(a.k, b.k) snapshot_key, coalesce(a.c, b.c) category, coalesce(a.t, b.t) target_key,
      CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END change
      FROM a FULL JOIN b ON a.k = b.k AND a.c = b.c AND a.t = b.t WHERE a.k IS NULL OR b.k IS NULL OR a.f <> b.f)"""
SQL_P3_FOUND = f"WITH {_P3} SELECT * FROM d"


def p3_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each kind of change per snapshot and category."""
    return p3_found(spark, folder).groupBy("snapshot_key", "category", "change").agg(F.count("*").alias("records"))


SQL_P3_SUMMARY = f"WITH {_P3} SELECT snapshot_key, category, change, count(*) AS records FROM d GROUP BY ALL"

#: Periods of equal length in which the ledger takes in the rows, by the time of loading of the references.
P4_PERIODS = 8


def _period(since: datetime | None, until: datetime | None) -> Column:
    """Rows loaded in a period; rows without a time of loading belong to the first."""
    at = F.col("loadedUtc")
    inside = F.lit(True)
    if since is not None:
        inside = inside & (at >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        before = at < F.lit(until).cast("timestamp_ntz")
        inside = inside & (before if since is not None else at.isNull() | before)
    return inside


def _ledgers(spark: SparkSession, folder: str, periods: int) -> Iterator[tuple[int, OrphanLedger]]:
    """The ledger after each period."""
    links, hot = table(spark, folder, "symbol_relationships"), table(spark, folder, "hotspots")
    nodes, evidence = table(spark, folder, "nodes"), table(spark, folder, "evidence")
    ends = links.agg(F.min("loadedUtc").alias("a"), F.max("loadedUtc").alias("b")).first()
    cuts = [] if ends["a"] is None else [ends["a"] + (ends["b"] - ends["a"]) * k / periods for k in range(1, periods)]
    bounds = [None, *cuts, None]
    ledger = OrphanLedger()
    for k, (since, until) in enumerate(zip(bounds, bounds[1:]), 1):
        period = _period(since, until)
        references = references_of(
            links.filter(period), "symbol_relationships", "snapshotStableKey", "stableKey", "loadedUtc",
            {"sourceSymbolStableKey": ("nodes", "one"), "targetSymbolStableKey": ("nodes", "one"), "evidenceStableKeys": ("evidence", "many")},
        ).unionByName(references_of(hot.filter(period), "hotspots", "snapshotStableKey", "stableKey", "loadedUtc", {"evidenceStableKeys": ("evidence", "many")}))
        parents = parents_of(nodes.filter(period), "nodes", "snapshotStableKey", "stableKey", "loadedUtc", "deletedUtc").unionByName(
            parents_of(evidence.filter(period), "evidence", "snapshotStableKey", "stableKey", "loadedUtc", "deletedUtc")
        )
        ledger = ledger.apply(references, parents)
        yield k, ledger


def _ledger(spark: SparkSession, folder: str) -> OrphanLedger:
    ledger = OrphanLedger()
    for _, ledger in _ledgers(spark, folder, P4_PERIODS):
        pass
    return ledger


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).pending.select("ref_table", F.col("scope").alias("snapshot_key"), F.col("record").alias("record_key"), F.col("field").alias("field_name"), F.col("key").alias("missing_key"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_ledger(spark, folder).pending, table(spark, folder, "snapshots"), "stableKey", "startedUtc")


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Open orphans per table and month as they stood after each of three periods."""
    parts = [orphan_counts(x.pending, table(spark, folder, "snapshots"), "stableKey", "startedUtc").withColumn("period", F.lit(k)) for k, x in _ledgers(spark, folder, 3)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_P4 = f"""n AS (SELECT snapshotStableKey s, stableKey k FROM ({_HELD.format(t="nodes")}) WHERE deletedUtc IS NULL),
e AS (SELECT snapshotStableKey s, stableKey k FROM ({_HELD.format(t="evidence")}) WHERE deletedUtc IS NULL),
r AS ({_HELD.format(t="symbol_relationships")}), h AS ({_HELD.format(t="hotspots")}),
refs AS (SELECT 'symbol_relationships' t, snapshotStableKey s, stableKey r, 'sourceSymbolStableKey' f, sourceSymbolStableKey k FROM r
 UNION ALL SELECT 'symbol_relationships', snapshotStableKey, stableKey, 'targetSymbolStableKey', targetSymbolStableKey FROM r),
eref AS (SELECT DISTINCT 'symbol_relationships' t, snapshotStableKey s, stableKey r, 'evidenceStableKeys' f, unnest(evidenceStableKeys) k FROM r
 UNION ALL SELECT DISTINCT 'hotspots', snapshotStableKey, stableKey, 'evidenceStableKeys', unnest(evidenceStableKeys) FROM h),
o AS (SELECT refs.* FROM refs ANTI JOIN n ON n.s = refs.s AND n.k = refs.k WHERE refs.k IS NOT NULL
 UNION ALL SELECT eref.* FROM eref ANTI JOIN e ON e.s = eref.s AND e.k = eref.k WHERE eref.k IS NOT NULL)"""
SQL_P4_FOUND = f"WITH {_P4} SELECT t AS ref_table, s AS snapshot_key, r AS record_key, f AS field_name, k AS missing_key FROM o"
SQL_P4_COUNTS = f"""WITH {_P4}, m AS (SELECT DISTINCT stableKey k, strftime(startedUtc, '%Y-%m') AS mon FROM snapshots)
SELECT t AS ref_table, mon AS month, count(*) AS orphans, count(DISTINCT s) AS scopes FROM o LEFT JOIN m ON m.k = o.s GROUP BY ALL"""



def _after(k: int) -> str:
    """The orphans after k of three periods, of what had been loaded by then."""
    text = _P4
    for name in ("nodes", "evidence", "symbol_relationships", "hotspots"):
        text = text.replace(f"FROM {name} ", f"FROM (SELECT * FROM {name} WHERE {k} = 3 OR loadedUtc < (SELECT make_timestamp(epoch_us(min(loadedUtc)) + ((epoch_us(max(loadedUtc)) - epoch_us(min(loadedUtc))) * {k} / 3)::BIGINT) FROM symbol_relationships)) ")
    return text


SQL_P4_PERIODS = " UNION ALL ".join(
    f"""SELECT * FROM (WITH {_after(k)}, m AS (SELECT DISTINCT stableKey k, strftime(startedUtc, '%Y-%m') AS mon FROM snapshots)
SELECT t AS ref_table, mon AS month, count(*) AS orphans, count(DISTINCT s) AS scopes, {k} AS period FROM o LEFT JOIN m ON m.k = o.s GROUP BY ALL)""" for k in (1, 2, 3)
)

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_summary": p3_summary, "p4_found": p4_found, "p4_counts": p4_counts, "p4_periods": p4_periods}
SQL = {"p2_found": SQL_P2_FOUND, "p2_paths": SQL_P2_PATHS, "p2_descendants": SQL_P2_DESCENDANTS, "p3_found": SQL_P3_FOUND, "p3_summary": SQL_P3_SUMMARY, "p4_found": SQL_P4_FOUND, "p4_counts": SQL_P4_COUNTS, "p4_periods": SQL_P4_PERIODS}
