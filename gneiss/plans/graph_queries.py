"""Queries over the stored graph: selection of snapshots, joins, metrics, traversals, differences, services."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci, metadata_text
from gneiss.operators import diff, graph, ingest, selection, services
from gneiss.operators.hotspots import metric_hotspots, ranked
from gneiss.operators.metrics import dependencies, framework_risk, graph_metrics, target_framework
from gneiss.plans import model
from gneiss.plans.model import SNAP, SQL_EDGES, SQL_EVIDENCE, SQL_HEADERS, SQL_HOTSPOTS, SQL_NODES
from gneiss.sources.store import SnapshotStore, StoreError
from gneiss.sources.tables import table
from gneiss.work import shared_folder, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}
_N, _E, _EV, _H = SQL_NODES, SQL_EDGES, SQL_EVIDENCE, SQL_HOTSPOTS
_DEPS = "d AS (SELECT * FROM e WHERE edgeKind <> 'CONTAINS')"
#: The default kinds of a traversal, as SQL.
_KINDS = ", ".join(f"'{k}'" for k in graph.TRAVERSED)


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with its SQL."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


# ---- snapshots ----------------------------------------------------------------------------------------------------------------
_ORDER = "coalesce(completedUtc, startedUtc) DESC, startedUtc DESC, stableKey DESC"


@query(f"WITH {SQL_HEADERS} SELECT repositoryStableKey, stableKey, status FROM hd QUALIFY row_number() OVER (PARTITION BY repositoryStableKey ORDER BY {_ORDER}) = 1")
def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return selection.latest_snapshots(model.headers(spark, folder)).select("repositoryStableKey", "stableKey", "status")


@query(f"WITH {SQL_HEADERS}, r AS (SELECT *, row_number() OVER (PARTITION BY repositoryStableKey ORDER BY {_ORDER}) p FROM hd) SELECT a.repositoryStableKey, a.stableKey AS current, b.stableKey AS previous FROM r a JOIN r b ON b.repositoryStableKey = a.repositoryStableKey AND b.p = 2 WHERE a.p = 1")
def latest_pair(spark: SparkSession, folder: str) -> DataFrame:
    return selection.latest_pairs(model.headers(spark, folder))


@query(
    f"""WITH {SQL_HEADERS}, t AS (SELECT repositoryStableKey r, stableKey k, coalesce(completedUtc, startedUtc) a FROM hd)
SELECT x.r AS repositoryStableKey, x.k AS stableKey, arg_max(y.k, (y.a, y.k)) AS previous FROM t x LEFT JOIN t y ON y.r = x.r AND y.k <> x.k AND y.a <= x.a GROUP BY ALL"""
)
def previous_snapshot_asof(spark: SparkSession, folder: str) -> DataFrame:
    return selection.previous_comparable(model.headers(spark, folder))


@query(f"WITH {SQL_HEADERS} SELECT stableKey, startedUtc, status FROM hd WHERE status = 'Completed' AND startedUtc BETWEEN '2024-02-01' AND '2024-05-31 23:59:59'")
def snapshot_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    found = selection.lifecycle(model.headers(spark, folder), status="Completed", since=datetime(2024, 2, 1), until=datetime(2024, 5, 31, 23, 59, 59))
    return found.select("stableKey", "startedUtc", "status")


@query(f"WITH {SQL_HEADERS} SELECT repositoryStableKey, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'current' END AS state, string_agg(stableKey, ',' ORDER BY stableKey) AS candidates FROM (SELECT * FROM hd QUALIFY rank() OVER (PARTITION BY repositoryStableKey ORDER BY coalesce(completedUtc, startedUtc) DESC, startedUtc DESC) = 1) GROUP BY ALL")
def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return selection.current_snapshots(model.headers(spark, folder)).withColumn("candidates", F.array_join("candidates", ","))


@query(f"WITH {SQL_HEADERS}, r AS (SELECT *, row_number() OVER (PARTITION BY repositoryStableKey ORDER BY {_ORDER}) p FROM hd) SELECT stableKey, p AS place FROM r WHERE p > 3 AND startedUtc < '2024-06-01'")
def retention_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = selection.retention_candidates(model.headers(spark, folder), 3, datetime(2024, 6, 1))
    return found.select("stableKey", F.col("place").cast("long").alias("place"))


@query(f"WITH {_N} SELECT snapshotStableKey, count(*) FILTER (nodeKind = 'Solution') AS solutions FROM n GROUP BY 1 HAVING count(*) FILTER (nodeKind = 'Solution') > 0")
def snapshots_with_solution(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots that hold a solution: the scope of solution-wide queries."""
    return model.stored_nodes(spark, folder).filter(F.col("nodeKind") == "Solution").groupBy(SNAP).agg(F.count("*").alias("solutions"))


# ---- ingest -------------------------------------------------------------------------------------------------------------------
@query("SELECT snapshotStableKey, stableKey, arg_max(nodeKind, (stage, loadedUtc)) AS nodeKind, arg_max(stage, (stage, loadedUtc)) AS stage FROM (SELECT *, CASE WHEN loadedUtc < '2024-06-01' THEN 0 ELSE 1 END stage FROM nodes QUALIFY row_number() OVER (PARTITION BY snapshotStableKey, stableKey, CASE WHEN loadedUtc < '2024-06-01' THEN 0 ELSE 1 END ORDER BY loadedUtc DESC) = 1) GROUP BY 1, 2")
def keyed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries of nodes, of which the later wins."""
    from gneiss.operators.versions import holding

    rows = table(spark, folder, "nodes")
    cut = F.lit("2024-06-01").cast("timestamp_ntz")
    stages = [holding(rows.filter(F.col("loadedUtc") < cut), ["nodeKind"]).withColumn("stage", F.lit(0)), holding(rows.filter(F.col("loadedUtc") >= cut), ["nodeKind"]).withColumn("stage", F.lit(1))]
    return ingest.upsert(stages, [SNAP, "stableKey"])


_PAYLOAD = ["evidenceKind", "filePath", "startLine", "endLine", "symbolName", "containingSymbol", "snippetHash"]


@query(f"WITH {_EV} SELECT snapshotStableKey, stableKey, min(stableKey) OVER (PARTITION BY snapshotStableKey, {', '.join(_PAYLOAD)}) AS canonical FROM ev")
def evidence_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.canonical_evidence(model.stored_evidence(spark, folder), _PAYLOAD)


_ENDS = "ends AS (SELECT snapshotStableKey, stableKey, 'source' w, source k FROM e UNION ALL SELECT snapshotStableKey, stableKey, 'target', target FROM e)"


@query(f"WITH {_N}, {_E}, {_ENDS} SELECT ends.snapshotStableKey, ends.stableKey, w AS missing_end, k AS missing_key FROM ends ANTI JOIN n ON n.snapshotStableKey = ends.snapshotStableKey AND n.stableKey = k")
def referential_violations(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.dangling_edges(model.stored_nodes(spark, folder), model.stored_edges(spark, folder))


@query(f"WITH {_N}, {_E}, {_ENDS}, bad AS (SELECT DISTINCT ends.snapshotStableKey, ends.stableKey FROM ends ANTI JOIN n ON n.snapshotStableKey = ends.snapshotStableKey AND n.stableKey = k) SELECT e.snapshotStableKey, count(*) AS edges, count(*) FILTER (bad.stableKey IS NULL) AS matched FROM e LEFT JOIN bad USING (snapshotStableKey, stableKey) GROUP BY 1")
def endpoint_check(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.endpoint_check(model.stored_nodes(spark, folder), model.stored_edges(spark, folder))


@query(f"WITH {_N}, {_E}, {_EV}, {_H} SELECT snapshotStableKey, 'nodes' AS family, count(*) AS records FROM n GROUP BY 1 UNION ALL SELECT snapshotStableKey, 'edges', count(*) FROM e GROUP BY 1 UNION ALL SELECT snapshotStableKey, 'evidence', count(*) FROM ev GROUP BY 1 UNION ALL SELECT snapshotStableKey, 'hotspots', count(*) FROM hs GROUP BY 1")
def persistence_counts(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"nodes": model.stored_nodes(spark, folder), "edges": model.stored_edges(spark, folder), "evidence": model.stored_evidence(spark, folder), "hotspots": model.stored_hotspots(spark, folder)}
    return ingest.record_counts(tables)


@query(f"WITH {_N}, {SQL_HEADERS}, gone AS (SELECT stableKey FROM hd WHERE status <> 'Completed') SELECT n.snapshotStableKey, count(*) AS nodes FROM n ANTI JOIN gone ON gone.stableKey = n.snapshotStableKey GROUP BY 1")
def delete_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    """What is left when the snapshots that did not complete are deleted."""
    gone = model.headers(spark, folder).filter(F.col("status") != "Completed")
    return ingest.without(model.stored_nodes(spark, folder), gone).groupBy(SNAP).agg(F.count("*").alias("nodes"))


@query(f"WITH {_N}, c AS (SELECT snapshotStableKey, stableKey, unnest([CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'ConfidenceOutOfRange' END, CASE WHEN unknownState.hasUnknownData AND unknownState.unknownReason IS NULL THEN 'UnknownReasonMissing' END, CASE WHEN trim(stableKey) = '' THEN 'KeyBlank' END]) AS problem FROM n) SELECT * FROM c WHERE problem IS NOT NULL")
def invalid_records(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.invalid_records(model.stored_nodes(spark, folder))


# ---- joins and sets -----------------------------------------------------------------------------------------------------------
@query(f"WITH {_N}, {_E} SELECT e.snapshotStableKey, e.stableKey, e.edgeKind, s.displayName AS source_name, t.displayName AS target_name FROM e LEFT JOIN n s ON s.snapshotStableKey = e.snapshotStableKey AND s.stableKey = e.source LEFT JOIN n t ON t.snapshotStableKey = e.snapshotStableKey AND t.stableKey = e.target")
def edge_with_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = model.stored_nodes(spark, folder), model.stored_edges(spark, folder)
    name = lambda end: nodes.select(SNAP, F.col("stableKey").alias(end), F.col("displayName").alias(f"{end}_name"))
    return edges.join(name("source"), [SNAP, "source"], "left").join(name("target"), [SNAP, "target"], "left").select(SNAP, "stableKey", "edgeKind", "source_name", "target_name")


@query(f"WITH {_N}, {_EV} SELECT n.snapshotStableKey, n.stableKey, ev.filePath, ev.startLine FROM n LEFT JOIN ev ON ev.snapshotStableKey = n.snapshotStableKey AND ev.stableKey = n.primaryEvidenceStableKey")
def node_with_evidence(spark: SparkSession, folder: str) -> DataFrame:
    places = model.stored_evidence(spark, folder).select(SNAP, F.col("stableKey").alias("primaryEvidenceStableKey"), "filePath", "startLine")
    return model.stored_nodes(spark, folder).join(places, [SNAP, "primaryEvidenceStableKey"], "left").select(SNAP, "stableKey", "filePath", "startLine")


_INC = "inc AS (SELECT snapshotStableKey, source AS node, stableKey AS edge, edgeKind, target AS other FROM e UNION ALL SELECT snapshotStableKey, target, stableKey, edgeKind, source FROM e WHERE source <> target)"


@query(f"WITH {_E}, {_INC} SELECT snapshotStableKey, node, count(*) AS edges, count(DISTINCT other) AS others FROM inc GROUP BY 1, 2")
def incident_edges(spark: SparkSession, folder: str) -> DataFrame:
    return services.incident(model.stored_edges(spark, folder)).groupBy(SNAP, "node").agg(F.count("*").alias("edges"), F.count_distinct("other").alias("others"))


@query(f"WITH {_N}, {_E}, {_INC} SELECT DISTINCT inc.snapshotStableKey, inc.node, inc.other FROM inc SEMI JOIN n ON n.snapshotStableKey = inc.snapshotStableKey AND n.stableKey = inc.other")
def related_nodes(spark: SparkSession, folder: str) -> DataFrame:
    known = model.stored_nodes(spark, folder).select(SNAP, F.col("stableKey").alias("other"))
    return services.incident(model.stored_edges(spark, folder)).select(SNAP, "node", "other").distinct().join(known, [SNAP, "other"], "left_semi").select(SNAP, "node", "other")


@query(f"WITH {_N} SELECT p.snapshotStableKey, p.stableKey AS project, o.nodeKind, count(*) AS owned FROM n p JOIN n o ON o.snapshotStableKey = p.snapshotStableKey AND o.projectStableKey = p.stableKey WHERE p.nodeKind = 'Project' GROUP BY ALL")
def owned_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = model.stored_nodes(spark, folder)
    projects = nodes.filter(F.col("nodeKind") == "Project").select(SNAP, F.col("stableKey").alias("project"))
    return nodes.withColumnRenamed("projectStableKey", "project").join(projects, [SNAP, "project"], "left_semi").groupBy(SNAP, "project", "nodeKind").agg(F.count("*").alias("owned"))


@query(f"WITH {_N}, {_E}, {_DEPS} SELECT d.snapshotStableKey, d.stableKey FROM d SEMI JOIN n s ON s.snapshotStableKey = d.snapshotStableKey AND s.stableKey = d.source SEMI JOIN n t ON t.snapshotStableKey = d.snapshotStableKey AND t.stableKey = d.target")
def dependencies_with_ends(spark: SparkSession, folder: str) -> DataFrame:
    nodes = model.stored_nodes(spark, folder)
    end = lambda name: nodes.select(SNAP, F.col("stableKey").alias(name))
    return dependencies(model.stored_edges(spark, folder)).join(end("source"), [SNAP, "source"], "left_semi").join(end("target"), [SNAP, "target"], "left_semi").select(SNAP, "stableKey")


@query(f"WITH {_E} SELECT snapshotStableKey, stableKey, len(list_distinct(list_filter(coalesce(evidenceStableKeys, []), lambda x: x IS NOT NULL))) AS evidence, coalesce(array_to_string(list_sort(list_distinct(list_filter(coalesce(evidenceStableKeys, []), lambda x: x IS NOT NULL))), ','), '') AS keys FROM e")
def edge_evidence_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sorted keys of an array, as far as they are not null."""
    keys = F.array_sort(F.array_distinct(F.filter(F.coalesce("evidenceStableKeys", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return model.stored_edges(spark, folder).select(SNAP, "stableKey", F.size(keys).alias("evidence"), F.array_join(keys, ",").alias("keys"))


@query(f"WITH {_N}, {_E}, {_H}, {_EV}, u AS (SELECT snapshotStableKey, primaryEvidenceStableKey k, 'Node' AS kind, stableKey AS key, 'PrimaryEvidence' AS relation FROM n WHERE primaryEvidenceStableKey IS NOT NULL UNION ALL SELECT snapshotStableKey, unnest(evidenceStableKeys), 'Edge', stableKey, CASE WHEN generate_subscripts(evidenceStableKeys, 1) = 1 THEN 'PrimaryEvidence' ELSE 'SupportingEvidence' END FROM e UNION ALL SELECT snapshotStableKey, unnest(evidenceStableKeys), 'Hotspot', stableKey, CASE WHEN generate_subscripts(evidenceStableKeys, 1) = 1 THEN 'PrimaryEvidence' ELSE 'SupportingEvidence' END FROM hs) SELECT snapshotStableKey, k AS evidence, kind, key, relation FROM u WHERE k IS NOT NULL")
def evidence_related(spark: SparkSession, folder: str) -> DataFrame:
    return services.evidence_uses(model.stored_nodes(spark, folder), model.stored_edges(spark, folder), model.stored_hotspots(spark, folder))


@query(f"WITH {_E}, {_H} SELECT snapshotStableKey, stableKey AS key, 'edge' AS family FROM e UNION ALL SELECT snapshotStableKey, stableKey, 'hotspot' FROM hs")
def union_of_records(spark: SparkSession, folder: str) -> DataFrame:
    return model.stored_edges(spark, folder).select(SNAP, F.col("stableKey").alias("key"), F.lit("edge").alias("family")).unionByName(model.stored_hotspots(spark, folder).select(SNAP, F.col("stableKey").alias("key"), F.lit("hotspot").alias("family")))


_PAIR = f"pr2 AS (SELECT a.stableKey AS current, b.stableKey AS previous FROM (SELECT *, row_number() OVER (PARTITION BY repositoryStableKey ORDER BY {_ORDER}) p FROM hd) a JOIN (SELECT *, row_number() OVER (PARTITION BY repositoryStableKey ORDER BY {_ORDER}) p FROM hd) b ON b.repositoryStableKey = a.repositoryStableKey AND b.p = 2 WHERE a.p = 1)"


@query(f"WITH {_N}, {SQL_HEADERS}, {_PAIR} SELECT pr2.current, n.stableKey FROM n JOIN pr2 ON n.snapshotStableKey = pr2.current ANTI JOIN n o ON o.snapshotStableKey = pr2.previous AND o.stableKey = n.stableKey")
def nodes_new_in_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Difference of key sets: nodes of the latest snapshot that the one before lacks."""
    nodes, pairs = model.stored_nodes(spark, folder), selection.latest_pairs(model.headers(spark, folder))
    now = nodes.join(pairs.withColumnRenamed("current", SNAP), SNAP).select(F.col(SNAP).alias("current"), "previous", "stableKey")
    return now.join(nodes.select(F.col(SNAP).alias("previous"), "stableKey"), ["previous", "stableKey"], "left_anti").select("current", "stableKey")


# ---- metrics ------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_N}, {SQL_HEADERS} SELECT n.snapshotStableKey, count(*) AS nodes, bool_and(hd.stableKey IS NULL) AS unknown FROM n LEFT JOIN hd ON hd.stableKey = n.snapshotStableKey GROUP BY 1")
def snapshot_node_count(spark: SparkSession, folder: str) -> DataFrame:
    known = model.headers(spark, folder).select(F.col("stableKey").alias(SNAP), F.lit(False).alias("__k"))
    return model.stored_nodes(spark, folder).groupBy(SNAP).agg(F.count("*").alias("nodes")).join(known, SNAP, "left").select(SNAP, "nodes", F.col("__k").isNull().alias("unknown"))


_METRICS = f"""{_N}, {_E}, {_DEPS},
ends2 AS (SELECT snapshotStableKey s, source AS node, target AS other, 1 AS o, 0 AS i FROM d UNION ALL SELECT snapshotStableKey, target, source, 0, 1 FROM d),
deg AS (SELECT s, node, sum(o) AS fan_out, sum(i) AS fan_in, count(DISTINCT other) AS neighbourhood FROM ends2 GROUP BY 1, 2),
sz AS (SELECT snapshotStableKey s, count(*) c FROM n GROUP BY 1),
gm AS (SELECT n.snapshotStableKey, n.stableKey, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out, coalesce(neighbourhood, 0)::BIGINT AS neighbourhood,
 CASE WHEN c > 1 THEN round((coalesce(fan_in, 0) + coalesce(fan_out, 0))::DECIMAL(18,0) / (2 * (c - 1)), 6) ELSE 0 END::DOUBLE AS centrality FROM n JOIN sz ON sz.s = n.snapshotStableKey LEFT JOIN deg ON deg.s = n.snapshotStableKey AND deg.node = n.stableKey)"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return graph_metrics(model.stored_nodes(spark, folder), model.stored_edges(spark, folder))


@query(f"WITH {_METRICS} SELECT snapshotStableKey, stableKey, fan_in, fan_out FROM gm")
def fan_in_out(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).select(SNAP, "stableKey", "fan_in", "fan_out")


@query(f"WITH {_METRICS} SELECT snapshotStableKey, stableKey, centrality FROM gm")
def degree_centrality(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).select(SNAP, "stableKey", F.col("centrality").cast("double").alias("centrality"))


@query(f"WITH {_METRICS} SELECT snapshotStableKey, stableKey, neighbourhood FROM gm")
def neighbourhood_size(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).select(SNAP, "stableKey", "neighbourhood")


_REACH = f"""{_E}, {_DEPS}, st AS (SELECT DISTINCT snapshotStableKey s, source a, target b FROM d),
w(s, n, x, dd) AS (SELECT s, a, b, 1 FROM st UNION SELECT w.s, w.n, st.b, w.dd + 1 FROM w JOIN st ON st.s = w.s AND st.a = w.x WHERE w.dd < 12),
first AS (SELECT s, n, x, min(dd) AS dd FROM w GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {_REACH} SELECT first.s AS snapshotStableKey, n AS node, max(dd)::BIGINT AS depth, count(*) AS reached, coalesce(bool_or(dd = 12 AND h.a IS NOT NULL), false) AS truncated FROM first LEFT JOIN (SELECT DISTINCT s, a FROM st) h ON h.s = first.s AND h.a = first.x GROUP BY 1, 2")
def dependency_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of dependencies and number of transitive ones of every node, with the mark of truncation."""
    return graph.reach(dependencies(model.stored_edges(spark, folder)))


_RISK = "CASE WHEN tf IS NULL THEN NULL WHEN tf LIKE 'net10%' THEN 0 WHEN tf LIKE 'net8%' OR tf LIKE 'net9%' THEN 1 WHEN tf LIKE 'netcoreapp%' OR tf LIKE 'net5%' OR tf LIKE 'net6%' OR tf LIKE 'net7%' THEN 2 WHEN tf LIKE 'net4%' OR tf LIKE 'v4%' THEN 3 ELSE 2 END"
_RISK_TEXT = "CASE WHEN tf IS NULL THEN 'Unknown' WHEN tf LIKE 'net10%' THEN 'Current' WHEN tf LIKE 'net8%' OR tf LIKE 'net9%' THEN 'Supported' WHEN tf LIKE 'netcoreapp%' OR tf LIKE 'net5%' OR tf LIKE 'net6%' OR tf LIKE 'net7%' THEN 'OutOfSupportModernDotNet' WHEN tf LIKE 'net4%' OR tf LIKE 'v4%' THEN 'LegacyDotNetFramework' ELSE 'UnknownRisk' END"


@query(f"""WITH {_N}, p AS (SELECT snapshotStableKey, stableKey, json_extract_string(metadata, '$."project.targetFramework"') AS tf FROM n WHERE nodeKind = 'Project') SELECT snapshotStableKey, stableKey, {_RISK} AS risk, {_RISK_TEXT} AS risk_text FROM p""")
def target_framework_risk(spark: SparkSession, folder: str) -> DataFrame:
    number, text = framework_risk(target_framework("metadata"))
    return model.stored_nodes(spark, folder).filter(F.col("nodeKind") == "Project").select(SNAP, "stableKey", number.alias("risk"), text.alias("risk_text"))


_TH = "(VALUES ('GraphFanIn', 'HighFanIn', 5), ('GraphFanIn', 'SharedLibrary', 8), ('GraphFanOut', 'HighFanOut', 5)) th(m, c, t)"


@query(f"WITH {_METRICS}, l AS (SELECT snapshotStableKey, stableKey AS target, 'GraphFanIn' m, fan_in v FROM gm UNION ALL SELECT snapshotStableKey, stableKey, 'GraphFanOut', fan_out FROM gm) SELECT snapshotStableKey, c AS category, target, v::DOUBLE AS score, row_number() OVER (PARTITION BY snapshotStableKey, c ORDER BY v DESC, target) AS rank FROM l JOIN {_TH} ON th.m = l.m AND v >= t")
def hotspots_of_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hotspots detected anew from the degree metrics."""
    m = _metrics(spark, folder)
    long = m.select(SNAP, F.col("stableKey").alias("node"), F.lit(1).cast("decimal(3,2)").alias("confidence"), F.explode(F.map_from_arrays(F.array(F.lit("GraphFanIn"), F.lit("GraphFanOut")), F.array("fan_in", "fan_out"))).alias("metricKind", "numericValue"))
    return ranked(metric_hotspots(long)).select(SNAP, "category", "target", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_H} SELECT snapshotStableKey, category, targetStableKey AS target, score::DOUBLE AS score, row_number() OVER (PARTITION BY snapshotStableKey, category ORDER BY score DESC, targetStableKey) AS rank FROM hs WHERE score IS NOT NULL")
def hotspot_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Right ranks of the stored hotspots."""
    rows = model.stored_hotspots(spark, folder).filter(F.col("score").isNotNull()).select(SNAP, "category", F.col("targetStableKey").alias("target"), "score")
    return ranked(rows).select(SNAP, "category", "target", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_H} SELECT snapshotStableKey, category, targetStableKey AS target, score::DOUBLE AS score FROM hs WHERE score IS NOT NULL ORDER BY hs.score DESC, category, targetStableKey, snapshotStableKey LIMIT 5")
def top_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    """The five hotspots at the top of the dashboard."""
    rows = model.stored_hotspots(spark, folder).filter(F.col("score").isNotNull())
    return rows.orderBy(F.col("score").desc(), "category", "targetStableKey", SNAP).limit(5).select(SNAP, "category", F.col("targetStableKey").alias("target"), F.col("score").cast("double").alias("score"))


# ---- graph --------------------------------------------------------------------------------------------------------------------
def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """Every Project and Namespace node: the starts of the traversals below."""
    return model.stored_nodes(spark, folder).filter(F.col("nodeKind").isin("Project", "Namespace")).select(SNAP, F.col("stableKey").alias("start"))


_START = "st AS (SELECT snapshotStableKey s, stableKey AS start FROM n WHERE nodeKind IN ('Project', 'Namespace'))"


def _every_node(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of each snapshot as a start."""
    return model.stored_nodes(spark, folder).select(SNAP, F.col("stableKey").alias("start"))


_EVERY = "st AS (SELECT snapshotStableKey s, stableKey AS start FROM n)"


def _walk_sql(steps: str, depth: int, take: int, starts: str = _START) -> str:
    return f"""WITH RECURSIVE {_N}, {_E}, f AS (SELECT * FROM e WHERE edgeKind IN ({_KINDS})), {starts}, sp AS ({steps}),
w(s, start, x, dd) AS (SELECT s, start, start, 0 FROM st UNION SELECT w.s, w.start, sp.b, w.dd + 1 FROM w JOIN sp ON sp.s = w.s AND sp.a = w.x WHERE w.dd < {depth - 1}),
seen AS (SELECT s, start, x, min(dd) dd FROM w GROUP BY 1, 2, 3),
hit AS (SELECT seen.s, start, edge, min(dd) AS depth FROM seen JOIN sp ON sp.s = seen.s AND sp.a = seen.x GROUP BY 1, 2, 3)
SELECT s AS snapshotStableKey, start, edge, depth, row_number() OVER (PARTITION BY s, start ORDER BY edge) AS position, count(*) OVER (PARTITION BY s, start) > {take} AS truncated FROM hit QUALIFY position <= {take}"""


_OUT = "SELECT snapshotStableKey s, stableKey edge, source a, target b FROM f"
_IN = "SELECT snapshotStableKey s, stableKey edge, target a, source b FROM f"
_BOTH = f"{_OUT} UNION ALL {_IN} WHERE source <> target"


def _traversal(spark: SparkSession, folder: str, direction: str, depth: int, take: int = 100, starts=_starts) -> DataFrame:
    found = graph.traverse(model.stored_edges(spark, folder), starts(spark, folder), direction, depth, take=take)
    return found.withColumn("position", F.col("position").cast("long"))


@query(_walk_sql(_OUT, 1, 100))
def direct_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Outgoing", 1)


@query(_walk_sql(_IN, 1, 100))
def direct_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Incoming", 1)


@query(_walk_sql(_OUT, 3, 100))
def transitive_dependencies_d3(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Outgoing", 3)


@query(_walk_sql(_IN, 6, 5))
def transitive_dependents_d6(spark: SparkSession, folder: str) -> DataFrame:
    """The deepest traversal, cut to five edges each."""
    return _traversal(spark, folder, "Incoming", 6, 5)


@query(_walk_sql(_BOTH, 1, 100))
def graph_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Both", 1)


@query(
    f"""WITH {_N}, {_E}, f AS (SELECT * FROM e WHERE edgeKind IN ({_KINDS})), {_START}, sp AS ({_OUT}), hit AS (SELECT st.s, start, edge FROM st JOIN sp ON sp.s = st.s AND sp.a = start),
x AS (SELECT hit.s, start, unnest([f.source, f.target]) AS node FROM hit JOIN f ON f.snapshotStableKey = hit.s AND f.stableKey = hit.edge), y AS (SELECT DISTINCT s, start, node FROM x UNION SELECT s, start, start FROM hit)
SELECT y.s AS snapshotStableKey, start, node FROM y SEMI JOIN n ON n.snapshotStableKey = y.s AND n.stableKey = y.node"""
)
def traversal_nodes(spark: SparkSession, folder: str) -> DataFrame:
    edges = model.stored_edges(spark, folder)
    found = graph.traverse(edges, _starts(spark, folder), "Outgoing", 1, take=500)
    return graph.traversal_nodes(found, edges, model.stored_nodes(spark, folder)).select(SNAP, "start", "node")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose paths are asked for: every start with a dependency, to the greatest key of the snapshot that something depends on, and back to itself."""
    deps = model.stored_edges(spark, folder).filter(F.col("edgeKind").isin(*graph.TRAVERSED))
    greatest = deps.groupBy(SNAP).agg(F.max("target").alias("target"))
    pairs = deps.select(SNAP, "source").distinct().join(greatest, SNAP)
    return pairs.unionByName(deps.select(SNAP, "source", F.col("source").alias("target")).distinct())


_ASKED = "aa AS (SELECT snapshotStableKey s, max(target) t FROM f GROUP BY 1), asked AS (SELECT DISTINCT f.snapshotStableKey s, f.source x, aa.t y FROM f JOIN aa ON aa.s = f.snapshotStableKey UNION SELECT snapshotStableKey, source, source FROM f)"


@query(
    f"""WITH RECURSIVE {_E}, f AS (SELECT * FROM e WHERE edgeKind IN ({_KINDS})), {_ASKED},
w(s, x, z, dd) AS (SELECT DISTINCT snapshotStableKey, source, target, 1 FROM f UNION SELECT w.s, w.x, f.target, w.dd + 1 FROM w JOIN f ON f.snapshotStableKey = w.s AND f.source = w.z WHERE w.dd < 6),
best AS (SELECT s, x, z, min(dd) dd FROM w GROUP BY 1, 2, 3)
SELECT asked.s AS snapshotStableKey, asked.x AS source, asked.y AS target, CASE WHEN dd IS NULL THEN 'notFound' ELSE 'found' END AS state, dd AS hops FROM asked LEFT JOIN best ON best.s = asked.s AND best.x = asked.x AND best.z = asked.y"""
)
def dependency_path_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return graph.shortest_paths(model.stored_edges(spark, folder), _asked(spark, folder)).select(SNAP, "source", "target", "state", "hops")


@query()
def dependency_path(spark: SparkSession, folder: str) -> DataFrame:
    """The paths themselves, by the tie rule of a breadth-first walk; tested against such a walk."""
    found = graph.shortest_paths(model.stored_edges(spark, folder), _asked(spark, folder))
    return found.select(SNAP, "source", "target", "state", "hops", F.array_join("nodes", " > ").alias("nodes"), F.array_join("edges", " > ").alias("edges"))


def _cycles_sql(depth: int, limit: int) -> str:
    return f"""{_E}, {_DEPS}, w(s, st, x, ns, es) AS (SELECT snapshotStableKey, source, target, [source, target], [stableKey] FROM d WHERE target >= source
 UNION ALL SELECT w.s, w.st, d.target, list_append(w.ns, d.target), list_append(w.es, d.stableKey) FROM w JOIN d ON d.snapshotStableKey = w.s AND d.source = w.x
 WHERE len(w.es) < {depth} AND d.target > w.st AND NOT list_contains(w.ns, d.target)),
cy AS (SELECT w.s, list_append(w.ns, w.st) ns, list_append(w.es, d.stableKey) es FROM w JOIN d ON d.snapshotStableKey = w.s AND d.source = w.x AND d.target = w.st WHERE len(w.es) < {depth}),
cr AS (SELECT s, array_to_string(ns, '>') AS nodes, array_to_string(es, '>') AS edges, ns, row_number() OVER (PARTITION BY s ORDER BY array_to_string(ns, '>'), array_to_string(es, '>')) AS position, count(*) OVER (PARTITION BY s) > {limit} AS truncated FROM cy QUALIFY position <= {limit})"""


_CYCLES = _cycles_sql(12, 500)


def _cycles(spark: SparkSession, folder: str, depth: int = 12, limit: int = 500) -> DataFrame:
    return graph.simple_cycles(dependencies(model.stored_edges(spark, folder)), depth, limit)


@query(f"WITH RECURSIVE {_CYCLES} SELECT s AS snapshotStableKey, nodes, edges, position, truncated FROM cr")
def cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles of at most twelve dependencies, five hundred for each snapshot: the bounds of the query."""
    return _cycles(spark, folder).select(SNAP, F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), F.col("position").cast("long").alias("position"), "truncated")


@query(f"WITH RECURSIVE {_cycles_sql(12, 100)} SELECT s AS snapshotStableKey, node, count(*) AS cycles FROM (SELECT s, edges, unnest(list_distinct(ns)) AS node FROM cr) GROUP BY 1, 2")
def cycle_participation(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a snapshot's first hundred cycles a node lies on."""
    return graph.cycle_participation(_cycles(spark, folder, 12, 100)).select(SNAP, "node", "cycles")


@query(f"WITH RECURSIVE {_cycles_sql(12, 100)} SELECT s AS snapshotStableKey, nodes, edges, position, truncated FROM cr")
def cycles_d12(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles of at most twelve dependencies, a hundred for each snapshot: the detector's own bounds."""
    return _cycles(spark, folder, 12, 100).select(SNAP, F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), F.col("position").cast("long").alias("position"), "truncated")


@query(
    _walk_sql(_IN, 3, 100).replace("SELECT s AS snapshotStableKey, start, edge, depth, row_number()", "SELECT snapshotStableKey, start, edge, source, CASE WHEN target = start THEN 1 ELSE 2 END AS impact_depth, min(confidence) OVER (PARTITION BY snapshotStableKey, start)::DOUBLE AS confidence, truncated FROM (SELECT s AS snapshotStableKey, start, edge, row_number()")
    + ") z JOIN (SELECT snapshotStableKey, stableKey, source, target, confidence FROM e) q ON q.stableKey = z.edge AND q.snapshotStableKey = z.snapshotStableKey"
)
def impact_assessment(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.impact(model.stored_edges(spark, folder), _starts(spark, folder))
    return found.select(SNAP, "start", "edge", "source", "impact_depth", F.col("confidence").cast("double").alias("confidence"), "truncated")


SQL["impact_assessment"] = SQL["impact_assessment"].replace("SELECT snapshotStableKey, start, edge, source,", "SELECT z.snapshotStableKey, start, edge, source,").replace("PARTITION BY snapshotStableKey, start)::", "PARTITION BY z.snapshotStableKey, start)::")


# the traversals from every node
@query(_walk_sql(_OUT, 1, 100, _EVERY))
def direct_dependencies_every_node(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Outgoing", 1, starts=_every_node)


@query(_walk_sql(_IN, 1, 100, _EVERY))
def direct_dependents_every_node(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Incoming", 1, starts=_every_node)


@query(_walk_sql(_OUT, 3, 100, _EVERY))
def transitive_dependencies_d3_every_node(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Outgoing", 3, starts=_every_node)


@query(_walk_sql(_IN, 6, 100, _EVERY))
def transitive_dependents_d6_every_node(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Incoming", 6, starts=_every_node)


@query(_walk_sql(_BOTH, 1, 100, _EVERY))
def graph_neighbourhood_every_node(spark: SparkSession, folder: str) -> DataFrame:
    return _traversal(spark, folder, "Both", 1, starts=_every_node)


@query(SQL["traversal_nodes"].replace(_START, _EVERY))
def traversal_nodes_every_node(spark: SparkSession, folder: str) -> DataFrame:
    edges = model.stored_edges(spark, folder)
    found = graph.traverse(edges, _every_node(spark, folder), "Outgoing", 1, take=500)
    return graph.traversal_nodes(found, edges, model.stored_nodes(spark, folder)).select(SNAP, "start", "node")


@query(SQL["impact_assessment"].replace(_START, _EVERY))
def impact_assessment_every_node(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.impact(model.stored_edges(spark, folder), _every_node(spark, folder))
    return found.select(SNAP, "start", "edge", "source", "impact_depth", F.col("confidence").cast("double").alias("confidence"), "truncated")


# ---- differences --------------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, folder: str) -> DataFrame:
    n, e = model.stored_nodes(spark, folder), model.stored_edges(spark, folder)
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    nodes = diff.comparable(n, "Nodes", F.col("displayName"), F.col("nodeKind"), F.col("projectStableKey"), F.array("projectStableKey", "parentNodeStableKey"), none, F.array("primaryEvidenceStableKey"), F.col("unknownState.unknownReason"))
    edges = diff.comparable(e, "Edges", F.concat_ws(" -> ", "source", "target"), F.col("edgeKind"), none, F.array("source", "target"), none, F.coalesce("evidenceStableKeys", nothing), none)
    return nodes.unionByName(edges)


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    pairs = selection.latest_pairs(model.headers(spark, folder)).select("current", "previous")
    return diff.compare(_records(spark, folder), pairs)


_PLAIN = "list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL)))"
_REC = f"""rec AS (SELECT snapshotStableKey s, 'Nodes' AS domain, stableKey k, fingerprint f, displayName dn, nodeKind kind, {_PLAIN.format('[primaryEvidenceStableKey]')} evs, unknownState.unknownReason u, projectStableKey p, {_PLAIN.format('[projectStableKey, parentNodeStableKey]')} tg FROM n
 UNION ALL SELECT snapshotStableKey, 'Edges', stableKey, fingerprint, source || ' -> ' || target, edgeKind, {_PLAIN.format('coalesce(evidenceStableKeys, [])')}, NULL, NULL, {_PLAIN.format('[source, target]')} FROM e),
a AS (SELECT pr2.current, pr2.previous, rec.* FROM rec JOIN pr2 ON pr2.current = rec.s), b AS (SELECT pr2.current, pr2.previous, rec.* FROM rec JOIN pr2 ON pr2.previous = rec.s),
cmp AS (SELECT coalesce(a.current, b.current) AS current, coalesce(a.domain, b.domain) AS domain, coalesce(a.k, b.k) AS stableKey, coalesce(a.kind, b.kind) AS kind, coalesce(a.p, b.p) AS project,
 CASE WHEN b.k IS NULL THEN 'Added' WHEN a.k IS NULL THEN 'Removed' WHEN a.f IS NOT DISTINCT FROM b.f THEN 'Unchanged' ELSE 'Changed' END AS change,
 list_sort(list_filter(['fingerprint', CASE WHEN a.dn IS DISTINCT FROM b.dn THEN 'displayName' END, CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END, CASE WHEN a.evs IS DISTINCT FROM b.evs THEN 'evidenceStableKeys' END, CASE WHEN a.u IS DISTINCT FROM b.u THEN 'unknownState' END], lambda x: x IS NOT NULL)) AS fields
 FROM a FULL JOIN b ON b.current = a.current AND b.domain = a.domain AND b.k = a.k)"""
_DIFF = f"{_N}, {_E}, {SQL_HEADERS}, {_PAIR}, {_REC}"


@query(f"WITH {_DIFF} SELECT current, domain, count(*) FILTER (change = 'Added') AS added, count(*) FILTER (change = 'Removed') AS removed, count(*) FILTER (change = 'Changed') AS changed, count(*) FILTER (change = 'Unchanged') AS unchanged FROM cmp GROUP BY 1, 2")
def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return diff.summaries(_compared(spark, folder)).drop("previous")


@query(f"WITH {_DIFF} SELECT current, domain, stableKey, change, array_to_string(fields, ',') AS fields FROM cmp WHERE change = 'Changed'")
def diff_changed_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _compared(spark, folder).filter(F.col("change") == "Changed").select("current", "domain", "stableKey", "change", F.array_join("changed_fields", ",").alias("fields"))


@query(f"WITH {_DIFF} SELECT current, domain, stableKey, change, kind, project, CASE domain WHEN 'Nodes' THEN 0 ELSE 1 END AS domain_order, CASE change WHEN 'Added' THEN 0 WHEN 'Removed' THEN 1 ELSE 2 END AS change_order FROM cmp WHERE change <> 'Unchanged' AND domain = 'Nodes' AND kind = 'Type'")
def diff_items(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of types, in controlled order."""
    return diff.items(_compared(spark, folder), {"domain": "Nodes", "kind": "Type"}).select("current", "domain", "stableKey", "change", "kind", "project", "domain_order", "change_order")


@query(f"WITH {_DIFF} SELECT sum(CASE change WHEN 'Added' THEN 1 ELSE 0 END)::BIGINT AS added, sum(CASE change WHEN 'Removed' THEN 1 ELSE 0 END)::BIGINT AS removed, sum(CASE change WHEN 'Changed' THEN 1 ELSE 0 END)::BIGINT AS changed FROM cmp")
def diff_totals(spark: SparkSession, folder: str) -> DataFrame:
    s = diff.summaries(_compared(spark, folder))
    return s.agg(*[F.sum(c).alias(c) for c in ("added", "removed", "changed")])


@query(
    f"""WITH {_N}, {_E}, {SQL_HEADERS}, {_PAIR}, rec AS (SELECT snapshotStableKey s, 'Nodes' AS domain, stableKey k FROM n UNION ALL SELECT snapshotStableKey, 'Edges', stableKey FROM e),
x AS (SELECT pr2.current, domain, k, true AS now FROM rec JOIN pr2 ON pr2.current = s UNION ALL SELECT pr2.current, domain, k, false FROM rec JOIN pr2 ON pr2.previous = s), y AS (SELECT current, domain, k, count(*) FILTER (now) a, count(*) FILTER (NOT now) b FROM x GROUP BY ALL)
SELECT current, domain, sum(CASE WHEN b = 0 THEN a ELSE 0 END)::BIGINT AS added, sum(CASE WHEN a = 0 THEN b ELSE 0 END)::BIGINT AS removed FROM y GROUP BY 1, 2"""
)
def dashboard_latest_change(spark: SparkSession, folder: str) -> DataFrame:
    pairs = selection.latest_pairs(model.headers(spark, folder)).select("current", "previous")
    return services.key_changes(_records(spark, folder).select(SNAP, "domain", "stableKey"), pairs)


# ---- services -----------------------------------------------------------------------------------------------------------------
@query(f"WITH {_N}, {_EV}, {_H} SELECT snapshotStableKey, CASE WHEN nodeKind = 'Project' THEN 'Project' WHEN nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') THEN 'Symbol' ELSE 'Fact' END AS result_kind, CASE WHEN nodeKind = 'Project' THEN 0 WHEN nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') THEN 1 ELSE 3 END AS kind_order, stableKey AS key, displayName AS title FROM n WHERE lower(concat_ws(chr(1), stableKey, displayName, qualifiedName, searchName, nodeKind, language, projectStableKey)) LIKE '%handler%' UNION ALL SELECT snapshotStableKey, 'Evidence', 4, stableKey, filePath FROM ev WHERE lower(concat_ws(chr(1), stableKey, filePath, symbolName, snippetPreview, evidenceKind)) LIKE '%handler%'")
def search(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that has handler in a public field."""
    none = spark.createDataFrame([], f"{SNAP} string, stableKey string, ruleCode string, title string, severity string, status string, affectedNodeStableKeys array<string>, primaryNodeStableKey string")
    metrics = spark.createDataFrame([], f"{SNAP} string, node string, metricKind string")
    return services.search(model.stored_nodes(spark, folder), model.stored_evidence(spark, folder), none, metrics, "Handler").select(SNAP, "result_kind", "kind_order", "key", "title")


_PARTS = "list_filter(list_transform(string_split(qualifiedName, '.'), lambda x: trim(x)), lambda x: x <> '')"
_SYM = f"""sym AS (SELECT n.snapshotStableKey, n.stableKey, n.displayName, n.qualifiedName, n.nodeKind, n.projectStableKey, n.language, CASE WHEN len({_PARTS.replace('qualifiedName', 'n.qualifiedName')}) > 2 THEN array_to_string({_PARTS.replace('qualifiedName', 'n.qualifiedName')}[1:-3], '.') END AS namespace,
 coalesce(CASE WHEN p.nodeKind = 'Type' THEN coalesce(p.qualifiedName, p.displayName) END, CASE WHEN n.nodeKind <> 'Type' AND len({_PARTS.replace('qualifiedName', 'n.qualifiedName')}) > 1 THEN {_PARTS.replace('qualifiedName', 'n.qualifiedName')}[-2] END) AS container, ev.filePath, ev.startLine
 FROM n LEFT JOIN n p ON p.snapshotStableKey = n.snapshotStableKey AND p.stableKey = n.parentNodeStableKey LEFT JOIN ev ON ev.snapshotStableKey = n.snapshotStableKey AND ev.stableKey = n.primaryEvidenceStableKey WHERE n.nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field'))"""


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return services.symbols(model.stored_nodes(spark, folder), model.stored_evidence(spark, folder))


@query(f"WITH {_N}, {_EV}, {_SYM} SELECT snapshotStableKey, stableKey, namespace, container, filePath, startLine FROM sym")
def symbols(spark: SparkSession, folder: str) -> DataFrame:
    return _symbols(spark, folder).select(SNAP, "stableKey", "namespace", "container", "filePath", "startLine")


@query(f"WITH {_N}, {_EV}, {_SYM} SELECT snapshotStableKey, stableKey, displayName FROM sym WHERE (lower(stableKey) LIKE '%policy%' OR lower(displayName) LIKE '%policy%' OR lower(qualifiedName) LIKE '%policy%') AND lower(nodeKind) = 'type' AND lower(language) = 'csharp' ORDER BY upper(coalesce(displayName, '')) DESC, stableKey, snapshotStableKey LIMIT 40 OFFSET 10")
def symbol_search(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a search, by name descending."""
    found = services.symbol_search(_symbols(spark, folder), "Policy", {"nodeKind": " type ", "language": "CSHARP"}, "displayName", True, 10, 40)
    return found.select(SNAP, "stableKey", "displayName")


@query(f"WITH {_N}, {_E}, {_EV} SELECT e.snapshotStableKey, e.stableKey, e.edgeKind, s.displayName AS source_name, t.displayName AS target_name, ev.filePath, ev.startLine, coalesce(ev.unknownState.hasUnknownData, false) AS unknown FROM e LEFT JOIN n s ON s.snapshotStableKey = e.snapshotStableKey AND s.stableKey = e.source LEFT JOIN n t ON t.snapshotStableKey = e.snapshotStableKey AND t.stableKey = e.target LEFT JOIN ev ON ev.snapshotStableKey = e.snapshotStableKey AND ev.stableKey = e.evidenceStableKeys[1] WHERE e.edgeKind IN ('REFERENCES', 'CALLS', 'IMPLEMENTS', 'INHERITS', 'HANDLES')")
def symbol_usages(spark: SparkSession, folder: str) -> DataFrame:
    found = services.symbol_usages(model.stored_nodes(spark, folder), model.stored_edges(spark, folder), model.stored_evidence(spark, folder))
    return found.select(SNAP, "stableKey", "edgeKind", "source_name", "target_name", "filePath", "startLine", "unknown")


@query(f"WITH {_N}, {_E}, us AS (SELECT snapshotStableKey, source AS node, edgeKind FROM e WHERE edgeKind IN ('REFERENCES', 'CALLS', 'IMPLEMENTS', 'INHERITS', 'HANDLES') UNION ALL SELECT snapshotStableKey, target, edgeKind FROM e WHERE edgeKind IN ('REFERENCES', 'CALLS', 'IMPLEMENTS', 'INHERITS', 'HANDLES') AND source <> target) SELECT n.snapshotStableKey, n.stableKey, count(us.node) AS relations FROM n LEFT JOIN us ON us.snapshotStableKey = n.snapshotStableKey AND us.node = n.stableKey WHERE nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') GROUP BY 1, 2")
def symbol_detail(spark: SparkSession, folder: str) -> DataFrame:
    """How many semantic edges each symbol has."""
    used = services.incident(model.stored_edges(spark, folder).filter(F.col("edgeKind").isin(*services.USAGE_KINDS))).groupBy(SNAP, F.col("node").alias("stableKey")).agg(F.count("*").alias("relations"))
    chosen = model.stored_nodes(spark, folder).filter(F.col("nodeKind").isin(*services.SYMBOL_KINDS)).select(SNAP, "stableKey")
    return chosen.join(used, [SNAP, "stableKey"], "left").select(SNAP, "stableKey", F.coalesce("relations", F.lit(0)).alias("relations"))


@query(f"WITH {_N}, {_H}, f AS (SELECT snapshotStableKey, count(*) c FROM hs GROUP BY 1) SELECT n.snapshotStableKey, count(*) FILTER (nodeKind = 'Project') AS projects, count(*) FILTER (nodeKind = 'Project' AND lower(language) IN ('c#', 'csharp')) AS csharp, count(*) FILTER (nodeKind = 'Project' AND lower(language) IN ('vb', 'visual basic', 'vb.net', 'visualbasic')) AS visual_basic, coalesce(any_value(c), 0) AS findings FROM n LEFT JOIN f ON f.snapshotStableKey = n.snapshotStableKey GROUP BY 1")
def dashboard_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard of every snapshot, with the hotspots for its findings."""
    found = services.dashboard_counts(model.stored_nodes(spark, folder), model.stored_hotspots(spark, folder))
    return found.select(SNAP, "projects", "csharp", "visual_basic", "findings")


@query(f"WITH {_EV} SELECT snapshotStableKey, stableKey, NULL::VARCHAR AS preview, 0 AS original_length FROM ev WHERE coalesce(snippetPreview, '') = ''")
def evidence_preview(spark: SparkSession, folder: str) -> DataFrame:
    return services.evidence_preview(model.stored_evidence(spark, folder))


@query(f"""WITH {_N} SELECT snapshotStableKey, stableKey, json_extract_string(metadata, '$."project.targetFramework"') AS framework, lower(displayName) LIKE '%api%' AS api FROM n WHERE nodeKind = 'Project'""")
def metadata_reads(spark: SparkSession, folder: str) -> DataFrame:
    """A strictly typed read of a dotted metadata name, and a substring test."""
    return model.stored_nodes(spark, folder).filter(F.col("nodeKind") == "Project").select(SNAP, "stableKey", metadata_text("metadata", "project.targetFramework").alias("framework"), contains_ci("displayName", "Api").alias("api"))


@query(f"WITH {_N}, {_EV} SELECT 'nodes' AS family, count(*) AS records FROM n UNION ALL SELECT 'evidence', count(*) FROM ev")
def store_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes and evidence written into a store, validated, and counted from what was written."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    written = store.write({"nodes": model.stored_nodes(spark, folder), "evidence": model.stored_evidence(spark, folder)})
    store.recreate()
    return spark.createDataFrame(list(written.items()), "family string, records bigint")


@query(f"WITH {_N}, {_E}, ok AS (SELECT e.* FROM e SEMI JOIN n a ON a.snapshotStableKey = e.snapshotStableKey AND a.stableKey = e.source SEMI JOIN n b ON b.snapshotStableKey = e.snapshotStableKey AND b.stableKey = e.target) SELECT 'nodes' AS family, count(*) AS records FROM n UNION ALL SELECT 'edges', count(*) FROM ok UNION ALL SELECT 'refused: EdgeEndMissing', count(*) FROM e ANTI JOIN ok ON ok.snapshotStableKey = e.snapshotStableKey AND ok.stableKey = e.stableKey")
def store_ingest_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges written into a store: refused as a whole while an edge lacks an end, and taken in without those edges."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    nodes, edges = model.stored_nodes(spark, folder), model.stored_edges(spark, folder)
    known = F.struct(F.lit(False).alias("hasUnknownData"), F.lit(None).cast("string").alias("unknownReason"))
    rows = edges.select(
        SNAP, "stableKey", "edgeKind", F.col("source").alias("sourceNodeStableKey"), F.col("target").alias("targetNodeStableKey"), F.lit(True).alias("isDirect"), F.try_element_at("evidenceStableKeys", F.lit(1)).alias("primaryEvidenceStableKey"),
        F.lit("Observed").alias("knowledgeKind"), "confidence", known.alias("unknownState"), F.lit("{}").alias("metadata"), "fingerprint",
    )
    dangling = staged(ingest.dangling_edges(nodes, edges).select(SNAP, "stableKey").distinct(), "dangling")
    refused: list[tuple[str, int]] = []
    try:
        store.write({"nodes": nodes, "edges": rows})
    except StoreError as error:
        refused = [(f"refused: {code}", dangling.count()) for code in error.codes]
    written = store.write({"nodes": nodes, "edges": rows.join(dangling, [SNAP, "stableKey"], "left_anti")})
    store.recreate()
    return spark.createDataFrame([*written.items(), *refused], "family string, records bigint")
