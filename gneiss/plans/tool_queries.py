"""Queries of the tool surface: limited results with totals, facets, confidence levels, rule context, metric and rule lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci
from gneiss.operators import findings as fnd
from gneiss.operators import services, tools
from gneiss.operators.hotspots import ranked
from gneiss.operators.metrics import graph_metrics
from gneiss.plans import model
from gneiss.plans.graph_queries import _METRICS
from gneiss.plans.model import SNAP, SQL_EDGES, SQL_EVIDENCE, SQL_HOTSPOTS, SQL_NODES, SQL_PROJECTION

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with its SQL."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


_FOUND = f"""{SQL_NODES}, {SQL_EVIDENCE}, fo AS (SELECT snapshotStableKey, CASE WHEN nodeKind = 'Project' THEN 'Project' WHEN nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') THEN 'Symbol' ELSE 'Fact' END AS result_kind, CASE WHEN nodeKind = 'Project' THEN 0 WHEN nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') THEN 1 ELSE 3 END AS kind_order, stableKey AS key FROM n WHERE lower(concat_ws(chr(1), stableKey, displayName, qualifiedName, searchName, nodeKind, language, projectStableKey)) LIKE '%service%'
 UNION ALL SELECT snapshotStableKey, 'Evidence', 4, stableKey FROM ev WHERE lower(concat_ws(chr(1), stableKey, filePath, symbolName, snippetPreview, evidenceKind)) LIKE '%service%')"""


def _search(spark: SparkSession, folder: str) -> DataFrame:
    none = spark.createDataFrame([], f"{SNAP} string, stableKey string, ruleCode string, title string, severity string, status string, affectedNodeStableKeys array<string>, primaryNodeStableKey string")
    metrics = spark.createDataFrame([], f"{SNAP} string, node string, metricKind string")
    return services.search(model.stored_nodes(spark, folder), model.stored_evidence(spark, folder), none, metrics, "service")


@query(f"WITH {_FOUND}, m AS (SELECT *, row_number() OVER (PARTITION BY snapshotStableKey ORDER BY kind_order, key) p FROM fo) SELECT snapshotStableKey, result_kind, count(*) FILTER (p <= 25) AS shown, count(*) AS total FROM m GROUP BY 1, 2")
def search_facets(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of a limited search, with how many there are in all."""
    return tools.facets(_search(spark, folder), [SNAP], "result_kind", F.col("kind_order"), 25)


@query(f"WITH {_FOUND} SELECT snapshotStableKey, key, row_number() OVER (PARTITION BY snapshotStableKey ORDER BY kind_order, key) AS position, count(*) OVER (PARTITION BY snapshotStableKey) AS total FROM fo QUALIFY position <= 3")
def limited_with_total(spark: SparkSession, folder: str) -> DataFrame:
    """Three results of each snapshot and the number of all."""
    out = tools.with_total(_search(spark, folder), [SNAP], [F.col("kind_order"), F.col("key")], 3)
    return out.select(SNAP, "key", F.col("position").cast("long").alias("position"), "total")


@query(f"WITH {SQL_PROJECTION}, c AS (SELECT primaryNodeStableKey, min(confidence)::DOUBLE AS least, avg(confidence)::DOUBLE AS mean, max(confidence)::DOUBLE AS most, bool_or(hasUnknownData) u FROM pf GROUP BY 1) SELECT primaryNodeStableKey, least, round(mean, 6) AS mean, most, CASE WHEN mean >= 0.8 THEN CASE WHEN u AND mean < 0.85 THEN 'Medium' ELSE 'High' END WHEN mean >= 0.5 THEN 'Medium' WHEN mean > 0 THEN 'Low' ELSE 'Unknown' END AS level FROM c")
def confidence_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = model.projected_findings(spark, folder).select("primaryNodeStableKey", F.col("confidence").cast("double").alias("confidence"), F.col("hasUnknownData").alias("unknown"))
    return tools.confidences(rows, ["primaryNodeStableKey"]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {SQL_PROJECTION} SELECT pf.stableKey AS finding, 'rule://' || pf.ruleCode || '/' || pf.ruleVersion AS rule_key, 'Rule ' || upper(substr(lower(pf.ruleCode[6:]), 1, 1)) || lower(pf.ruleCode[7:]) AS title FROM pf")
def rule_context(spark: SparkSession, folder: str) -> DataFrame:
    """The rule of every finding, met whatever the case."""
    named = model.projected_rules(spark, folder).withColumn("ruleCode", F.lower("ruleCode"))
    return tools.rule_context(model.projected_findings(spark, folder), named)


@query(f"WITH {SQL_PROJECTION} SELECT ruleCode, version, category, enabled FROM pr WHERE enabled AND (lower(category) = 'lifecycle' OR lower(category) = 'dataaccess') ORDER BY ruleCode, version LIMIT 50")
def rule_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A page of enabled rules of two categories, by code and version."""
    rules = model.projected_rules(spark, folder).filter(F.col("enabled") & F.lower("category").isin("lifecycle", "dataaccess"))
    return tools.page(rules, [F.col("ruleCode"), F.col("version")]).rows.select("ruleCode", "version", "category", "enabled")


@query(f"WITH {_METRICS} SELECT snapshotStableKey, stableKey AS node, 'GraphFanIn' AS \"metricKind\", fan_in::DOUBLE AS \"numericValue\" FROM gm WHERE fan_in > 0")
def metric_list(spark: SparkSession, folder: str) -> DataFrame:
    m = graph_metrics(model.stored_nodes(spark, folder), model.stored_edges(spark, folder)).filter("fan_in > 0")
    rows = m.select(SNAP, F.col("stableKey").alias("node"), F.lit("GraphFanIn").alias("metricKind"), F.col("fan_in").cast("double").alias("numericValue"))
    return tools.metric_list(rows, "GraphFanIn")


@query(f"WITH {SQL_HOTSPOTS}, r AS (SELECT snapshotStableKey, category, targetStableKey AS target, row_number() OVER (PARTITION BY snapshotStableKey, category ORDER BY score DESC, targetStableKey) AS rank, targetKind FROM hs WHERE score IS NOT NULL) SELECT snapshotStableKey, category, target, rank FROM r WHERE targetKind = 'Type' AND category = 'HighFanIn'")
def hotspot_list(spark: SparkSession, folder: str) -> DataFrame:
    """Hotspots of one kind and category, with the ranks that they have among all."""
    rows = model.stored_hotspots(spark, folder).filter(F.col("score").isNotNull()).select(SNAP, "category", F.col("targetStableKey").alias("target"), "score", "targetKind")
    return ranked(rows).filter((F.col("targetKind") == "Type") & (F.col("category") == "HighFanIn")).select(SNAP, "category", "target", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SQL_EDGES}, k AS (SELECT snapshotStableKey, source, unnest(evidenceStableKeys) AS evidence FROM e) SELECT snapshotStableKey, source, count(DISTINCT evidence) AS evidence, string_agg(DISTINCT evidence, ' ' ORDER BY evidence) AS keys FROM k WHERE evidence IS NOT NULL GROUP BY 1, 2")
def evidence_references(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct evidence behind the links of each node."""
    spread = model.stored_edges(spark, folder).select(SNAP, "source", F.explode("evidenceStableKeys").alias("evidence")).filter(F.col("evidence").isNotNull()).distinct()
    return spread.groupBy(SNAP, "source").agg(F.count("*").alias("evidence"), F.array_join(F.array_sort(F.collect_list("evidence")), " ").alias("keys"))


@query(f"WITH {SQL_NODES} SELECT snapshotStableKey, reason, min(stableKey) AS first, count(*) AS nodes FROM (SELECT snapshotStableKey, stableKey, unknownState.unknownReason AS reason FROM n WHERE unknownState.hasUnknownData) GROUP BY 1, 2")
def unknowns_once(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown reasons of each snapshot once, with the first node that has it."""
    rows = model.stored_nodes(spark, folder).filter("unknownState.hasUnknownData").select(SNAP, "stableKey", F.col("unknownState.unknownReason").alias("reason"))
    first = tools.first_by(rows, [SNAP, "reason"], [F.col("stableKey")]).withColumnRenamed("stableKey", "first")
    return first.join(rows.groupBy(SNAP, "reason").agg(F.count("*").alias("nodes")), [SNAP, "reason"])


@query(f"WITH {SQL_PROJECTION}, pg AS (SELECT pf.* FROM pf WHERE severity = 'High' ORDER BY severity DESC, ruleCode, stableKey, snapshotStableKey LIMIT 100) SELECT stableKey, title FROM pg WHERE contains(lower(title), 'click') OR contains(lower(ruleCode), 'click')")
def hotlist_text_after_page(spark: SparkSession, folder: str) -> DataFrame:
    """A text filter laid on a page, which may leave fewer rows than the page has."""
    page = fnd.hotlist(model.projected_findings(spark, folder), model.projected_rules(spark, folder), {"severity": "High"}, 1, 100)
    return page.filter(contains_ci("title", "Click") | contains_ci("ruleCode", "Click")).select("stableKey", "title")


@query(f"WITH {SQL_NODES}, {SQL_EVIDENCE} SELECT ev.snapshotStableKey, ev.stableKey, ev.filePath, count(n.stableKey) AS nodes FROM ev LEFT JOIN n ON n.snapshotStableKey = ev.snapshotStableKey AND n.primaryEvidenceStableKey = ev.stableKey GROUP BY ALL")
def evidence_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence with the number of nodes that rest on it."""
    used = model.stored_nodes(spark, folder).filter(F.col("primaryEvidenceStableKey").isNotNull()).groupBy(SNAP, F.col("primaryEvidenceStableKey").alias("stableKey")).agg(F.count("*").alias("nodes"))
    return model.stored_evidence(spark, folder).join(used, [SNAP, "stableKey"], "left").select(SNAP, "stableKey", "filePath", F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query(f"WITH {SQL_EDGES}, {SQL_NODES} SELECT e.snapshotStableKey, n.nodeKind, e.edgeKind, count(*) AS edges, min(e.confidence)::DOUBLE AS least FROM e JOIN n ON n.snapshotStableKey = e.snapshotStableKey AND n.stableKey = e.target GROUP BY 1, 2, 3")
def edges_by_target_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by the kind of node that they point at; the hub that much points at is combined before it is joined."""
    per = model.stored_edges(spark, folder).groupBy(SNAP, "target", "edgeKind").agg(F.count("*").alias("edges"), F.min("confidence").alias("least"))
    kinds = model.stored_nodes(spark, folder).select(SNAP, F.col("stableKey").alias("target"), "nodeKind")
    return per.join(kinds, [SNAP, "target"]).groupBy(SNAP, "nodeKind", "edgeKind").agg(F.sum("edges").alias("edges"), F.min("least").cast("double").alias("least"))
