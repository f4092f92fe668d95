"""Queries over the projected graph, rules over the stored one, and functions over texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import columns as fn
from gneiss.operators import findings as fnd
from gneiss.operators import extract, hotspots, layering, metrics, rules, services
from gneiss.plans import model
from gneiss.plans.graph_queries import _METRICS
from gneiss.plans.model import PROJECTED, SNAP, SQL_EDGES, SQL_EVIDENCE, SQL_NODES, SQL_PROJECTION
from gneiss.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_P = SQL_PROJECTION
#: The projection made once, where several parts of a query read it.
_M = _P.replace("\npn AS (", "\npn AS MATERIALIZED (").replace("\npe AS (", "\npe AS MATERIALIZED (")


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with its SQL."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    """The projected findings with their rule's category, all in the projected snapshot."""
    found = model.projected_findings(spark, folder).withColumn(SNAP, F.lit(PROJECTED))
    return found.join(model.projected_rules(spark, folder).select("ruleCode", F.col("version").alias("ruleVersion"), F.col("category").alias("ruleCategory")), ["ruleCode", "ruleVersion"], "left")


# ---- metrics ------------------------------------------------------------------------------------------------------------------
_TF = """json_extract_string(metadata, '$."project.targetFramework"')"""
_HIT = "hit AS (SELECT DISTINCT stableKey, unnest(list_append(affectedNodeStableKeys, primaryNodeStableKey)) AS node FROM pf)"


@query(
    f"""WITH {_P}, {_HIT}, p AS (SELECT *, {_TF} AS tf FROM pn WHERE nodeKind = 'Project'),
i AS (SELECT target AS k, count(*) c FROM pe SEMI JOIN p ON p.stableKey = pe.source WHERE edgeKind = 'REFERENCES' GROUP BY 1), o AS (SELECT source AS k, count(*) c FROM pe WHERE edgeKind = 'REFERENCES' GROUP BY 1),
w AS (SELECT projectStableKey AS k, count(*) FILTER (nodeKind = 'Type' AND coalesce(lower(json_extract_string(metadata, '$."symbol.accessibility"')), 'public') = 'public') t, count(*) FILTER (nodeKind = 'Endpoint') ep, count(*) FILTER (nodeKind = 'DatabaseTable') da FROM pn GROUP BY 1),
h AS (SELECT node AS k, count(*) c FROM hit GROUP BY 1)
SELECT stableKey, coalesce(i.c, 0) AS incoming, coalesce(o.c, 0) AS outgoing, coalesce(json_extract_string(metadata, '$."project.packageReferenceCount"')::INT, 0) AS packages, coalesce(t, 0) AS public_types, coalesce(ep, 0) AS endpoints, coalesce(da, 0) AS data_access, coalesce(h.c, 0) AS findings,
 CASE WHEN tf IS NULL THEN NULL WHEN tf LIKE 'net10%' THEN 0 WHEN tf LIKE 'net8%' THEN 1 WHEN tf LIKE 'net6%' THEN 2 ELSE 3 END AS risk
FROM p LEFT JOIN i ON i.k = p.stableKey LEFT JOIN o ON o.k = p.stableKey LEFT JOIN w ON w.k = p.stableKey LEFT JOIN h ON h.k = p.stableKey"""
)
def project_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.project_metrics(model.projected_nodes(spark, folder), model.projected_edges(spark, folder), _findings(spark, folder))
    return out.drop(SNAP, "risk_text")


_SCOPES = """pj AS (SELECT stableKey AS project, parentNodeStableKey AS parent FROM pn WHERE nodeKind = 'Project'), gr AS (SELECT nodeKind, stableKey FROM pn WHERE nodeKind IN ('Repository', 'Solution')),
scp AS (SELECT 'Snapshot' AS scope_kind, NULL AS scope_key, project FROM pj UNION ALL SELECT 'Project', project, project FROM pj
 UNION ALL SELECT gr.nodeKind, gr.stableKey, project FROM gr JOIN pj ON pj.parent = gr.stableKey UNION ALL SELECT gr.nodeKind, gr.stableKey, project FROM gr, pj WHERE gr.stableKey NOT IN (SELECT parent FROM pj WHERE parent IS NOT NULL))"""


@query(f"WITH {_P}, {_SCOPES} SELECT scope_kind, scope_key, count(*) AS projects FROM scp GROUP BY 1, 2")
def modernization_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.modernization_scopes(model.projected_nodes(spark, folder)).groupBy("scope_kind", "scope_key").agg(F.count("*").alias("projects"))


@query(
    f"""WITH {_P}, {_SCOPES}, {_HIT},
pp AS (SELECT stableKey AS project, {_TF} AS tf, coalesce(json_extract_string(metadata, '$."project.packageReferenceCount"')::INT, 0) AS pk FROM pn WHERE nodeKind = 'Project'),
da AS (SELECT DISTINCT projectStableKey AS project FROM pn WHERE nodeKind = 'DatabaseTable'),
tb AS (SELECT DISTINCT projectStableKey AS project, lower(coalesce(json_extract_string(metadata, '$.schemaName'), 'default') || '.' || json_extract_string(metadata, '$.tableName')) AS t FROM pn WHERE nodeKind = 'DatabaseTable'),
sh AS (SELECT scope_kind, scope_key, count(*) AS n FROM (SELECT scope_kind, scope_key, t FROM scp JOIN tb USING (project) GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2),
sf AS (SELECT pf.stableKey FROM pf JOIN pr ON pr.ruleCode = pf.ruleCode AND pr.version = pf.ruleVersion WHERE severity = 'Critical' OR lower(category || ' ' || pf.ruleCode || ' ' || title) SIMILAR TO '.*(security|secret|credential).*'),
ow AS (SELECT DISTINCT hit.stableKey, CASE WHEN pn.nodeKind = 'Project' THEN pn.stableKey ELSE pn.projectStableKey END AS project FROM hit SEMI JOIN sf ON sf.stableKey = hit.stableKey JOIN pn ON pn.stableKey = hit.node),
se AS (SELECT scope_kind, scope_key, count(DISTINCT ow.stableKey) AS n FROM scp JOIN ow USING (project) GROUP BY 1, 2)
SELECT scp.scope_kind, scp.scope_key, count(*) FILTER (tf LIKE 'net4%' OR tf LIKE 'net6%') AS legacy, coalesce(any_value(se.n), 0) AS security, count(*) FILTER (tf LIKE 'net4%' OR tf LIKE 'net6%') AS out_of_support, count(*) FILTER (tf IS NULL) AS without_target,
 sum(CASE WHEN tf LIKE 'net4%' OR tf LIKE 'net6%' THEN pk ELSE 0 END)::BIGINT AS framework_only, count(da.project) AS data_access_spread, coalesce(any_value(sh.n), 0) AS shared_tables, bool_or(da.project IS NOT NULL) AS has_tables
FROM scp JOIN pp USING (project) LEFT JOIN da USING (project) LEFT JOIN sh ON sh.scope_kind = scp.scope_kind AND sh.scope_key IS NOT DISTINCT FROM scp.scope_key LEFT JOIN se ON se.scope_kind = scp.scope_kind AND se.scope_key IS NOT DISTINCT FROM scp.scope_key GROUP BY 1, 2"""
)
def modernization_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.modernization_metrics(model.projected_nodes(spark, folder), _findings(spark, folder)).drop(SNAP)


@query(
    f"""WITH {_P}, x AS (SELECT DISTINCT snapshotStableKey s, stableKey k, confidence, CASE WHEN hasUnknownData THEN unknownReason END AS u, unnest(affectedNodeStableKeys) AS target FROM pf WHERE status = 'Open')
SELECT s AS snapshotStableKey, target, count(*)::DOUBLE AS score, min(confidence)::DOUBLE AS confidence, string_agg(DISTINCT u, '; ' ORDER BY u) AS unknown_reason, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, target) AS rank FROM x GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def finding_concentration(spark: SparkSession, folder: str) -> DataFrame:
    found = hotspots.ranked(hotspots.finding_concentration(model.projected_findings(spark, folder)))
    return found.select(SNAP, "target", F.col("score").cast("double").alias("score"), F.col("confidence").cast("double").alias("confidence"), "unknown_reason", F.col("rank").cast("long").alias("rank"))


# ---- findings and rules -------------------------------------------------------------------------------------------------------
@query(f"WITH {_P} SELECT historyKey, min(snapshotStableKey) AS first_seen, max(snapshotStableKey) AS latest_seen, count(*) AS records FROM pf GROUP BY 1")
def finding_history(spark: SparkSession, folder: str) -> DataFrame:
    return fnd.history(model.projected_findings(spark, folder))


_PAGE = "SELECT pf.*, pr.category FROM pf LEFT JOIN pr ON pr.ruleCode = pf.ruleCode AND pr.version = pf.ruleVersion WHERE pf.status = 'Open' ORDER BY severity DESC, pf.ruleCode, pf.stableKey, snapshotStableKey LIMIT 200 OFFSET 200"


@query(f"WITH {_P} SELECT stableKey, severity, ruleCode, category FROM ({_PAGE})")
def hotlist(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of open findings; more than the largest page is asked for."""
    page = fnd.hotlist(model.projected_findings(spark, folder), model.projected_rules(spark, folder), {"status": "Open"}, 2, 500)
    return page.select("stableKey", "severity", "ruleCode", "category")


@query(f"WITH {_P} SELECT stableKey, severity, row_number() OVER (ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, ruleCode, stableKey) AS position FROM ({_PAGE})")
def hotlist_by_true_severity(spark: SparkSession, folder: str) -> DataFrame:
    page = fnd.hotlist(model.projected_findings(spark, folder), model.projected_rules(spark, folder), {"status": "Open"}, 2, 200)
    return fnd.resorted(page).select("stableKey", "severity", F.col("position").cast("long").alias("position"))


@query(f"WITH {_P}, x AS (SELECT DISTINCT stableKey, severity, unnest(affectedNodeStableKeys) AS node FROM pf) SELECT node, count(*) AS findings, arg_max(severity, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS highest FROM x GROUP BY 1")
def highest_severity(spark: SparkSession, folder: str) -> DataFrame:
    return fnd.highest_severity(model.projected_findings(spark, folder))


@query(f"WITH {_P}, s AS (SELECT ruleCode, ruleVersion, primaryNodeStableKey, historyKey, min('accepted ' || severity) AS reason FROM pf WHERE severity = 'Low' GROUP BY ALL) SELECT pf.stableKey, CASE WHEN reason IS NULL THEN status ELSE 'Suppressed' END AS status, reason AS suppressionReason FROM pf LEFT JOIN s USING (ruleCode, ruleVersion, primaryNodeStableKey, historyKey)")
def suppressed_findings(spark: SparkSession, folder: str) -> DataFrame:
    found = model.projected_findings(spark, folder)
    accepted = found.filter(F.col("severity") == "Low").select("ruleCode", "ruleVersion", "primaryNodeStableKey", "historyKey", F.concat(F.lit("accepted "), "severity").alias("reason"))
    return fnd.suppressed(found, accepted).select("stableKey", "status", "suppressionReason")


@query(f"WITH {_P} SELECT ruleCode, version, category, enabled FROM pr QUALIFY row_number() OVER (PARTITION BY ruleCode ORDER BY version DESC) = 1")
def latest_rule_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version as text: 9.0.0 comes after 10.0.0."""
    return rules.latest_versions(model.projected_rules(spark, folder)).select("ruleCode", "version", "category", "enabled")


def _catalog() -> list[rules.Rule]:
    return rules.load_rules(Path(__file__).parent / "rules")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = model.stored_nodes(spark, folder), model.stored_edges(spark, folder)
    fan = metrics.graph_metrics(nodes, edges).select(SNAP, F.col("stableKey").alias("node"), F.lit("GraphFanIn").alias("metricKind"), F.col("fan_in").cast("decimal(38,6)").alias("numericValue"))
    return rules.node_facts(nodes, edges, model.stored_evidence(spark, folder), fan)


_DOT = "list_filter(list_transform(string_split(n.qualifiedName, '.'), lambda x: trim(x)), lambda x: x <> '')"
_SPACE = f"CASE WHEN len({_DOT}) > 2 THEN array_to_string({_DOT}[1:-3], '.') END"
_MATCH = f"""{_METRICS}, {SQL_EVIDENCE},
fx AS (SELECT n.*, {_TF.replace('metadata', 'n.metadata')} AS tf, {_SPACE} AS ns, gm.fan_in AS fi, ev.filePath AS fp FROM n LEFT JOIN gm ON gm.snapshotStableKey = n.snapshotStableKey AND gm.stableKey = n.stableKey LEFT JOIN ev ON ev.snapshotStableKey = n.snapshotStableKey AND ev.stableKey = n.primaryEvidenceStableKey),
mt AS (SELECT snapshotStableKey, 'RT-RETIRED' AS rule_code, stableKey AS node, confidence, 0.9 AS rc, unknownState FROM fx WHERE nodeKind = 'Project' AND (tf IN ('net6.0', 'net7.0') OR tf SIMILAR TO 'net4.')
 UNION ALL SELECT snapshotStableKey, 'RT-BUSY-DOMAIN', stableKey, confidence, 0.8, unknownState FROM fx WHERE nodeKind IN ('Type', 'Method') AND contains(ns, '.Domain') AND fi >= 2 AND NOT coalesce(qualifiedName LIKE '%Store' OR qualifiedName LIKE '%Policy', false) AND NOT (displayName LIKE '%Store' OR displayName LIKE '%Policy')
 UNION ALL SELECT snapshotStableKey, 'RT-OUTSIDE-TESTS', stableKey, confidence, 1.0, unknownState FROM fx WHERE nodeKind = 'Type' AND NOT coalesce(fp SIMILAR TO 'src/.*/Tests/.*', false) AND NOT true)"""


@query(f"WITH {_MATCH} SELECT snapshotStableKey, rule_code, node FROM mt")
def rule_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All rules of the catalog over all nodes in one scan: groups of all, any and none, texts, patterns and metrics."""
    return rules.evaluate(_facts(spark, folder), _catalog()).select(SNAP, "rule_code", "node")


@query(f"WITH {_MATCH} SELECT snapshotStableKey, rule_code AS \"ruleCode\", node AS \"primaryNodeStableKey\", round(least(1, greatest(0, rc::DECIMAL(3,2) * confidence * (1 - least(0.5, (CASE WHEN unknownState.hasUnknownData THEN 1 ELSE 0 END) * 0.05)::DECIMAL(3,2)))), 2)::DOUBLE AS confidence FROM mt")
def findings_of_rules(spark: SparkSession, folder: str) -> DataFrame:
    made = fnd.findings_of(rules.evaluate(_facts(spark, folder), _catalog()))
    return made.select(SNAP, "ruleCode", "primaryNodeStableKey", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {SQL_NODES}, {SQL_EVIDENCE}, fx AS (SELECT n.*, {_TF.replace('metadata', 'n.metadata')} AS tf, {_SPACE} AS ns, ev.filePath AS fp FROM n LEFT JOIN ev ON ev.snapshotStableKey = n.snapshotStableKey AND ev.stableKey = n.primaryEvidenceStableKey) SELECT snapshotStableKey, 'RT-RETIRED' AS rule_code, stableKey AS node, 'target-framework-membership' AS kind FROM fx WHERE nodeKind = 'Project' AND tf IS NULL UNION ALL SELECT snapshotStableKey, 'RT-BUSY-DOMAIN', stableKey, 'namespace' FROM fx WHERE nodeKind IN ('Type', 'Method') AND ns IS NULL UNION ALL SELECT snapshotStableKey, 'RT-OUTSIDE-TESTS', stableKey, 'namespace' FROM fx WHERE nodeKind = 'Type' AND ns IS NULL UNION ALL SELECT snapshotStableKey, 'RT-OUTSIDE-TESTS', stableKey, 'file-pattern' FROM fx WHERE nodeKind = 'Type' AND fp IS NULL")
def rule_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions that lack facts; conditions in inner groups count as well."""
    return rules.warnings(_facts(spark, folder), _catalog())


_LY = "CASE {} ELSE nodeKind END".format(" ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{w.lower()}{chr(39)})' for w in words)} THEN '{name}'" for name, words in layering.LAYERS))
_WEB = "(contains(lower({0}), 'web') OR contains(lower({0}), 'api') OR contains(lower({0}), 'host') OR contains(lower({0}), 'ui'))"


def _layers_sql(nodes: str) -> str:
    return f"ly AS (SELECT snapshotStableKey, stableKey, nodeKind, metadata, coalesce(json_extract_string(metadata, '$.\"architecture.layer\"'), {_LY}) AS layer FROM (SELECT *, lower(concat_ws(' ', displayName, qualifiedName, stableKey)) AS x FROM {nodes}))"


_VIOLATIONS = f"""dp AS (SELECT e.snapshotStableKey s, e.stableKey edge, e.source, e.target, a.layer f, b.layer t FROM e JOIN ly a ON a.snapshotStableKey = e.snapshotStableKey AND a.stableKey = e.source JOIN ly b ON b.snapshotStableKey = e.snapshotStableKey AND b.stableKey = e.target WHERE edgeKind IN ('REFERENCES', 'DEPENDS_ON', 'CALLS', 'CALLS_API', 'INJECTS')),
vi AS (SELECT s AS snapshotStableKey, 'domain-references-infrastructure' AS rule, source AS target, edge, target AS other FROM dp WHERE contains(lower(f), 'domain') AND contains(lower(t), 'infrastructure')
 UNION ALL SELECT s, 'domain-references-web', source, edge, target FROM dp WHERE contains(lower(f), 'domain') AND {_WEB.format('t')} UNION ALL SELECT s, 'web-referenced-by-non-web', target, edge, source FROM dp WHERE NOT {_WEB.format('f')} AND {_WEB.format('t')})"""


@query(f"WITH {SQL_NODES}, {_layers_sql('n')} SELECT snapshotStableKey, stableKey, layer FROM ly")
def layers(spark: SparkSession, folder: str) -> DataFrame:
    return layering.layered(model.stored_nodes(spark, folder)).select(SNAP, "stableKey", "layer")


@query(f"WITH {SQL_NODES}, {SQL_EDGES}, {_layers_sql('n')}, {_VIOLATIONS} SELECT * FROM vi")
def architecture_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = layering.layering_violations(model.stored_nodes(spark, folder), model.stored_edges(spark, folder))
    return found.select(SNAP, "rule", "target", "edge", "other")


_PS = f"pns AS (SELECT '{PROJECTED}' AS snapshotStableKey, * FROM pn)"


@query(f"WITH {_P}, {_PS}, {_layers_sql('pns')}, fi AS (SELECT target AS k, count(*) c FROM pe GROUP BY 1) SELECT stableKey AS target, 'shared-library-high-fan-in' AS rule, 'ReviewRequired' AS status FROM ly JOIN fi ON fi.k = ly.stableKey WHERE c >= 2 AND (contains(lower(layer), 'shared') OR contains(lower(layer), 'common')) UNION ALL SELECT stableKey, 'worker-missing-messaging', 'Unknown' FROM pns WHERE nodeKind = 'HostedService' AND metadata LIKE '%messagingExpected%' AND stableKey NOT IN (SELECT source FROM pe JOIN pn q ON q.stableKey = pe.target WHERE q.nodeKind IN ('Queue', 'Topic'))")
def architecture_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Shared libraries that much depends on, and workers without messages."""
    nodes, edges = model.projected_nodes(spark, folder), model.projected_edges(spark, folder)
    shared = layering.shared_libraries(nodes, metrics.graph_metrics(nodes, edges), 2)
    silent = layering.silent_workers(nodes, edges)
    return shared.unionByName(silent).select("target", "rule", "status")


@query(f"WITH {_P}, {SQL_NODES}, {SQL_EDGES}, {_layers_sql('n')}, {_VIOLATIONS}, sw AS (SELECT * FROM (VALUES ('domain-references-web', '1.0.0', true), ('domain-references-web', '2.0.0', false), ('web-referenced-by-non-web', '1.0.0', false), ('web-referenced-by-non-web', '1.1.0', true)) v(rule, version, enabled) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY version DESC) = 1) SELECT vi.rule, count(*) AS results FROM vi LEFT JOIN sw ON sw.rule = vi.rule WHERE coalesce(enabled, true) GROUP BY 1")
def enabled_rules_only(spark: SparkSession, folder: str) -> DataFrame:
    switches = spark.createDataFrame([("domain-references-web", "1.0.0", True), ("domain-references-web", "2.0.0", False), ("web-referenced-by-non-web", "1.0.0", False), ("web-referenced-by-non-web", "1.1.0", True)], "ruleCode string, version string, enabled boolean")
    found = layering.layering_violations(model.stored_nodes(spark, folder), model.stored_edges(spark, folder))
    return layering.enabled_only(found, switches).groupBy("rule").agg(F.count("*").alias("results"))


# ---- services -----------------------------------------------------------------------------------------------------------------
_PINC = "inc AS (SELECT source AS node, stableKey AS edge, edgeKind, target AS other FROM pe UNION ALL SELECT target, stableKey, edgeKind, source FROM pe WHERE source <> target)"


@query(f"WITH {_P}, {_PINC}, us AS (SELECT node, string_agg(DISTINCT displayName, ', ' ORDER BY displayName) AS uses FROM inc JOIN pn ON pn.stableKey = inc.other WHERE edgeKind IN ('INJECTS', 'CALLS', 'REFERENCES') GROUP BY 1) SELECT stableKey, json_extract_string(metadata, '$.\"endpoint.httpMethod\"') AS method, json_extract_string(metadata, '$.\"endpoint.route\"') AS route, projectStableKey AS project, coalesce(uses, '') AS uses FROM pn LEFT JOIN us ON us.node = pn.stableKey WHERE nodeKind = 'Endpoint'")
def runtime_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return services.runtime_endpoints(model.projected_nodes(spark, folder), model.projected_edges(spark, folder)).drop(SNAP)


@query(f"WITH {_P}, o AS (SELECT projectStableKey k, count(*) FILTER (nodeKind = 'HostedService') s, count(*) FILTER (nodeKind = 'Endpoint') e FROM pn GROUP BY 1) SELECT 'entrypoint://' || stableKey AS key, CASE json_extract_string(metadata, '$.\"application.type\"') WHEN 'Api' THEN 'Api' WHEN 'Worker' THEN 'Worker' ELSE 'Console' END AS runtime_kind, stableKey AS project, coalesce(s, 0) AS services, coalesce(e, 0) AS endpoints FROM pn LEFT JOIN o ON o.k = pn.stableKey WHERE nodeKind = 'Project'")
def entry_points(spark: SparkSession, folder: str) -> DataFrame:
    return services.entry_points(model.projected_nodes(spark, folder)).drop(SNAP)


@query(f"WITH {_P}, {_PINC}, sv AS (SELECT stableKey k, projectStableKey p FROM pn WHERE nodeKind = 'HostedService'), q AS (SELECT stableKey k, projectStableKey p FROM pn WHERE nodeKind = 'Queue'), cv AS (SELECT sv.k s, q.k q FROM sv JOIN q ON q.p = sv.p UNION SELECT sv.k, q.k FROM inc JOIN sv ON sv.k = inc.node JOIN q ON q.k = inc.other) SELECT sv.k AS key, 'HostedService' AS worker_kind, count(cv.q) AS consumers FROM sv LEFT JOIN cv ON cv.s = sv.k GROUP BY 1 UNION ALL SELECT k, 'Consumer', 1 FROM q WHERE k NOT IN (SELECT q FROM cv)")
def workers(spark: SparkSession, folder: str) -> DataFrame:
    return services.workers(model.projected_nodes(spark, folder), model.projected_edges(spark, folder)).drop(SNAP)


@query(f"WITH {_P}, {_PINC}, x AS (SELECT inc.* FROM inc SEMI JOIN pn ON pn.stableKey = inc.node AND pn.nodeKind = 'DatabaseTable'), o AS (SELECT node, string_agg(DISTINCT CASE edgeKind WHEN 'READS_TABLE' THEN 'Read' END, ', ') AS ops, count(DISTINCT pn.stableKey) AS rel FROM x LEFT JOIN pn ON pn.stableKey = x.other GROUP BY 1) SELECT stableKey, 'Table' AS family, projectStableKey AS project, coalesce(ops, '') AS operations, coalesce(rel, 0) AS related FROM pn LEFT JOIN o ON o.node = pn.stableKey WHERE nodeKind = 'DatabaseTable'")
def data_access_facts(spark: SparkSession, folder: str) -> DataFrame:
    return services.data_access_facts(model.projected_nodes(spark, folder), model.projected_edges(spark, folder)).drop(SNAP)


@query(f"WITH {_M}, u AS (SELECT target AS node, string_agg(DISTINCT source, ', ' ORDER BY source) AS consumers FROM pe SEMI JOIN pn ON pn.stableKey = pe.source AND pn.nodeKind <> 'ConfigurationKey' WHERE edgeKind = 'USES_CONFIG' GROUP BY 1) SELECT stableKey, displayName AS key, projectStableKey AS project, coalesce(consumers, '') AS consumers, json_extract_string(metadata, '$.provider') AS provider, contains(lower(displayName), 'secret') AS secret_like FROM pn LEFT JOIN u ON u.node = pn.stableKey WHERE nodeKind = 'ConfigurationKey'")
def configuration_usage(spark: SparkSession, folder: str) -> DataFrame:
    return services.configuration_usage(model.projected_nodes(spark, folder), model.projected_edges(spark, folder)).drop(SNAP)


@query(f"WITH {_P} SELECT stableKey, nodeKind AS kind, CASE WHEN nodeKind = 'Queue' THEN displayName WHEN metadata LIKE '%https%' THEN regexp_extract(metadata, '@([a-z0-9.]+)/', 1) ELSE displayName END AS host, CASE nodeKind WHEN 'Queue' THEN 'amqp' ELSE 'HTTP' END AS protocol, projectStableKey AS project FROM pn WHERE nodeKind = 'Queue' OR nodeKind = 'ExternalService' AND metadata NOT LIKE '%token%'")
def integration_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Outside targets by safe host; a secret-like one is left out."""
    return services.integration_facts(model.projected_nodes(spark, folder)).drop(SNAP)


@query(f"WITH {_P} SELECT stableKey, CASE WHEN contains(lower(qualifiedName), 'blazor') THEN 'Blazor' WHEN contains(lower(qualifiedName), 'winforms') THEN 'Windows Forms' ELSE 'Unknown UI Technology' END AS technology, nodeKind AS kind, projectStableKey AS project, json_extract_string(metadata, '$.route') AS route FROM pn WHERE nodeKind = 'UiPage'")
def ui_facts(spark: SparkSession, folder: str) -> DataFrame:
    return services.ui_facts(model.projected_nodes(spark, folder)).drop(SNAP)


_CAT = f"""sp AS (SELECT DISTINCT stableKey, severity, hasUnknownData, unnest(list_append(affectedNodeStableKeys, primaryNodeStableKey)) AS node FROM pf), fl AS (SELECT node, count(*) c, arg_max(severity, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) h, bool_or(hasUnknownData) u FROM sp GROUP BY 1),
dg AS (SELECT node, count(*) FILTER (r = 'o') o, count(*) FILTER (r = 'i') i, count(*) FILTER (r = 'p') p FROM (SELECT source AS node, CASE edgeKind WHEN 'USES_PACKAGE' THEN 'p' ELSE 'o' END r FROM pe WHERE edgeKind IN ('REFERENCES', 'DEPENDS_ON', 'USES_PACKAGE') UNION ALL SELECT target, 'i' FROM pe WHERE edgeKind IN ('REFERENCES', 'DEPENDS_ON')) GROUP BY 1),
ow AS (SELECT projectStableKey k, count(*) FILTER (nodeKind = 'Endpoint') e, CASE WHEN bool_or(nodeKind = 'DatabaseTable') THEN 'DatabaseTable' ELSE '' END d FROM pn GROUP BY 1),
ct AS (SELECT pn.stableKey, displayName AS name, json_extract_string(metadata, '$."architecture.layer"') AS type, coalesce(o, 0) AS dependencies, coalesce(i, 0) AS dependents, coalesce(p, 0) AS packages, coalesce(e, 0) AS endpoints, coalesce(d, '') AS data_access, coalesce(c, 0) AS findings, h AS highest, c IS NOT NULL AS has_findings, coalesce(u, false) AS has_unknown
 FROM pn LEFT JOIN dg ON dg.node = pn.stableKey LEFT JOIN ow ON ow.k = pn.stableKey LEFT JOIN fl ON fl.node = pn.stableKey WHERE nodeKind = 'Project')"""


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return services.project_catalogue(model.projected_nodes(spark, folder), model.projected_edges(spark, folder), _findings(spark, folder))


@query(f"WITH {_P}, {_CAT} SELECT * FROM ct")
def project_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return _catalogue(spark, folder).drop(SNAP)


@query(f"WITH {_P}, {_CAT} SELECT stableKey, packages FROM ct WHERE contains(lower(name), 'supplier') AND lower(type) = 'web' AND (has_findings = true OR has_unknown = true) ORDER BY packages DESC, stableKey LIMIT 10 OFFSET 1")
def project_catalogue_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page by packages; asking for risk passes projects with findings or with unknowns."""
    return services.catalogue_page(_catalogue(spark, folder), "SUPPLIER", "web", True, "packages", True, 1, 10).select("stableKey", "packages")


@query(f"WITH {_P} SELECT p.stableKey, string_agg(DISTINCT k.displayName, ', ' ORDER BY k.displayName) AS packages, count(*) AS edges FROM pn p JOIN pe ON pe.source = p.stableKey AND pe.edgeKind = 'USES_PACKAGE' JOIN pn k ON k.stableKey = pe.target AND k.nodeKind = 'Package' WHERE p.nodeKind = 'Project' GROUP BY 1")
def project_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The packages of every project."""
    nodes, edges = model.projected_nodes(spark, folder), model.projected_edges(spark, folder)
    packages = nodes.filter(F.col("nodeKind") == "Package").select(F.col("stableKey").alias("target"), "displayName")
    projects = nodes.filter(F.col("nodeKind") == "Project").select(F.col("stableKey").alias("source"))
    used = edges.filter(F.col("edgeKind") == "USES_PACKAGE").join(packages, "target").join(projects, "source", "left_semi")
    return used.groupBy(F.col("source").alias("stableKey")).agg(F.array_join(F.array_sort(F.collect_set("displayName")), ", ").alias("packages"), F.count("*").alias("edges"))


# ---- functions over texts -----------------------------------------------------------------------------------------------------
@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS snippet, sha256(text) AS hash, CASE WHEN coalesce(text, '') = '' THEN NULL WHEN regexp_matches(lower(text), 'password|secret|token|apikey|connectionstring|credential') THEN '[redacted secret-like evidence preview]' ELSE substr(text, 1, 240) END AS preview FROM documents")
def text_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets, hashes and redacted previews of whole texts."""
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", fn.bounded(F.trim(F.regexp_replace("text", r"\s+", " ")), 160).alias("snippet"), F.sha2("text", 256).alias("hash"), fn.preview("text", 240).alias("preview"))


@query(r"SELECT file_id, regexp_extract(absolutePath, '([^/\\]*)$', 1) AS name, CASE WHEN NOT regexp_matches(replace(absolutePath, '\', '/'), '^(/|[A-Za-z]:)') THEN replace(absolutePath, '\', '/') END AS relative, regexp_matches(lower(replace(absolutePath, '\', '/')), '\.(designer|g|g\.i|generated)\.(cs|vb)$|/generated/|/obj/') AS generated_path FROM source_files")
def path_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Names of files, relative paths (none of these is one), and the test of generated paths."""
    low = F.lower(F.regexp_replace("absolutePath", r"\\", "/"))
    return table(spark, folder, "source_files").select("file_id", fn.file_name("absolutePath").alias("name"), fn.relative_path("absolutePath").alias("relative"), low.rlike(r"\.(designer|g|g\.i|generated)\.(cs|vb)$|/generated/|/obj/").alias("generated_path"))


@query(f"""WITH {SQL_NODES} SELECT snapshotStableKey, stableKey, 'sha256:' || sha256('category=node' || chr(10) || 'field:displayName=' || displayName || chr(10) || 'field:nodeKind=' || nodeKind || chr(10) || 'field:qualifiedName=' || coalesce(qualifiedName, '<null>') || chr(10) || 'metadata=' || metadata || chr(10)) AS fingerprint FROM n""")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"nodeKind": F.col("nodeKind"), "displayName": F.col("displayName"), "qualifiedName": F.col("qualifiedName")}
    return model.stored_nodes(spark, folder).select(SNAP, "stableKey", fn.fingerprint("node", fields, F.col("metadata")).alias("fingerprint"))


_STATEMENT = "concat(CASE doc_id % 5 WHEN 0 THEN 'SELECT a, b FROM [sales].[Doc' WHEN 1 THEN 'INSERT INTO Doc' WHEN 2 THEN 'UPDATE audit.Doc' WHEN 3 THEN 'delete from Doc' ELSE 'MERGE Doc' END, doc_id, CASE doc_id % 5 WHEN 0 THEN concat('] x JOIN Log', doc_id, ' ON (1=1)') WHEN 1 THEN ' VALUES (1)' WHEN 2 THEN ' SET a=1;Password=pw' WHEN 3 THEN ' WHERE a=1' ELSE ' USING Src ON 1=1' END)"


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' ELSE 'MERGE' END AS verb,
CASE doc_id % 5 WHEN 0 THEN 'sales.Doc' || doc_id || ', dbo.Log' || doc_id WHEN 1 THEN 'dbo.Doc' || doc_id WHEN 2 THEN 'audit.Doc' || doc_id WHEN 3 THEN 'dbo.Doc' || doc_id ELSE 'dbo.Doc' || doc_id || ', dbo.Src' END AS tables, doc_id % 5 = 2 AS redacted FROM documents"""
)
def sql_affected_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Verb and tables of one statement made of each document's id, and whether a password in it is blanked."""
    tokens = fn.sql_tokens("statement")
    rows = table(spark, folder, "documents").select("doc_id", F.expr(_STATEMENT).alias("statement"))
    return rows.select("doc_id", fn.sql_verb(tokens).alias("verb"), F.array_join(fn.sql_tables(tokens), ", ").alias("tables"), F.contains(fn.redact_sql("statement"), F.lit("[REDACTED]")).alias("redacted"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, json_type(props, '$.k') = 'VARCHAR' AS is_text FROM events")
def json_reads(spark: SparkSession, folder: str) -> DataFrame:
    """A member as a number; it is none as a text, as types are strict."""
    rows = table(spark, folder, "events")
    return rows.select("event_id", fn.metadata_int("props", "k").alias("k"), F.coalesce(fn.metadata_text("props", "k").isNotNull(), F.lit(False)).alias("is_text"))


@query("SELECT file_id, coalesce(len(regexp_extract_all(replace(sourceText, chr(13), ''), '(?m)^\\s*using\\s+[\\w.]+;')), 0) AS usings, coalesce(len(regexp_extract_all(sourceText, 'new\\s+([A-Z]\\w*)\\(')), 0) AS creations FROM source_files WHERE lower(absolutePath) LIKE '%.cs'")
def source_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by regular expressions over whole source texts."""
    rows = table(spark, folder, "source_files").filter(F.lower("absolutePath").endswith(".cs"))
    count = lambda pattern: F.coalesce(F.regexp_count(F.regexp_replace("sourceText", "\r", ""), F.lit(pattern)), F.lit(0))
    return rows.select("file_id", count(r"(?m)^\s*using\s+[\w.]+;").alias("usings"), count(r"new\s+([A-Z]\w*)\(").alias("creations"))


@query(r"""WITH f AS (SELECT file_id, sourceText t FROM source_files WHERE sourceText IS NOT NULL AND lower(absolutePath) LIKE '%.config'), k AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(t, '<add\s[^>]*?\b(?:key|name)\s*=\s*"([^"]+)"', 1)) AS name FROM f)
SELECT file_id, name, 'xml' AS source, regexp_matches(lower(name), 'password|secret|token|apikey|connectionstring|credential') AS secret_like FROM k""")
def xml_configuration_keys(spark: SparkSession, folder: str) -> DataFrame:
    return extract.configuration_keys(table(spark, folder, "source_files"), "file_id", "absolutePath", "sourceText").filter(F.col("source") == "xml")


@query(r"""WITH RECURSIVE f AS (SELECT file_id, TRY_CAST(sourceText AS JSON) j FROM source_files WHERE sourceText IS NOT NULL AND lower(absolutePath) LIKE '%.json'),
w(file_id, name, j) AS (SELECT file_id, k, json_extract(j, '$."' || k || '"') FROM (SELECT file_id, j, unnest(json_keys(j)) AS k FROM f WHERE json_type(j) = 'OBJECT') UNION ALL SELECT file_id, name || ':' || k, json_extract(j, '$."' || k || '"') FROM (SELECT file_id, name, j, unnest(json_keys(j)) AS k FROM w WHERE json_type(j) = 'OBJECT'))
SELECT file_id, name, 'json' AS source, regexp_matches(lower(name), 'password|secret|token|apikey|connectionstring|credential') AS secret_like FROM w WHERE json_type(j) <> 'OBJECT'""")
def json_configuration_keys(spark: SparkSession, folder: str) -> DataFrame:
    return extract.configuration_keys(table(spark, folder, "source_files"), "file_id", "absolutePath", "sourceText").filter(F.col("source") == "json")


_DECLARED = r"(?m)^[ \t]*(?:(?:public|internal|private|protected|static|sealed|abstract|partial|readonly|file)\s+)*(class|struct|interface|enum|record)\s+([A-Za-z_]\w*)"


@query(rf"""WITH f AS (SELECT file_id, sourceText t FROM source_files WHERE sourceText IS NOT NULL AND lower(absolutePath) LIKE '%.cs'), d AS (SELECT file_id, regexp_extract(t, '(?m)^\s*namespace\s+([\w.]+)', 1) AS namespace, unnest(regexp_extract_all(t, '{_DECLARED}', 1)) AS kind, unnest(regexp_extract_all(t, '{_DECLARED}', 2)) AS name FROM f) SELECT * FROM d""")
def declared_types(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").filter(F.lower("absolutePath").endswith(".cs"))
    return extract.declared_types(files, "file_id", "sourceText")


@query(
    """WITH c AS (SELECT event_id AS call, CASE event_id % 2 WHEN 0 THEN 'GET' ELSE 'post' END m, event_type || '/' || (user_id % 7) r, CASE event_id % 3 WHEN 0 THEN NULL ELSE 'https://S' || (event_id % 4) END b FROM events),
e AS (SELECT DISTINCT event_type || '/' || (user_id % 7) || '/' || (event_id % 2) || '/' || CASE WHEN event_id % 5 = 0 THEN (event_id % 4)::VARCHAR ELSE 'x' || (event_id % 5) END AS endpoint, CASE event_id % 2 WHEN 0 THEN 'get' ELSE 'POST' END m, event_type || '/' || (user_id % 7) r, 'HTTPS://s' || CASE WHEN event_id % 5 = 0 THEN (event_id % 4)::VARCHAR ELSE 'x' || (event_id % 5) END b FROM events),
j AS (SELECT call, c.b IS NULL AS free, endpoint, coalesce(lower(c.b) = lower(e.b), false) AS owned FROM c LEFT JOIN e ON lower(c.m) = lower(e.m) AND lower(c.r) = lower(e.r)),
g AS (SELECT call, count(*) FILTER (owned) o, max(endpoint) FILTER (owned) oe, count(endpoint) n, max(endpoint) x, bool_and(free) f FROM j GROUP BY 1)
SELECT call, CASE WHEN o = 1 THEN oe WHEN f AND n = 1 THEN x END AS endpoint, CASE WHEN o = 1 OR f AND n = 1 THEN 'matched' ELSE 'unknown' END AS state FROM g"""
)
def internal_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls made of the events, matched with endpoints made of them; those of every fifth stand on the hosts that are called."""
    rows = table(spark, folder, "events")
    none = F.lit(None).cast("string")
    route = F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), (F.col("user_id") % 7).cast("string"))
    half, quarter = (F.col("event_id") % 2).cast("string"), (F.col("event_id") % 4).cast("string")
    calls = rows.select(F.col("event_id").alias("call"), F.when(half == "0", "GET").otherwise("post").alias("method"), F.concat(route, F.lit("?x=1")).alias("route"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("https://S"), quarter)).alias("base_url"), none.alias("config_key"))
    host = F.when(F.col("event_id") % 5 == 0, quarter).otherwise(F.concat(F.lit("x"), (F.col("event_id") % 5).cast("string")))
    name = F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string"), half, host)
    endpoints = rows.select(name.alias("endpoint"), F.when(half == "0", "get").otherwise("POST").alias("method"), F.concat(route, F.lit("/")).alias("route"), F.concat(F.lit("HTTPS://s"), host).alias("base_url"), none.alias("config_key")).distinct()
    return extract.match_calls(calls, endpoints)


@query("SELECT o_orderkey AS run, o_orderdate AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A history of runs, newest first; orders stand for runs."""
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("runId"), F.col("o_orderdate").alias("startedUtc"))
    return extract.recent_runs(runs, 25).select(F.col("runId").alias("run"), F.col("startedUtc").alias("started"))
