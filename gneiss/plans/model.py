"""The architecture graph as the queries see it.

``stored_*`` read the tables of a data folder (versions resolved, deleted records left out). ``projected_*`` lay the sales tables out
as a graph of one more snapshot, with the kinds of node that the stored graph lacks. Each has its SQL twin as a common table
expression, written independently for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.versions import holding
from gneiss.sources.tables import table
from gneiss.work import on_release, staged

SNAP = "snapshotStableKey"
PROJECTED = "snapshot://projected"


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot headers, repeated rows once."""
    return table(spark, folder, "snapshots").dropDuplicates(["stableKey"])


def stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["nodeKind", "displayName", "qualifiedName", "searchName", "language", "projectStableKey", "parentNodeStableKey", "ownership", "externalCategory", "primaryEvidenceStableKey", "knowledgeKind", "confidence", "unknownState", "metadata", "fingerprint", "deletedUtc"]
    return holding(table(spark, folder, "nodes"), columns).filter(F.col("deletedUtc").isNull()).drop("deletedUtc")


def stored_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Links that hold, with both ends; kinds in their one spelling. A fingerprint is taken of what a link says."""
    rows = holding(table(spark, folder, "symbol_relationships"), ["kind", "sourceSymbolStableKey", "targetSymbolStableKey", "evidenceStableKeys", "confidence"])
    kind = F.upper(F.regexp_replace("kind", r"^\s+|\s+$", ""))
    rows = rows.filter(F.col("sourceSymbolStableKey").isNotNull() & F.col("targetSymbolStableKey").isNotNull())
    return rows.select(
        SNAP, "stableKey", kind.alias("edgeKind"), F.col("sourceSymbolStableKey").alias("source"), F.col("targetSymbolStableKey").alias("target"), "evidenceStableKeys", "confidence",
        F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", kind, "sourceSymbolStableKey", "targetSymbolStableKey", F.col("confidence").cast("string")), 256)).alias("fingerprint"),
    )


def stored_evidence(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["evidenceKind", "filePath", "startLine", "endLine", "symbolName", "containingSymbol", "snippetHash", "snippetPreview", "knowledgeKind", "confidence", "unknownState", "metadata", "fingerprint", "deletedUtc"]
    return holding(table(spark, folder, "evidence"), columns).filter(F.col("deletedUtc").isNull()).drop("deletedUtc")


def stored_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["category", "targetStableKey", "targetKind", "displayName", "score", "evidenceStableKeys", "contributingMetricStableKeys", "contributingFindingStableKeys", "confidence", "hasUnknownData", "unknownReason", "metadata", "fingerprint"]
    return holding(table(spark, folder, "hotspots"), columns)


_HELD = "QUALIFY row_number() OVER (PARTITION BY snapshotStableKey, stableKey ORDER BY loadedUtc DESC) = 1"
SQL_HEADERS = "hd AS (SELECT DISTINCT stableKey, repositoryStableKey, branchName, commitSha, startedUtc, completedUtc, status FROM snapshots)"
SQL_NODES = f"n AS (SELECT * FROM (SELECT * FROM nodes {_HELD}) WHERE deletedUtc IS NULL)"
SQL_EVIDENCE = f"ev AS (SELECT * FROM (SELECT * FROM evidence {_HELD}) WHERE deletedUtc IS NULL)"
SQL_HOTSPOTS = f"hs AS (SELECT * FROM hotspots {_HELD})"
SQL_EDGES = f"""e AS (SELECT snapshotStableKey, stableKey, upper(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) AS edgeKind, sourceSymbolStableKey AS source, targetSymbolStableKey AS target, evidenceStableKeys, confidence,
 'sha256:' || sha256(concat_ws('|', upper(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')), sourceSymbolStableKey, targetSymbolStableKey, confidence::VARCHAR)) AS fingerprint
 FROM (SELECT * FROM symbol_relationships {_HELD}) WHERE sourceSymbolStableKey IS NOT NULL AND targetSymbolStableKey IS NOT NULL)"""

# ---- projection of the sales tables ------------------------------------------------------------------------------------------


def _size(spark: SparkSession, folder: str) -> int:
    """The number of suppliers: the projects of the projection. A count, read from file footers."""
    return max(1, table(spark, folder, "supplier").count())


def _key(prefix: str, column: Column | str) -> Column:
    return F.concat(F.lit(prefix + "://"), F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def _json(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of text members; null members are left out."""
    members = [F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":"'), c, F.lit('"'))) for name, c in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


_stored: dict[tuple[str, str, str], DataFrame] = {}
on_release.append(_stored.clear)


def _ingested(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """The projection is ingested once for each application and folder, as a snapshot would be, and read by all queries."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        _stored[key] = staged(make(spark, folder), name)
    return _stored[key]


def projected_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _ingested(spark, folder, "projected-nodes", _project_nodes)


def projected_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _ingested(spark, folder, "projected-edges", _project_edges)


def _project_nodes(spark: SparkSession, folder: str) -> DataFrame:
    s = _size(spark, folder)
    null = F.lit(None).cast("string")

    def part(df: DataFrame, key: Column, kind: str, name: Column, qualified: Column, project: Column, parent: Column, category: Column, metadata: Column) -> DataFrame:
        return df.select(key.alias("stableKey"), F.lit(kind).alias("nodeKind"), name.alias("displayName"), qualified.alias("qualifiedName"), project.alias("projectStableKey"), parent.alias("parentNodeStableKey"), category.alias("externalCategory"), metadata.alias("metadata"))

    c = F.col
    mod = lambda name, n=s: F.pmod(c(name), F.lit(n))
    frame = lambda name: table(spark, folder, name)
    tf = F.when(mod("s_suppkey", 5) == 0, "net10.0").when(mod("s_suppkey", 5) == 1, "net8.0").when(mod("s_suppkey", 5) == 2, "net6.0").when(mod("s_suppkey", 5) == 3, "net48")
    app = F.when(mod("s_suppkey", 3) == 0, "Api").when(mod("s_suppkey", 3) == 1, "Worker").otherwise("Library")
    layer = F.when(mod("s_suppkey", 6) == 0, "Domain").when(mod("s_suppkey", 6) == 1, "Infrastructure").when(mod("s_suppkey", 6) == 2, "Web").when(mod("s_suppkey", 6) == 3, "Application").when(mod("s_suppkey", 6) == 4, "Shared")
    k = F.get_json_object("props", "$.k")
    parts = [
        part(frame("region"), _key("repository", "r_regionkey"), "Repository", c("r_name"), null, null, null, null, F.lit("{}")),
        part(frame("nation"), _key("solution", "n_nationkey"), "Solution", c("n_name"), null, null, _key("repository", "n_regionkey"), null, F.lit("{}")),
        part(frame("supplier"), _key("project", "s_suppkey"), "Project", c("s_name"), null, null, _key("solution", "s_nationkey"), null,
             _json(("project.targetFramework", tf), ("application.type", app), ("architecture.layer", layer), ("project.packageReferenceCount", mod("s_suppkey", 11).cast("string")))),
        part(frame("part"), _key("package", "p_partkey"), "Package", c("p_name"), null, null, null, F.when(mod("p_size", 7) == 0, "Framework"), F.lit("{}")),
        part(frame("orders"), _key("endpoint", "o_orderkey"), "Endpoint", c("o_orderpriority"), null, _key("project", mod("o_custkey")), null, null,
             _json(("endpoint.httpMethod", c("o_orderstatus")), ("endpoint.route", F.concat(F.lit("/"), F.lower("o_orderpriority"))))),
        part(frame("customer"), _key("type", "c_custkey"), "Type", c("c_name"), F.concat(F.lit("Sales.Segment."), c("c_mktsegment"), F.lit("."), c("c_name")), _key("project", mod("c_custkey")), null, null,
             _json(("symbol.accessibility", F.when(c("c_mktsegment") == "BUILDING", "Public").when(c("c_mktsegment") == "MACHINERY", "Internal")))),
        part(frame("part").select(mod("p_partkey").alias("p"), "p_type").distinct(), F.concat(F.lit("table://"), c("p").cast("string"), F.lit("/"), c("p_type")), "DatabaseTable", c("p_type"), null, _key("project", "p"), null, null,
             _json(("tableName", c("p_type")), ("schemaName", F.when(F.pmod("p", F.lit(2)) == 0, "sales")))),
        part(frame("events").select(mod("user_id").alias("p"), "event_type").distinct(), F.concat(F.lit("queue://"), c("p").cast("string"), F.lit("/"), c("event_type")), "Queue", c("event_type"), null, _key("project", "p"), null, null, _json(("transport", F.lit("amqp")))),
        part(frame("events").select(k.alias("k"), mod("user_id").alias("p")).filter(c("k").isNotNull()).distinct(), F.concat(F.lit("config://"), c("p").cast("string"), F.lit("/"), c("k")), "ConfigurationKey",
             F.when(F.pmod(c("k").cast("int"), F.lit(5)) == 0, F.concat(F.lit("Api:Secret"), c("k"))).otherwise(F.concat(F.lit("Service:Limit"), c("k"))), null, _key("project", "p"), null, null,
             _json(("provider", F.when(F.pmod(c("k").cast("int"), F.lit(2)) == 0, "appsettings.json").otherwise("environment")))),
        part(frame("supplier").filter(mod("s_suppkey", 4) == 0), _key("hostedservice", "s_suppkey"), "HostedService", F.concat(c("s_name"), F.lit("Worker")), null, _key("project", "s_suppkey"), null, null,
             _json(("runtime.messagingExpected", F.when(mod("s_suppkey", 8) == 0, "true")))),
        part(frame("customer").filter(mod("c_custkey", 10) == 0), _key("external", "c_custkey"), "ExternalService", F.concat(F.lit("service"), c("c_custkey").cast("string")), null, _key("project", mod("c_custkey")), null, null,
             _json(("url", F.when(mod("c_custkey", 20) == 0, F.concat(F.lit("https://user:pass@svc"), c("c_nationkey").cast("string"), F.lit(".example/api?x=1"))).when(mod("c_custkey", 30) == 0, F.lit("token-store"))))),
        part(frame("part").filter(c("p_size") == 1), _key("ui", "p_partkey"), "UiPage", c("p_name"), F.when(mod("p_partkey", 3) == 0, F.concat(F.lit("App.Blazor."), c("p_brand"))).when(mod("p_partkey", 3) == 1, F.concat(F.lit("App.WinForms."), c("p_brand"))), _key("project", mod("p_partkey")), null, null,
             _json(("route", F.concat(F.lit("/"), c("p_brand"))))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(F.lit(PROJECTED).alias(SNAP), "*")


def _project_edges(spark: SparkSession, folder: str) -> DataFrame:
    s = _size(spark, folder)
    c = F.col
    frame = lambda name: table(spark, folder, name)
    k = F.get_json_object("props", "$.k")

    def part(df: DataFrame, kind: str, key: Column, source: Column, target: Column) -> DataFrame:
        return df.select(key.alias("stableKey"), F.lit(kind).alias("edgeKind"), source.alias("source"), target.alias("target"))

    sup = frame("supplier")
    parts = [
        part(sup, "REFERENCES", _key("edge", F.concat(F.lit("affine/"), c("s_suppkey").cast("string"))), _key("project", "s_suppkey"), _key("project", F.pmod(c("s_suppkey") * 7 + 3, F.lit(s)))),
        part(sup.filter(F.pmod("s_suppkey", F.lit(3)) == 0), "REFERENCES", _key("edge", F.concat(F.lit("half/"), c("s_suppkey").cast("string"))), _key("project", "s_suppkey"), _key("project", F.floor(c("s_suppkey") / 2))),
        part(frame("lineitem").select("l_suppkey", "l_partkey").distinct(), "USES_PACKAGE", F.concat(F.lit("edge://uses/"), c("l_suppkey").cast("string"), F.lit("/"), c("l_partkey").cast("string")), _key("project", "l_suppkey"), _key("package", "l_partkey")),
        part(frame("orders"), "CALLS", F.concat(F.lit("edge://calls/"), c("o_orderkey").cast("string")), _key("endpoint", "o_orderkey"), _key("type", "o_custkey")),
        part(frame("part").select("p_partkey", "p_type", F.pmod("p_partkey", F.lit(s)).alias("p")), "READS_TABLE", F.concat(F.lit("edge://reads/"), c("p_partkey").cast("string")), _key("project", F.pmod(c("p_partkey") * 3 + 1, F.lit(s))), F.concat(F.lit("table://"), c("p").cast("string"), F.lit("/"), c("p_type"))),
        part(frame("events"), "HANDLES", F.concat(F.lit("edge://handles/"), c("event_id").cast("string")), _key("hostedservice", F.pmod("user_id", F.lit(s))), F.concat(F.lit("queue://"), F.pmod("user_id", F.lit(s)).cast("string"), F.lit("/"), c("event_type"))),
        part(frame("events").filter(k.isNotNull()), "USES_CONFIG", F.concat(F.lit("edge://config/"), c("event_id").cast("string")), _key("project", F.pmod("event_id", F.lit(s))), F.concat(F.lit("config://"), F.pmod("user_id", F.lit(s)).cast("string"), F.lit("/"), k)),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(F.lit(PROJECTED).alias(SNAP), "*")


def projected_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings, one for each event; the snapshot is the event's day."""
    s, c = _size(spark, folder), F.col
    customers = max(1, table(spark, folder, "customer").count())
    mod = lambda n: F.pmod(c("event_id"), F.lit(n))
    case = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (mod(n) + 1).cast("int"))
    primary = _key("project", F.pmod("user_id", F.lit(s)))
    return table(spark, folder, "events").select(
        F.concat(F.lit("snapshot://"), F.date_format("ts", "yyyy-MM-dd")).alias(SNAP), _key("finding", "event_id").alias("stableKey"), F.concat(F.lit("RULE-"), F.upper("event_type")).alias("ruleCode"),
        case(3, ["1.0.0", "9.0.0", "10.0.0"]).alias("ruleVersion"), case(5, ["Critical", "High", "Medium", "Low", "Info"]).alias("severity"), case(4, ["Open", "Open", "Acknowledged", "Resolved"]).alias("status"),
        F.concat(F.lit("Finding of "), c("event_type")).alias("title"), primary.alias("primaryNodeStableKey"),
        F.array(primary, _key("type", F.pmod("user_id", F.lit(customers)))).alias("affectedNodeStableKeys"), (F.lit(0.25) + mod(4) * 0.25).cast("decimal(3,2)").alias("confidence"),
        (mod(7) == 0).alias("hasUnknownData"), F.when(mod(7) == 0, F.concat(F.lit("reason "), mod(3).cast("string"))).alias("unknownReason"),
        F.concat(F.lit("history://"), c("event_type"), F.lit("/"), F.pmod("user_id", F.lit(s)).cast("string")).alias("historyKey"), "ts", "value",
    )


def projected_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that the findings name."""
    categories = F.create_map(*[F.lit(x) for pair in _CATEGORIES.items() for x in pair])
    kinds = projected_findings(spark, folder).select("ruleCode", "ruleVersion").distinct()
    return kinds.select(
        "ruleCode", F.col("ruleVersion").alias("version"), F.initcap(F.replace("ruleCode", F.lit("-"), F.lit(" "))).alias("name"), F.coalesce(categories[F.col("ruleCode")], F.lit("Lifecycle")).alias("category"),
        (F.col("ruleVersion") != "9.0.0").alias("enabled"),
    )


_CATEGORIES = {"RULE-CLICK": "SecuritySensitive", "RULE-PURCHASE": "DataAccess", "RULE-VIEW": "Configuration"}

SQL_PROJECTION = r"""sc AS (SELECT greatest(count(*), 1) AS S FROM supplier), cc AS (SELECT greatest(count(*), 1) AS C FROM customer),
ek AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
pn AS (
 SELECT 'repository://'||r_regionkey AS stableKey, 'Repository' AS nodeKind, r_name AS displayName, NULL AS qualifiedName, NULL AS projectStableKey, NULL AS parentNodeStableKey, NULL AS externalCategory, '{}' AS metadata FROM region
 UNION ALL SELECT 'solution://'||n_nationkey, 'Solution', n_name, NULL, NULL, 'repository://'||n_regionkey, NULL, '{}' FROM nation
 UNION ALL SELECT 'project://'||s_suppkey, 'Project', s_name, NULL, NULL, 'solution://'||s_nationkey, NULL,
   '{'||concat_ws(',', CASE s_suppkey%5 WHEN 0 THEN '"project.targetFramework":"net10.0"' WHEN 1 THEN '"project.targetFramework":"net8.0"' WHEN 2 THEN '"project.targetFramework":"net6.0"' WHEN 3 THEN '"project.targetFramework":"net48"' END,
   '"application.type":"'||CASE s_suppkey%3 WHEN 0 THEN 'Api' WHEN 1 THEN 'Worker' ELSE 'Library' END||'"',
   CASE s_suppkey%6 WHEN 0 THEN '"architecture.layer":"Domain"' WHEN 1 THEN '"architecture.layer":"Infrastructure"' WHEN 2 THEN '"architecture.layer":"Web"' WHEN 3 THEN '"architecture.layer":"Application"' WHEN 4 THEN '"architecture.layer":"Shared"' END,
   '"project.packageReferenceCount":"'||(s_suppkey%11)||'"')||'}' FROM supplier
 UNION ALL SELECT 'package://'||p_partkey, 'Package', p_name, NULL, NULL, NULL, CASE WHEN p_size%7=0 THEN 'Framework' END, '{}' FROM part
 UNION ALL SELECT 'endpoint://'||o_orderkey, 'Endpoint', o_orderpriority, NULL, 'project://'||(o_custkey%S), NULL, NULL, '{"endpoint.httpMethod":"'||o_orderstatus||'","endpoint.route":"/'||lower(o_orderpriority)||'"}' FROM orders, sc
 UNION ALL SELECT 'type://'||c_custkey, 'Type', c_name, 'Sales.Segment.'||c_mktsegment||'.'||c_name, 'project://'||(c_custkey%S), NULL, NULL, CASE c_mktsegment WHEN 'BUILDING' THEN '{"symbol.accessibility":"Public"}' WHEN 'MACHINERY' THEN '{"symbol.accessibility":"Internal"}' ELSE '{}' END FROM customer, sc
 UNION ALL SELECT DISTINCT 'table://'||(p_partkey%S)||'/'||p_type, 'DatabaseTable', p_type, NULL, 'project://'||(p_partkey%S), NULL, NULL, '{"tableName":"'||p_type||'"'||CASE WHEN (p_partkey%S)%2=0 THEN ',"schemaName":"sales"' ELSE '' END||'}' FROM part, sc
 UNION ALL SELECT DISTINCT 'queue://'||(user_id%S)||'/'||event_type, 'Queue', event_type, NULL, 'project://'||(user_id%S), NULL, NULL, '{"transport":"amqp"}' FROM events, sc
 UNION ALL SELECT DISTINCT 'config://'||(user_id%S)||'/'||k, 'ConfigurationKey', CASE WHEN k::INT%5=0 THEN 'Api:Secret'||k ELSE 'Service:Limit'||k END, NULL, 'project://'||(user_id%S), NULL, NULL, '{"provider":"'||CASE WHEN k::INT%2=0 THEN 'appsettings.json' ELSE 'environment' END||'"}' FROM ek, sc WHERE k IS NOT NULL
 UNION ALL SELECT 'hostedservice://'||s_suppkey, 'HostedService', s_name||'Worker', NULL, 'project://'||s_suppkey, NULL, NULL, CASE WHEN s_suppkey%8=0 THEN '{"runtime.messagingExpected":"true"}' ELSE '{}' END FROM supplier WHERE s_suppkey%4=0
 UNION ALL SELECT 'external://'||c_custkey, 'ExternalService', 'service'||c_custkey, NULL, 'project://'||(c_custkey%S), NULL, NULL, CASE WHEN c_custkey%20=0 THEN '{"url":"https://user:pass@svc'||c_nationkey||'.example/api?x=1"}' WHEN c_custkey%30=0 THEN '{"url":"token-store"}' ELSE '{}' END FROM customer, sc WHERE c_custkey%10=0
 UNION ALL SELECT 'ui://'||p_partkey, 'UiPage', p_name, CASE p_partkey%3 WHEN 0 THEN 'App.Blazor.'||p_brand WHEN 1 THEN 'App.WinForms.'||p_brand END, 'project://'||(p_partkey%S), NULL, NULL, '{"route":"/'||p_brand||'"}' FROM part, sc WHERE p_size=1),
pe AS (
 SELECT 'edge://affine/'||s_suppkey AS stableKey, 'REFERENCES' AS edgeKind, 'project://'||s_suppkey AS source, 'project://'||((7*s_suppkey+3)%S) AS target FROM supplier, sc
 UNION ALL SELECT 'edge://half/'||s_suppkey, 'REFERENCES', 'project://'||s_suppkey, 'project://'||(s_suppkey//2) FROM supplier WHERE s_suppkey%3=0
 UNION ALL SELECT DISTINCT 'edge://uses/'||l_suppkey||'/'||l_partkey, 'USES_PACKAGE', 'project://'||l_suppkey, 'package://'||l_partkey FROM lineitem
 UNION ALL SELECT 'edge://calls/'||o_orderkey, 'CALLS', 'endpoint://'||o_orderkey, 'type://'||o_custkey FROM orders
 UNION ALL SELECT 'edge://reads/'||p_partkey, 'READS_TABLE', 'project://'||((3*p_partkey+1)%S), 'table://'||(p_partkey%S)||'/'||p_type FROM part, sc
 UNION ALL SELECT 'edge://handles/'||event_id, 'HANDLES', 'hostedservice://'||(user_id%S), 'queue://'||(user_id%S)||'/'||event_type FROM events, sc
 UNION ALL SELECT 'edge://config/'||event_id, 'USES_CONFIG', 'project://'||(event_id%S), 'config://'||(user_id%S)||'/'||k FROM ek, sc WHERE k IS NOT NULL),
pf AS (SELECT 'snapshot://'||strftime(ts, '%Y-%m-%d') AS snapshotStableKey, 'finding://'||event_id AS stableKey, 'RULE-'||upper(event_type) AS ruleCode, CASE event_id%3 WHEN 0 THEN '1.0.0' WHEN 1 THEN '9.0.0' ELSE '10.0.0' END AS ruleVersion,
 CASE event_id%5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Info' END AS severity, CASE event_id%4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Open' WHEN 2 THEN 'Acknowledged' ELSE 'Resolved' END AS status,
 'Finding of '||event_type AS title, 'project://'||(user_id%S) AS primaryNodeStableKey, ['project://'||(user_id%S), 'type://'||(user_id%C)] AS affectedNodeStableKeys, (0.25+0.25*(event_id%4))::DECIMAL(3,2) AS confidence,
 event_id%7=0 AS hasUnknownData, CASE WHEN event_id%7=0 THEN 'reason '||(event_id%3) END AS unknownReason, 'history://'||event_type||'/'||(user_id%S) AS historyKey, ts, value FROM events, sc, cc),
pr AS (SELECT DISTINCT ruleCode, ruleVersion AS version, CASE ruleCode WHEN 'RULE-CLICK' THEN 'SecuritySensitive' WHEN 'RULE-PURCHASE' THEN 'DataAccess' WHEN 'RULE-VIEW' THEN 'Configuration' ELSE 'Lifecycle' END AS category, ruleVersion <> '9.0.0' AS enabled FROM pf)"""
