"""Queries of runtime facts: controllers, endpoints by filter, workers with schedules, searches with findings and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import runtime, services
from gneiss.plans import model
from gneiss.plans.model import PROJECTED, SNAP, SQL_PROJECTION
from gneiss.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# the projection is read by several parts of a query, so it is made once
_P = SQL_PROJECTION.replace("\npn AS (", "\npn AS MATERIALIZED (").replace("\npe AS (", "\npe AS MATERIALIZED (")


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with its SQL."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


# Nations are controllers, to which the endpoints of their customers' orders are joined by name or by edge; every fourth supplier, from the
# second on, has a scheduled job, of which a hosted service runs one half.
_R = f"""{_P}, on1 AS (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
rn AS MATERIALIZED (SELECT stableKey, nodeKind, displayName, qualifiedName, projectStableKey, metadata FROM pn WHERE nodeKind <> 'Endpoint'
 UNION ALL SELECT stableKey, nodeKind, displayName, qualifiedName, projectStableKey, CASE WHEN c_nationkey % 2 = 0 THEN rtrim(metadata, '}}') || ',"controller":"' || lower(n_name) || '"}}' ELSE metadata END FROM pn LEFT JOIN on1 ON 'endpoint://' || o_orderkey = stableKey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE nodeKind = 'Endpoint'
 UNION ALL SELECT 'controller://' || n_nationkey, 'Controller', n_name, 'Sales.' || n_name, 'project://' || (n_nationkey % S), '{{}}' FROM nation, sc
 UNION ALL SELECT 'job://' || s_suppkey, 'Method', 'Job' || s_suppkey, NULL, 'project://' || s_suppkey, '{{"cron":"0 0 * * *"}}' FROM supplier WHERE s_suppkey % 4 = 1),
re AS MATERIALIZED (SELECT * FROM pe UNION ALL SELECT 'edge://acts/' || o_orderkey, 'CALLS', 'controller://' || c_nationkey, 'endpoint://' || o_orderkey FROM on1 WHERE c_nationkey % 2 = 1
 UNION ALL SELECT 'edge://runs/' || s_suppkey, 'HANDLES', 'hostedservice://' || (s_suppkey - 1), 'job://' || s_suppkey FROM supplier WHERE s_suppkey % 8 = 1),
ri AS MATERIALIZED (SELECT source AS node, stableKey AS edge, edgeKind, target AS other FROM re UNION ALL SELECT target, stableKey, edgeKind, source FROM re WHERE source <> target)"""


def _runtime(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = model.projected_nodes(spark, folder), model.projected_edges(spark, folder)
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("o_orderkey", "c_nationkey")
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    suppliers = max(1, supplier.count())
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    columns = ["stableKey", "nodeKind", "displayName", "qualifiedName", "projectStableKey", "metadata"]
    named = orders.filter(F.col("c_nationkey") % 2 == 0).join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("controller")), "c_nationkey").select(text("endpoint://", F.col("o_orderkey")).alias("stableKey"), "controller")
    said = F.when(F.col("controller").isNotNull(), F.concat(F.rtrim("metadata", F.lit("}")), F.lit(',"controller":"'), "controller", F.lit('"}'))).otherwise(F.col("metadata"))
    endpoints = nodes.join(named, "stableKey", "left").withColumn("metadata", said).select(*columns)
    n, s, none = F.col("n_nationkey"), F.col("s_suppkey"), F.lit(None).cast("string")
    controllers = nation.select(text("controller://", n).alias("stableKey"), F.lit("Controller").alias("nodeKind"), F.col("n_name").alias("displayName"), F.concat(F.lit("Sales."), "n_name").alias("qualifiedName"), text("project://", n % suppliers).alias("projectStableKey"), F.lit("{}").alias("metadata"))
    jobs = supplier.filter(s % 4 == 1).select(text("job://", s).alias("stableKey"), F.lit("Method").alias("nodeKind"), text("Job", s).alias("displayName"), none.alias("qualifiedName"), text("project://", s).alias("projectStableKey"), F.lit('{"cron":"0 0 * * *"}').alias("metadata"))
    edge = ["stableKey", "edgeKind", "source", "target"]
    acts = orders.filter(F.col("c_nationkey") % 2 == 1).select(text("edge://acts/", F.col("o_orderkey")).alias("stableKey"), F.lit("CALLS").alias("edgeKind"), text("controller://", F.col("c_nationkey")).alias("source"), text("endpoint://", F.col("o_orderkey")).alias("target"))
    runs = supplier.filter(s % 8 == 1).select(text("edge://runs/", s).alias("stableKey"), F.lit("HANDLES").alias("edgeKind"), text("hostedservice://", s - 1).alias("source"), text("job://", s).alias("target"))
    scoped = lambda df: df.withColumn(SNAP, F.lit(PROJECTED))
    return scoped(endpoints.unionByName(controllers).unionByName(jobs)), scoped(edges.select(*edge).unionByName(acts).unionByName(runs))


_ENDPOINTS = """ep AS MATERIALIZED (SELECT e.stableKey, json_extract_string(metadata, '$."endpoint.httpMethod"') AS method, coalesce(json_extract_string(metadata, '$."endpoint.route"'), displayName) AS route, projectStableKey AS project,
 coalesce(json_extract_string(metadata, '$.controller'), k.c) AS controller FROM rn e LEFT JOIN (SELECT ri.other, min(displayName) c FROM ri JOIN rn ON rn.stableKey = ri.node AND rn.nodeKind = 'Controller' GROUP BY 1) k ON k.other = e.stableKey WHERE nodeKind = 'Endpoint')"""


@query(
    f"""WITH {_R}, {_ENDPOINTS}, ce AS (SELECT DISTINCT c.stableKey, ep.stableKey AS endpoint FROM rn c JOIN ri ON ri.node = c.stableKey JOIN ep ON ep.stableKey = ri.other WHERE c.nodeKind = 'Controller' UNION SELECT c.stableKey, ep.stableKey FROM rn c JOIN ep ON lower(ep.controller) = lower(c.displayName) WHERE c.nodeKind = 'Controller'),
ct AS (SELECT stableKey, count(*) AS endpoints, min(endpoint) AS first FROM ce GROUP BY 1), sv AS (SELECT ri.node, count(DISTINCT o.displayName) AS services FROM ri JOIN rn o ON o.stableKey = ri.other WHERE edgeKind IN ('INJECTS', 'CALLS', 'REFERENCES') GROUP BY 1)
SELECT c.stableKey, displayName AS name, qualifiedName AS qualified, projectStableKey AS project, coalesce(endpoints, 0) AS endpoints, first, coalesce(services, 0) AS services FROM rn c LEFT JOIN ct ON ct.stableKey = c.stableKey LEFT JOIN sv ON sv.node = c.stableKey WHERE nodeKind = 'Controller'"""
)
def controller_details(spark: SparkSession, folder: str) -> DataFrame:
    """Every controller with its endpoints, joined by edge or by name, and the services around it."""
    found = runtime.controller_details(*_runtime(spark, folder))
    services_ = F.when(F.col("services") == "", 0).otherwise(F.size(F.split("services", ", "))).cast("long")
    return found.select("stableKey", "name", "qualified", "project", F.size("endpoints").cast("long").alias("endpoints"), F.try_element_at("endpoints", F.lit(1)).alias("first"), services_.alias("services"))


@query(f"WITH {_R}, {_ENDPOINTS} SELECT stableKey, method, route, project, controller FROM ep WHERE lower(method) = 'o' AND contains(lower(route), 'urgent') AND contains(lower(controller), 'an') ORDER BY upper(controller) DESC, stableKey LIMIT 40 OFFSET 2")
def endpoint_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of endpoints by method, part of the route and part of the controller's name, ordered by controller."""
    rows = runtime.endpoint_rows(*_runtime(spark, folder))
    return runtime.endpoint_page(rows, " O ", "URGENT", acting="an", sort="Controller", descending=True, skip=2, take=40).select("stableKey", "method", "route", "project", "controller")


@query(
    f"""WITH {_R}, hs AS (SELECT stableKey, projectStableKey AS project FROM rn WHERE nodeKind = 'HostedService'), pt AS MATERIALIZED (SELECT stableKey, CASE WHEN nodeKind = 'Queue' THEN 'QueueConsumer' ELSE 'ScheduledJob' END AS sort, projectStableKey AS project FROM rn WHERE nodeKind = 'Queue' OR json_extract_string(metadata, '$.cron') IS NOT NULL),
jn AS MATERIALIZED (SELECT DISTINCT ri.node, pt.stableKey AS part, pt.sort FROM ri JOIN hs ON hs.stableKey = ri.node JOIN pt ON pt.stableKey = ri.other), ag AS (SELECT node, count(*) FILTER (sort = 'QueueConsumer') AS c, count(*) FILTER (sort = 'ScheduledJob') AS j FROM jn GROUP BY 1)
SELECT stableKey AS key, 'HostedService' AS worker_kind, project, coalesce(c, 0) AS consumers, coalesce(j, 0) AS jobs FROM hs LEFT JOIN ag ON ag.node = hs.stableKey
UNION ALL SELECT 'worker://' || stableKey, sort, project, (sort = 'QueueConsumer')::BIGINT, (sort = 'ScheduledJob')::BIGINT FROM pt ANTI JOIN jn ON jn.part = pt.stableKey"""
)
def scheduled_workers(spark: SparkSession, folder: str) -> DataFrame:
    """Workers with their consumers and scheduled jobs; jobs and queues without a service stand for themselves."""
    rows = runtime.worker_rows(*_runtime(spark, folder))
    return rows.select("key", "worker_kind", "project", F.size("consumers").cast("long").alias("consumers"), F.size("jobs").cast("long").alias("jobs"))


_TEXT = "project://3"


@query(
    f"""WITH {_P}, fd AS (SELECT 'Finding' AS result_kind, 5 AS kind_order, stableKey AS key FROM pf WHERE contains(concat_ws(chr(1), stableKey, lower(ruleCode), lower(title), lower(severity), lower(status)), '{_TEXT}') OR len(list_filter(affectedNodeStableKeys, lambda k: contains(k, '{_TEXT}'))) > 0),
mt AS (SELECT DISTINCT 'Metric' AS result_kind, 6 AS kind_order, 'fan.out/' || source AS key FROM pe WHERE contains(source, '{_TEXT}')),
nd AS (SELECT CASE WHEN nodeKind = 'Project' THEN 'Project' WHEN nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') THEN 'Symbol' WHEN nodeKind IN ('Endpoint', 'Controller', 'HostedService') THEN 'RuntimeEndpoint' ELSE 'Fact' END AS result_kind, CASE WHEN nodeKind = 'Project' THEN 0 WHEN nodeKind IN ('Namespace', 'Type', 'Method', 'Property', 'Field') THEN 1 WHEN nodeKind IN ('Endpoint', 'Controller', 'HostedService') THEN 2 ELSE 3 END AS kind_order, stableKey AS key
 FROM pn WHERE contains(lower(concat_ws(chr(1), stableKey, displayName, qualifiedName, projectStableKey)), '{_TEXT}'))
SELECT * FROM nd UNION ALL SELECT * FROM fd UNION ALL SELECT * FROM mt"""
)
def search_all_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """A search through nodes, findings and metrics."""
    nodes = model.projected_nodes(spark, folder).withColumns({"searchName": F.lit(None).cast("string"), "language": F.lit(None).cast("string")})
    evidence = spark.createDataFrame([], f"{SNAP} string, stableKey string, filePath string, symbolName string, snippetPreview string, evidenceKind string")
    metrics = model.projected_edges(spark, folder).select(SNAP, F.col("source").alias("node"), F.lit("fan.out").alias("metricKind")).distinct()
    return services.search(nodes, evidence, model.projected_findings(spark, folder), metrics, _TEXT).select("result_kind", "kind_order", "key")
