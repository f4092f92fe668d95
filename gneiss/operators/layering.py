"""Architecture rules: layers of nodes and the dependencies and uses that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci, metadata_flag, metadata_text

SNAP = "snapshotStableKey"
# The kinds of edge that count as a dependency between layers, and the layers by words in their order.
LAYER_DEPENDENCIES = ("REFERENCES", "DEPENDS_ON", "CALLS", "CALLS_API", "INJECTS")
LAYERS = (("Domain", ("Domain",)), ("Infrastructure", ("Infrastructure",)), ("Web", ("Web", "Api", "Host")), ("Application", ("Application", "Services")), ("Shared", ("Shared", "Common")), ("Worker", ("Worker",)))
WEB_WORDS = ("Web", "Api", "Host", "Ui")
DATA_CONTEXT_EDGES = ("USES_DB_CONTEXT", "USES_LINQ_TO_SQL_CONTEXT")
SHARED_FAN_IN = 8


def _any(value: Column, words: tuple[str, ...]) -> Column:
    out = contains_ci(value, words[0])
    for w in words[1:]:
        out = out | contains_ci(value, w)
    return out


def layered(nodes: DataFrame) -> DataFrame:
    """Nodes with their ``layer``: said by metadata, else the first layer whose word stands in name, qualified name or key, else the node's kind."""
    text = F.concat_ws(" ", "displayName", "qualifiedName", "stableKey")
    layer = F.col("nodeKind")
    for name, words in reversed(LAYERS):
        layer = F.when(_any(text, words), name).otherwise(layer)
    return nodes.withColumn("layer", F.coalesce(metadata_text("metadata", "architecture.layer"), layer))


def is_web(layer: Column) -> Column:
    """The word Ui also stands in build."""
    return _any(layer, WEB_WORDS)


def layering_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, rule, status, target, edge, other) of the three rules on dependencies between layers."""
    sides = layered(nodes).select(SNAP, "stableKey", "layer")
    deps = edges.filter(F.col("edgeKind").isin(*LAYER_DEPENDENCIES)).select(SNAP, F.col("stableKey").alias("edge"), "source", "target")
    both = deps.join(sides.select(SNAP, F.col("stableKey").alias("source"), F.col("layer").alias("from")), [SNAP, "source"]).join(sides.select(SNAP, F.col("stableKey").alias("target"), F.col("layer").alias("to")), [SNAP, "target"])
    domain = contains_ci("from", "Domain")
    hit = lambda when, rule, target, other: F.when(when, F.struct(F.lit(rule).alias("rule"), F.col(target).alias("target"), F.col(other).alias("other")))
    hits = F.array_compact(F.array(
        hit(domain & contains_ci("to", "Infrastructure"), "domain-references-infrastructure", "source", "target"), hit(domain & is_web(F.col("to")), "domain-references-web", "source", "target"),
        hit(~is_web(F.col("from")) & is_web(F.col("to")), "web-referenced-by-non-web", "target", "source"),
    ))
    spread = both.select(SNAP, "edge", F.explode(hits).alias("h"))
    return spread.select(SNAP, "h.rule", F.lit("Violation").alias("status"), "h.target", "edge", "h.other")


def data_access_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Controllers that use a data context directly, and application layers that use LINQ to SQL: (scope, rule, status, target)."""
    used = edges.filter(F.col("edgeKind").isin(*DATA_CONTEXT_EDGES)).groupBy(SNAP, F.col("source").alias("stableKey")).agg(F.bool_or(F.col("edgeKind") == "USES_LINQ_TO_SQL_CONTEXT").alias("linq"))
    users = layered(nodes).join(used, [SNAP, "stableKey"])
    application = contains_ci("layer", "Application") | contains_ci("layer", "Services")
    hits = F.array_compact(F.array(F.when(F.col("linq") & application, F.lit("application-uses-linq-to-sql")), F.when(F.col("nodeKind") == "Controller", F.lit("controller-uses-data-context"))))
    return users.select(SNAP, F.explode(hits).alias("rule"), F.lit("Violation").alias("status"), F.col("stableKey").alias("target"))


def silent_workers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Workers that are expected to handle messages and have no edge to a queue or topic: (scope, rule, status, target)."""
    queues = nodes.filter(F.col("nodeKind").isin("Queue", "Topic")).select(SNAP, F.col("stableKey").alias("target"))
    handling = edges.join(queues, [SNAP, "target"], "left_semi").select(SNAP, F.col("source").alias("stableKey")).distinct()
    workers = nodes.filter((F.col("nodeKind") == "HostedService") & metadata_flag("metadata", "runtime.messagingExpected"))
    return workers.join(handling, [SNAP, "stableKey"], "left_anti").select(SNAP, F.lit("worker-missing-messaging").alias("rule"), F.lit("Unknown").alias("status"), F.col("stableKey").alias("target"))


def shared_libraries(nodes: DataFrame, metrics: DataFrame, least: int = SHARED_FAN_IN) -> DataFrame:
    """Shared layers with a fan-in of ``least`` or more: (scope, rule, status, target)."""
    high = metrics.filter(F.col("fan_in") >= least).select(SNAP, "stableKey")
    shared = layered(nodes).filter(contains_ci("layer", "Shared") | contains_ci("layer", "Common"))
    return shared.join(high, [SNAP, "stableKey"], "left_semi").select(SNAP, F.lit("shared-library-high-fan-in").alias("rule"), F.lit("ReviewRequired").alias("status"), F.col("stableKey").alias("target"))


def enabled_only(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results whose rule is not switched off by the latest version in ``rules`` (ruleCode, version, enabled); unknown rules count as on."""
    off = rules.groupBy("ruleCode").agg(F.max_by("enabled", "version").alias("enabled")).filter(~F.col("enabled"))
    return results.join(off.select(F.col("ruleCode").alias("rule")), "rule", "left_anti")
