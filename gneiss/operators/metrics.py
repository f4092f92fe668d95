"""Metrics of nodes, projects and scopes of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci, metadata_flag, metadata_int, metadata_text

SNAP = "snapshotStableKey"
#: Containment is the only kind of edge that is no dependency.
CONTAINMENT = "CONTAINS"
DATA_ACCESS_KINDS = ("DbContext", "LinqToSqlDataContext", "Entity", "DatabaseTable", "DatabaseColumn", "StoredProcedure", "SqlScript")
# Names of legacy technology, and words of security.
LEGACY = ("Classic", "LinqToSql", "LINQ to SQL", "Web Forms", "WebForms", "MVC 5", "Web API 2")
SECURITY = ("Security", "Secret", "Credential")


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("edgeKind") != CONTAINMENT)


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, fan_in, fan_out, centrality, neighbourhood) of every node.

    Parallel edges and loops count each; ends need not exist. Centrality is (in + out) / (2 (N - 1)), rounded to six digits away from zero,
    and 0 in a snapshot of one node. The neighbourhood counts distinct opposite ends, itself for a loop.
    """
    deps = dependencies(edges)
    # one pass over the edges: each end is a row, counted by its role
    ends = deps.select(SNAP, F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(1).alias("out")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(0).alias("out")))).alias("end"))
    ends = ends.select(SNAP, "end.*")
    # distinct neighbours by way of one row for each pair, so that a hub is combined on the map side
    pairs = ends.groupBy(SNAP, "node", "other").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    per = pairs.groupBy(SNAP, "node").agg(F.sum("out").alias("fan_out"), F.sum(F.col("n") - F.col("out")).alias("fan_in"), F.count("*").alias("neighbourhood"))
    sizes = nodes.groupBy(SNAP).agg(F.count("*").alias("size"))
    joined = nodes.select(SNAP, "stableKey").join(per.withColumnRenamed("node", "stableKey"), [SNAP, "stableKey"], "left").join(sizes, SNAP)
    degree = (F.coalesce("fan_in", F.lit(0)) + F.coalesce("fan_out", F.lit(0))).cast("decimal(18,0)")
    centrality = F.when(F.col("size") > 1, F.round((degree / ((F.col("size") - 1) * 2).cast("decimal(18,0)")).cast("decimal(38,12)"), 6)).otherwise(F.lit(0)).cast("decimal(38,6)")
    return joined.select(SNAP, "stableKey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "neighbourhood")], centrality.alias("centrality"))


def target_framework(metadata: Column | str) -> Column:
    return metadata_text(metadata, "project.targetFramework", "project.legacyTargetFramework")


def framework_risk(framework: Column) -> tuple[Column, Column]:
    """The risk of a target framework as number and text; the order of the prefixes decides. A missing one is Unknown, without a number."""
    low = F.lower(F.trim(framework))
    starts = lambda *p: _any(low.startswith(x) for x in p)
    rules = [(("net10",), 0, "Current"), (("net8", "net9"), 1, "Supported"), (("netcoreapp", "net5", "net6", "net7"), 2, "OutOfSupportModernDotNet"), (("net4", "v4"), 3, "LegacyDotNetFramework")]
    number, text = F.lit(2), F.lit("UnknownRisk")
    for prefixes, value, name in reversed(rules):
        number, text = F.when(starts(*prefixes), value).otherwise(number), F.when(starts(*prefixes), name).otherwise(text)
    missing = framework.isNull() | (F.trim(framework) == "")
    return F.when(~missing, number), F.when(missing, "Unknown").otherwise(text)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def out_of_support(framework: Column) -> Column:
    low = F.lower(F.trim(framework))
    return F.coalesce(_any(low.startswith(p) for p in ("net4", "v4", "netcoreapp", "net5", "net6", "net7")), F.lit(False))


def project_metrics(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of each Project node: references in and out (the former from projects only), packages by metadata, public types, endpoints, data access, findings (each once)."""
    projects = nodes.filter(F.col("nodeKind") == "Project").select(SNAP, "stableKey", "metadata")
    refs = edges.filter(F.col("edgeKind") == "REFERENCES").select(SNAP, "source", "target")
    incoming = refs.join(projects.select(SNAP, F.col("stableKey").alias("source")), [SNAP, "source"], "left_semi").groupBy(SNAP, F.col("target").alias("stableKey")).agg(F.count("*").alias("incoming"))
    outgoing = refs.groupBy(SNAP, F.col("source").alias("stableKey")).agg(F.count("*").alias("outgoing"))
    access = metadata_text("metadata", "symbol.accessibility")
    owned = nodes.filter(F.col("projectStableKey").isNotNull()).groupBy(SNAP, F.col("projectStableKey").alias("stableKey")).agg(
        F.count_if((F.col("nodeKind") == "Type") & F.coalesce(F.lower(access) == "public", F.lit(True))).alias("public_types"),
        F.count_if(F.col("nodeKind") == "Endpoint").alias("endpoints"), F.count_if(F.col("nodeKind").isin(*DATA_ACCESS_KINDS)).alias("data_access"),
    )
    hit = findings.select(SNAP, "stableKey", F.explode(F.array_distinct(F.array_compact(F.concat("affectedNodeStableKeys", F.array("primaryNodeStableKey"))))).alias("node"))
    flagged = hit.groupBy(SNAP, F.col("node").alias("stableKey")).agg(F.count("*").alias("findings"))
    number, text = framework_risk(target_framework("metadata"))
    key = [SNAP, "stableKey"]
    joined = projects.join(incoming, key, "left").join(outgoing, key, "left").join(owned, key, "left").join(flagged, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        *key, zero("incoming"), zero("outgoing"), F.coalesce(metadata_int("metadata", "project.packageReferenceCount"), F.lit(0)).alias("packages"), zero("public_types"), zero("endpoints"), zero("data_access"), zero("findings"),
        number.alias("risk"), text.alias("risk_text"),
    )


def modernization_scopes(nodes: DataFrame) -> DataFrame:
    """Which projects count for which scope: (scope, scope_kind, scope_key, project).

    The snapshot has all projects and a project itself; a repository or solution has the projects directly below it, or all if there are none.
    """
    projects = nodes.filter(F.col("nodeKind") == "Project").select(SNAP, F.col("stableKey").alias("project"), "parentNodeStableKey")
    whole = projects.select(SNAP, F.lit("Snapshot").alias("scope_kind"), F.lit(None).cast("string").alias("scope_key"), "project")
    own = projects.select(SNAP, F.lit("Project").alias("scope_kind"), F.col("project").alias("scope_key"), "project")
    groups = nodes.filter(F.col("nodeKind").isin("Repository", "Solution")).select(SNAP, F.col("nodeKind").alias("scope_kind"), F.col("stableKey").alias("scope_key"))
    direct = groups.join(projects.withColumnRenamed("parentNodeStableKey", "scope_key"), [SNAP, "scope_key"])
    empty = groups.join(direct.select(SNAP, "scope_key").distinct(), [SNAP, "scope_key"], "left_anti").join(projects.select(SNAP, "project"), SNAP)
    columns = [SNAP, "scope_kind", "scope_key", "project"]
    return whole.unionByName(own).unionByName(direct.select(*columns)).unionByName(empty.select(*columns))


def modernization_metrics(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scope: legacy technology, security-sensitive findings, targets out of support (and missing ones), framework-only dependencies, data-access spread, shared tables."""
    scopes = modernization_scopes(nodes)
    key = [SNAP, "scope_kind", "scope_key"]
    legacy_text = lambda name: _any(contains_ci(metadata_text("metadata", name), part) for part in LEGACY)
    tf = target_framework("metadata")
    old = metadata_flag("metadata", "project.isOldStyle") | out_of_support(tf) | legacy_text("runtimeKind") | legacy_text("framework")
    projects = nodes.filter(F.col("nodeKind") == "Project").select(
        SNAP, F.col("stableKey").alias("project"), old.alias("old"), tf.isNull().alias("no_target"), out_of_support(tf).alias("unsupported"), F.coalesce(metadata_int("metadata", "project.packageReferenceCount"), F.lit(0)).alias("packages")
    )
    owned = nodes.filter(F.col("projectStableKey").isNotNull()).withColumn("project", F.col("projectStableKey"))
    legacy_node = (F.col("nodeKind") == "LinqToSqlDataContext") | legacy_text("dataAccessTechnology") | legacy_text("framework") | legacy_text("runtimeKind")
    only = metadata_flag("metadata", "frameworkOnly") | metadata_flag("metadata", "package.frameworkOnly") | F.coalesce(F.lower(metadata_text("metadata", "dependencyKind")) == "frameworkonly", F.lit(False))
    facts = owned.groupBy(SNAP, "project").agg(
        F.count_if(legacy_node & (F.col("nodeKind") != "Project")).alias("legacy_nodes"), F.count_if((F.col("nodeKind") == "Package") & only).alias("framework_packages"),
        F.bool_or(F.col("nodeKind").isin(*DATA_ACCESS_KINDS)).alias("data_access"), F.bool_or(F.col("nodeKind") == "DatabaseTable").alias("has_tables"),
    )
    zero = lambda c, value=0: F.coalesce(c, F.lit(value))
    per = scopes.join(projects, [SNAP, "project"]).join(facts, [SNAP, "project"], "left").groupBy(*key).agg(
        (F.count_if("old") + F.sum(zero("legacy_nodes"))).alias("legacy"), F.count_if("unsupported").alias("out_of_support"), F.count_if("no_target").alias("without_target"),
        (F.sum(F.when(F.col("old"), F.col("packages")).otherwise(0)) + F.sum(zero("framework_packages"))).alias("framework_only"), F.count_if(zero("data_access", False)).alias("data_access_spread"), F.bool_or(zero("has_tables", False)).alias("has_tables"),
    )
    tables = owned.filter(F.col("nodeKind") == "DatabaseTable").select(SNAP, "project", F.lower(F.concat_ws(".", F.coalesce(F.trim(metadata_text("metadata", "schemaName")), F.lit("default")), F.trim(metadata_text("metadata", "tableName")))).alias("table"), metadata_text("metadata", "tableName").alias("name"))
    tables = tables.filter(F.col("name").isNotNull()).select(SNAP, "project", "table").distinct()
    shared = scopes.join(tables, [SNAP, "project"]).groupBy(*key, "table").agg(F.count("*").alias("n")).filter("n > 1").groupBy(*key).agg(F.count("*").alias("shared_tables"))
    sensitive = _any(contains_ci(c, w) for c in ("ruleCategory", "ruleCode", "title") for w in SECURITY) | (F.col("severity") == "Critical")
    touched = findings.filter(sensitive).select(SNAP, "stableKey", F.explode(F.array_distinct(F.array_compact(F.concat("affectedNodeStableKeys", F.array("primaryNodeStableKey"))))).alias("node"))
    owner = nodes.select(SNAP, F.col("stableKey").alias("node"), F.when(F.col("nodeKind") == "Project", F.col("stableKey")).otherwise(F.col("projectStableKey")).alias("project")).filter(F.col("project").isNotNull())
    by_project = touched.join(owner, [SNAP, "node"]).select(SNAP, "project", "stableKey").distinct()
    secure = scopes.join(by_project, [SNAP, "project"]).select(*key, "stableKey").distinct().groupBy(*key).agg(F.count("*").alias("security"))
    # the snapshot's own scope has a null key, which must meet itself
    named = lambda df: df.select(*[F.col(c).alias(f"__{c}") for c in key], *[c for c in df.columns if c not in key])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    out = per.join(named(shared), same, "left").drop(*[f"__{c}" for c in key]).join(named(secure), same, "left")
    return out.select(*key, "legacy", zero("security").alias("security"), "out_of_support", "without_target", "framework_only", "data_access_spread", zero("shared_tables").alias("shared_tables"), "has_tables")
