"""The user-visible queries: search, symbols, runtime, facts, evidence, catalogue, dashboard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci, infer_container, infer_namespace, metadata_text, metadata_variant, one_of, preview, safe_host, secret_like, variant_text
from gneiss.operators.findings import severity_rank

SNAP = "snapshotStableKey"
# Node kinds by how a search shows them, and the order of its groups.
PROJECT_KINDS, SYMBOL_KINDS, RUNTIME_KINDS = ("Project",), ("Namespace", "Type", "Method", "Property", "Field"), ("Endpoint", "Controller", "HostedService")
SEARCH_ORDER = ("Project", "Symbol", "RuntimeEndpoint", "Fact", "Evidence", "Finding", "Metric")
USAGE_KINDS = ("REFERENCES", "CALLS", "IMPLEMENTS", "INHERITS", "HANDLES")
DATA_ACCESS_NODES = ("DbContext", "LinqToSqlDataContext", "Entity", "DatabaseTable", "StoredProcedure", "SqlScript")
OPERATIONS = {"USES_DB_CONTEXT": "UsesDbContext", "USES_LINQ_TO_SQL_CONTEXT": "UsesLinqToSqlContext", "MAPS_ENTITY": "MapsEntity", "MAPS_TABLE": "MapsTable", "READS_TABLE": "Read", "WRITES_TABLE": "Write", "CALLS_STORED_PROCEDURE": "StoredProcedure", "EXECUTES_RAW_SQL": "RawSql"}
UI_NODES = ("UiApplication", "UiComponent", "UiPage", "UiView", "UiLayout", "UiRoute", "UiControl", "UiResource", "UiStyle", "ViewModel", "Command", "Binding")
UI_TECHNOLOGIES = (("blazor", "Blazor"), ("razor", "Razor"), ("winforms", "Windows Forms"), ("windows forms", "Windows Forms"), ("winui", "WinUI"), ("maui", ".NET MAUI"), ("avalonia", "Avalonia"), ("wpf", "WPF"))
RUNTIME_WORDS = (("api", "Api"), ("web", "Api"), ("worker", "Worker"), ("hosted", "Worker"), ("background", "Worker"), ("service", "ServiceHost"))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def search(nodes: DataFrame, evidence: DataFrame, findings: DataFrame, metrics: DataFrame, text: str, project: str | None = None) -> DataFrame:
    """Records that contain a text in any of their public fields, case ignored: (scope, result_kind, kind_order, key, title). A project filter does not touch evidence."""
    kind = F.when(F.col("nodeKind").isin(*PROJECT_KINDS), "Project").when(F.col("nodeKind").isin(*SYMBOL_KINDS), "Symbol").when(F.col("nodeKind").isin(*RUNTIME_KINDS), "RuntimeEndpoint").otherwise("Fact")
    has = lambda *names: _any([contains_ci(n, text) for n in names])
    of_project = lambda *names: F.lit(True) if project is None else F.coalesce(_any([F.coalesce(F.col(n) == project, F.lit(False)) for n in names]), F.lit(False))
    found = nodes.filter(has("stableKey", "displayName", "qualifiedName", "searchName", "nodeKind", "language", "projectStableKey") & of_project("stableKey", "projectStableKey")).select(SNAP, kind.alias("result_kind"), F.col("stableKey").alias("key"), F.col("displayName").alias("title"))
    proof = evidence.filter(has("stableKey", "filePath", "symbolName", "snippetPreview", "evidenceKind")).select(SNAP, F.lit("Evidence").alias("result_kind"), F.col("stableKey").alias("key"), F.col("filePath").alias("title"))
    listed = F.exists("affectedNodeStableKeys", lambda k: contains_ci(k, text))
    touches = F.lit(True) if project is None else (F.coalesce(F.col("primaryNodeStableKey") == project, F.lit(False)) | F.array_contains("affectedNodeStableKeys", project))
    hits = findings.filter((has("stableKey", "ruleCode", "title", "severity", "status") | listed) & touches).select(SNAP, F.lit("Finding").alias("result_kind"), F.col("stableKey").alias("key"), "title")
    measured = metrics.filter(has("metricKind", "node") & of_project("node")).select(SNAP, F.lit("Metric").alias("result_kind"), F.concat_ws("/", "metricKind", "node").alias("key"), F.col("metricKind").alias("title"))
    order = F.lit(99)
    for i, name in enumerate(SEARCH_ORDER):
        order = F.when(F.col("result_kind") == name, i).otherwise(order)
    return found.unionByName(proof).unionByName(hits).unionByName(measured).withColumn("kind_order", order)


def symbols(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Symbols with their namespace and container, said by metadata or inferred, and where their evidence lies."""
    key = [SNAP, "stableKey"]
    chosen = nodes.filter(F.col("nodeKind").isin(*SYMBOL_KINDS))
    parents = nodes.filter(F.col("nodeKind") == "Type").select(SNAP, F.col("stableKey").alias("parentNodeStableKey"), F.coalesce("qualifiedName", "displayName").alias("parent_name"))
    places = evidence.select(SNAP, F.col("stableKey").alias("primaryEvidenceStableKey"), "filePath", "startLine", "endLine")
    joined = chosen.join(parents, [SNAP, "parentNodeStableKey"], "left").join(places, [SNAP, "primaryEvidenceStableKey"], "left")
    container = F.coalesce(metadata_text("metadata", "containingType"), F.col("parent_name"), F.when(F.col("nodeKind") != "Type", infer_container("qualifiedName")))
    return joined.select(*key, "displayName", "qualifiedName", "nodeKind", "projectStableKey", F.coalesce(metadata_text("metadata", "namespace"), infer_namespace("qualifiedName")).alias("namespace"), container.alias("container"), "language", "filePath", "startLine", "endLine")


def symbol_search(found: DataFrame, text: str | None = None, filters: Mapping[str, str] | None = None, sort: str = "displayName", descending: bool = False, skip: int = 0, take: int = 50) -> DataFrame:
    """A page of symbols: the text in key or names, filters with case ignored, one sort column with nulls as empty text, then the key and snapshot ascending."""
    keep = F.lit(True) if not text else contains_ci("stableKey", text) | contains_ci("displayName", text) | contains_ci("qualifiedName", text)
    for name, value in (filters or {}).items():
        keep = keep & (F.col(name) == value.strip() if name == "projectStableKey" else F.lower(F.col(name)) == value.strip().lower())
    first = F.upper(F.coalesce(F.col(sort).cast("string"), F.lit("")))
    return found.filter(keep).orderBy(first.desc() if descending else first.asc(), "stableKey", SNAP).offset(skip).limit(take)


def symbol_usages(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Semantic edges with the names of their ends and the place of their first evidence; ends and evidence may be missing."""
    name = lambda which: nodes.select(SNAP, F.col("stableKey").alias(which), F.col("displayName").alias(f"{which}_name"))
    places = evidence.select(SNAP, F.col("stableKey").alias("evidence_key"), "filePath", "startLine", F.col("unknownState.hasUnknownData").alias("evidence_unknown"))
    used = edges.filter(F.col("edgeKind").isin(*USAGE_KINDS)).withColumn("evidence_key", F.try_element_at("evidenceStableKeys", F.lit(1)))
    joined = used.join(name("source"), [SNAP, "source"], "left").join(name("target"), [SNAP, "target"], "left").join(places, [SNAP, "evidence_key"], "left")
    return joined.select(SNAP, "stableKey", "edgeKind", "source", "target", "source_name", "target_name", "filePath", "startLine", F.coalesce("evidence_unknown", F.lit(False)).alias("unknown"), "confidence")


def incident(edges: DataFrame) -> DataFrame:
    """Each edge at each of its ends: (scope, node, edge, edgeKind, other); a loop once. Two equi joins instead of one on either end."""
    ends = F.array_distinct(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))
    spread = edges.select(SNAP, F.col("stableKey").alias("edge"), "edgeKind", F.explode(ends).alias("end"))
    return spread.select(SNAP, "end.node", "edge", "edgeKind", "end.other")


def _texts(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def data_access_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, family, project, operations, related): database nodes with what is done to them and by whom; the nodes themselves count as related."""
    chosen = nodes.filter(F.col("nodeKind").isin(*DATA_ACCESS_NODES))
    family = F.coalesce(metadata_text("metadata", "dataAccessFamily", "family", "orm"), F.when(F.col("nodeKind") == "LinqToSqlDataContext", "LinqToSql").when(F.col("nodeKind") == "DbContext", "EFCore").when(F.col("nodeKind") == "DatabaseTable", "Table").when(F.col("nodeKind") == "SqlScript", "RawSql").otherwise(F.col("nodeKind")))
    named = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])[F.col("edgeKind")]
    around = incident(edges).join(chosen.select(SNAP, F.col("stableKey").alias("node")), [SNAP, "node"], "left_semi").withColumn("operation", named)
    known = nodes.select(SNAP, F.col("stableKey").alias("other"))
    used = around.groupBy(SNAP, F.col("node").alias("stableKey")).agg(_texts("operation").alias("operations"))
    related = around.join(known, [SNAP, "other"], "left_semi").groupBy(SNAP, F.col("node").alias("stableKey")).agg(F.count_distinct("other").alias("related"))
    joined = chosen.join(used, [SNAP, "stableKey"], "left").join(related, [SNAP, "stableKey"], "left")
    return joined.select(SNAP, "stableKey", family.alias("family"), F.col("projectStableKey").alias("project"), F.coalesce("operations", F.lit("")).alias("operations"), F.coalesce("related", F.lit(0)).alias("related"))


def configuration_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, key, project, consumers, provider, secret_like): configuration keys and who reads them; values are never shown."""
    chosen = nodes.filter(F.col("nodeKind") == "ConfigurationKey")
    others = nodes.filter(F.col("nodeKind") != "ConfigurationKey").select(SNAP, F.col("stableKey").alias("other"))
    users = incident(edges).join(chosen.select(SNAP, F.col("stableKey").alias("node")), [SNAP, "node"], "left_semi").join(others, [SNAP, "other"], "left_semi")
    users = users.groupBy(SNAP, F.col("node").alias("stableKey")).agg(_texts("other").alias("consumers"))
    key = F.coalesce(metadata_text("metadata", "configurationKey", "key"), F.col("displayName"))
    joined = chosen.join(users, [SNAP, "stableKey"], "left")
    return joined.select(SNAP, "stableKey", key.alias("key"), F.col("projectStableKey").alias("project"), F.coalesce("consumers", F.lit("")).alias("consumers"), metadata_text("metadata", "provider").alias("provider"), secret_like(key).alias("secret_like"))


def integration_facts(nodes: DataFrame) -> DataFrame:
    """(scope, stableKey, kind, host, protocol, project): outside services and queues by their safe host; those without one are left out."""
    # the metadata is parsed once, and each step is a column of its own, so that nothing is computed twice
    parsed = nodes.withColumn("m", metadata_variant("metadata"))
    read = lambda *names: variant_text(F.col("m"), *names)
    said = parsed.select(SNAP, "stableKey", "nodeKind", "projectStableKey", read("integrationKind").alias("said_kind"), read("endpointHost").alias("h1"), read("serviceName").alias("h3"), read("host").alias("h2"), read("url").alias("h4"), read("transportKind", "transport").alias("transport"), read("protocol").alias("said_protocol"), "displayName")
    chosen = said.filter(F.col("nodeKind").isin("ExternalService", "Queue", "Topic", "OpenApiDocument") | F.col("said_kind").isNotNull() | F.col("h1").isNotNull() | F.col("h3").isNotNull())
    kind = F.coalesce("said_kind", F.when(F.col("nodeKind") == "OpenApiDocument", "OpenApi").otherwise(F.col("nodeKind")))
    inferred = F.when(F.col("nodeKind").isin("Queue", "Topic"), F.col("transport")).when(F.col("nodeKind").isin("OpenApiDocument", "ExternalService"), F.lit("HTTP"))
    named = chosen.select(SNAP, "stableKey", kind.alias("kind"), F.coalesce("h1", "h2", "h3", "h4", "displayName").alias("target"), F.coalesce("said_protocol", inferred).alias("protocol"), F.col("projectStableKey").alias("project"))
    rows = named.select(SNAP, "stableKey", "kind", F.explode(F.array_compact(F.array(F.nullif(F.trim(safe_host("target")), F.lit(""))))).alias("host"), "protocol", "project")
    return rows


def ui_facts(nodes: DataFrame) -> DataFrame:
    """(scope, stableKey, technology, kind, project, route): user-interface nodes; the technology is said by metadata of node or project, else by words in names."""
    projects = nodes.filter(F.col("nodeKind") == "Project").select(SNAP, F.col("stableKey").alias("projectStableKey"), F.col("displayName").alias("p_name"), F.col("metadata").alias("p_meta"))
    joined = nodes.filter(F.col("nodeKind").isin(*UI_NODES)).join(projects, [SNAP, "projectStableKey"], "left")
    words = F.concat_ws(" ", "stableKey", "qualifiedName", "displayName", "projectStableKey", "p_name", metadata_text("p_meta", "application.type"))
    technology = F.coalesce(metadata_text("metadata", "uiTechnology", "technology"), metadata_text("p_meta", "uiTechnology"), one_of(words, UI_TECHNOLOGIES, "Unknown UI Technology"))
    return joined.select(SNAP, "stableKey", technology.alias("technology"), F.col("nodeKind").alias("kind"), F.col("projectStableKey").alias("project"), metadata_text("metadata", "route", "path", "viewPath").alias("route"))


def runtime_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, method, route, project, uses): endpoints with the names of what they call, inject or refer to."""
    chosen = nodes.filter(F.col("nodeKind") == "Endpoint")
    names = nodes.select(SNAP, F.col("stableKey").alias("other"), "displayName")
    around = incident(edges.filter(F.col("edgeKind").isin("INJECTS", "CALLS", "REFERENCES"))).join(chosen.select(SNAP, F.col("stableKey").alias("node")), [SNAP, "node"], "left_semi")
    uses = around.join(names, [SNAP, "other"]).groupBy(SNAP, F.col("node").alias("stableKey")).agg(_texts("displayName").alias("uses"))
    joined = chosen.join(uses, [SNAP, "stableKey"], "left")
    return joined.select(SNAP, "stableKey", metadata_text("metadata", "endpoint.httpMethod", "httpMethod", "method").alias("method"), F.coalesce(metadata_text("metadata", "endpoint.route", "route"), F.col("qualifiedName"), F.col("displayName")).alias("route"), F.col("projectStableKey").alias("project"), F.coalesce("uses", F.lit("")).alias("uses"))


def runtime_kind(value: Column) -> Column:
    """Api, Worker, ServiceHost or Console by words; the Console is also what nothing is said of."""
    return one_of(value, RUNTIME_WORDS, "Console")


def entry_points(nodes: DataFrame) -> DataFrame:
    """(scope, key, runtime_kind, project, services, endpoints): every project, and nodes that are entry points of themselves."""
    projects = nodes.filter(F.col("nodeKind") == "Project")
    owned = nodes.filter(F.col("projectStableKey").isNotNull()).groupBy(SNAP, F.col("projectStableKey").alias("stableKey")).agg(F.count_if(F.col("nodeKind") == "HostedService").alias("services"), F.count_if(F.col("nodeKind") == "Endpoint").alias("endpoints"))
    own = projects.join(owned, [SNAP, "stableKey"], "left").select(SNAP, F.concat(F.lit("entrypoint://"), F.col("stableKey")).alias("key"), runtime_kind(metadata_text("metadata", "application.type", "runtimeKind", "runtime.kind")).alias("runtime_kind"), F.col("stableKey").alias("project"), F.coalesce("services", F.lit(0)).alias("services"), F.coalesce("endpoints", F.lit(0)).alias("endpoints"))
    explicit = nodes.filter(F.col("nodeKind").isin("OpenApiDocument", "Dockerfile", "Pipeline")).select(SNAP, F.col("stableKey").alias("key"), runtime_kind(F.coalesce(metadata_text("metadata", "runtimeKind"), F.col("nodeKind"))).alias("runtime_kind"), F.col("projectStableKey").alias("project"), F.lit(0).alias("services"), F.lit(0).alias("endpoints"))
    return own.unionByName(explicit)


def workers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, key, worker_kind, consumers): hosted services with the queues and topics of their project or edges, and those queues that no service covers."""
    services = nodes.filter(F.col("nodeKind") == "HostedService").select(SNAP, F.col("stableKey").alias("key"), F.col("projectStableKey").alias("project"))
    queues = nodes.filter(F.col("nodeKind").isin("Queue", "Topic")).select(SNAP, F.col("stableKey").alias("queue"), F.col("projectStableKey").alias("project"))
    by_project = services.join(queues, [SNAP, "project"]).select(SNAP, "key", "queue")
    by_edge = incident(edges).select(SNAP, F.col("node").alias("key"), F.col("other").alias("queue")).join(services.select(SNAP, "key"), [SNAP, "key"], "left_semi").join(queues.select(SNAP, "queue"), [SNAP, "queue"], "left_semi").select(SNAP, "key", "queue")
    covered = by_project.unionByName(by_edge).distinct()
    counted = covered.groupBy(SNAP, "key").agg(F.count("*").alias("consumers"))
    hosted = services.join(counted, [SNAP, "key"], "left").select(SNAP, "key", F.lit("HostedService").alias("worker_kind"), F.coalesce("consumers", F.lit(0)).alias("consumers"))
    alone = queues.join(covered.select(SNAP, "queue").distinct(), [SNAP, "queue"], "left_anti").select(SNAP, F.col("queue").alias("key"), F.lit("Consumer").alias("worker_kind"), F.lit(1).cast("long").alias("consumers"))
    return hosted.unionByName(alone)


def evidence_uses(nodes: DataFrame, edges: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(scope, evidence, kind, key, relation): records of three kinds that an evidence supports."""
    first = nodes.filter(F.col("primaryEvidenceStableKey").isNotNull()).select(SNAP, F.col("primaryEvidenceStableKey").alias("evidence"), F.lit("Node").alias("kind"), F.col("stableKey").alias("key"), F.lit("PrimaryEvidence").alias("relation"))
    many = lambda rows, kind: rows.select(SNAP, F.posexplode("evidenceStableKeys").alias("at", "evidence"), F.lit(kind).alias("kind"), F.col("stableKey").alias("key")).filter(F.col("evidence").isNotNull()).select(SNAP, "evidence", "kind", "key", F.when(F.col("at") == 0, "PrimaryEvidence").otherwise("SupportingEvidence").alias("relation"))  # noqa: E731, E501
    return first.unionByName(many(edges, "Edge")).unionByName(many(hotspots, "Hotspot"))


def evidence_preview(evidence: DataFrame, length: int = 240) -> DataFrame:
    return evidence.select(SNAP, "stableKey", preview("snippetPreview", length).alias("preview"), F.length(F.coalesce("snippetPreview", F.lit(""))).alias("original_length"))


def project_catalogue(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(scope, stableKey, name, type, dependencies, dependents, packages, endpoints, data_access, findings, highest, has_findings, has_unknown) of every project."""
    projects = nodes.filter(F.col("nodeKind") == "Project")
    key = [SNAP, "stableKey"]
    ends = edges.filter(F.col("edgeKind").isin("REFERENCES", "DEPENDS_ON", "USES_PACKAGE")).select(SNAP, F.explode(F.array(F.struct(F.col("source").alias("stableKey"), F.when(F.col("edgeKind") == "USES_PACKAGE", "package").otherwise("out").alias("role")), F.struct(F.col("target").alias("stableKey"), F.when(F.col("edgeKind") == "USES_PACKAGE", "none").otherwise("in").alias("role")))).alias("end")).select(SNAP, "end.*")
    degree = ends.groupBy(*key).agg(*[F.count_if(F.col("role") == r).alias(n) for r, n in (("out", "dependencies"), ("in", "dependents"), ("package", "packages"))])
    owned = nodes.filter(F.col("projectStableKey").isNotNull()).groupBy(SNAP, F.col("projectStableKey").alias("stableKey")).agg(F.count_if(F.col("nodeKind") == "Endpoint").alias("endpoints"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("nodeKind").isin(*DATA_ACCESS_NODES), F.col("nodeKind")))), ", ").alias("data_access"))
    spread = findings.select(SNAP, "stableKey", "severity", "hasUnknownData", F.explode(F.array_distinct(F.array_compact(F.concat("affectedNodeStableKeys", F.array("primaryNodeStableKey"))))).alias("node"))
    flagged = spread.groupBy(SNAP, F.col("node").alias("stableKey")).agg(F.count("*").alias("findings"), F.max_by("severity", severity_rank(F.col("severity"))).alias("highest"), F.bool_or("hasUnknownData").alias("has_unknown"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = projects.join(degree, key, "left").join(owned, key, "left").join(flagged, key, "left")
    return joined.select(
        *key, F.col("displayName").alias("name"), metadata_text("metadata", "project.type", "architecture.layer").alias("type"), zero("dependencies"), zero("dependents"), zero("packages"), zero("endpoints"), F.coalesce("data_access", F.lit("")).alias("data_access"), zero("findings"), "highest",
        F.col("findings").isNotNull().alias("has_findings"), F.coalesce("has_unknown", F.lit(False)).alias("has_unknown"),
    )


def catalogue_page(catalogue: DataFrame, search_text: str | None = None, kind: str | None = None, has_risk: bool | None = None, sort: str = "name", descending: bool = False, skip: int = 0, take: int = 50) -> DataFrame:
    """A page of the catalogue. ``has_risk`` passes a project whose findings or whose unknowns are as asked, so False also passes one with findings and without unknowns."""
    keep = F.lit(True)
    if search_text:
        keep = keep & (contains_ci("name", search_text) | contains_ci("stableKey", search_text))
    if kind:
        keep = keep & (F.lower("type") == kind.lower())
    if has_risk is not None:
        keep = keep & ((F.col("has_findings") == has_risk) | (F.col("has_unknown") == has_risk))
    column = F.col(sort) if sort in ("dependencies", "dependents", "packages", "endpoints", "findings") else F.upper(F.coalesce(F.col(sort), F.lit("")))
    return catalogue.filter(keep).orderBy(column.desc() if descending else column.asc(), "stableKey").offset(skip).limit(take)


def dashboard_counts(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each snapshot: projects, by language and kind, endpoints, data contexts, findings; all node counts in one pass."""
    project = F.col("nodeKind") == "Project"
    language = F.lower(F.coalesce("language", F.lit("")))
    said = F.lower(F.coalesce(metadata_text("metadata", "application.type"), F.lit("")))
    counts = nodes.groupBy(SNAP).agg(
        F.count_if(project).alias("projects"), F.count_if(project & language.isin("c#", "csharp")).alias("csharp"), F.count_if(project & language.isin("vb", "visual basic", "vb.net", "visualbasic")).alias("visual_basic"),
        F.count_if(project & (said == "api")).alias("apis"), F.count_if(project & (said == "worker")).alias("workers"), F.count_if(F.col("nodeKind") == "Endpoint").alias("endpoints"), F.count_if(F.col("nodeKind").isin("DbContext", "LinqToSqlDataContext")).alias("data_contexts"),
    )
    found = findings.groupBy(SNAP).agg(F.count("*").alias("findings"))
    return counts.join(found, SNAP, "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def key_changes(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(current, domain, added, removed): keys of (scope, domain, stableKey) that only one snapshot of a pair (current, previous) has; rows count, not distinct keys."""
    now = records.join(pairs.select(F.col("current").alias(SNAP), "current"), SNAP).select("current", "domain", "stableKey", F.lit(1).alias("side"))
    then = records.join(pairs.select(F.col("previous").alias(SNAP), "current"), SNAP).select("current", "domain", "stableKey", F.lit(-1).alias("side"))
    per = now.unionByName(then).groupBy("current", "domain", "stableKey").agg(F.count_if(F.col("side") == 1).alias("now"), F.count_if(F.col("side") == -1).alias("was"))
    return per.groupBy("current", "domain").agg(F.sum(F.when(F.col("was") == 0, F.col("now")).otherwise(0)).alias("added"), F.sum(F.when(F.col("now") == 0, F.col("was")).otherwise(0)).alias("removed"))
