"""Runtime facts: endpoints with their controllers, details of controllers and handlers, workers with their schedules, and look-ups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci, metadata_text
from gneiss.operators.services import incident

SNAP = "snapshotStableKey"
# Kinds of edges by which services are named, and the metadata that marks handlers and scheduled jobs.
SERVICE_EDGES = ("INJECTS", "CALLS", "REFERENCES")
HANDLER_MARKS = (("runtimeRole", "Handler"), ("handlerKind", "ControllerHandler"), ("handlerKind", "MessageHandler"), ("typeRole", "HostedServiceImplementation"))
JOB_MARKS = (("runtimeKind", "ScheduledJob"), ("workerKind", "ScheduledJob"), ("scheduleKind", "ScheduledJob"))
ENDPOINT_SORTS = {"method": "method", "project": "project", "controller": "controller", "handler": "handler_or_method"}


def _marked(marks: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(False)
    for name, value in marks:
        out = out | F.coalesce(F.lower(metadata_text("metadata", name)) == value.lower(), F.lit(False))
    return out


def is_controller_or_handler() -> Column:
    return (F.col("nodeKind") == "Controller") | _marked(HANDLER_MARKS)


def is_scheduled_job() -> Column:
    return _marked(JOB_MARKS) | metadata_text("metadata", "schedule").isNotNull() | metadata_text("metadata", "cron").isNotNull()


def endpoint_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, method, route, project, controller, handler, action, method_name, authorization).

    Metadata says the controller and handler; else they are the node of that sort that an edge joins, of several the least name.
    """
    chosen = nodes.filter(F.col("nodeKind") == "Endpoint")
    sort = F.when(F.col("nodeKind") == "Controller", "controller").when(is_controller_or_handler(), "handler")
    acting = nodes.withColumn("sort", sort).filter(F.col("sort").isNotNull()).select(SNAP, F.col("stableKey").alias("node"), "sort", "displayName")
    near = incident(edges).join(acting, [SNAP, "node"]).groupBy(SNAP, F.col("other").alias("stableKey")).agg(*[F.min(F.when(F.col("sort") == s, F.col("displayName"))).alias(f"near_{s}") for s in ("controller", "handler")])
    said = lambda *names: metadata_text("metadata", *names)
    joined = chosen.join(near, [SNAP, "stableKey"], "left")
    return joined.select(
        SNAP, "stableKey", said("endpoint.httpMethod", "httpMethod", "method").alias("method"), F.coalesce(said("endpoint.route", "route"), F.col("qualifiedName"), F.col("displayName")).alias("route"), F.col("projectStableKey").alias("project"),
        F.coalesce(said("controller", "controllerName"), F.col("near_controller")).alias("controller"), F.coalesce(said("handler", "handlerName"), F.col("near_handler")).alias("handler"), said("action", "actionName").alias("action"), said("methodName").alias("method_name"),
        said("authorizationAttributes", "authorization", "authorizeAttributes").alias("authorization"),
    )


def endpoint_page(rows: DataFrame, method: str | None = None, route: str | None = None, project: str | None = None, acting: str | None = None, authorization: str | None = None, sort: str = "route", descending: bool = False, skip: int = 0, take: int = 50) -> DataFrame:
    """A page of :func:`endpoint_rows`: method with case ignored, project exactly, the others as a part of the text; blank filters pass all. One sort column (route unless known), then the key."""
    keep = F.lit(True)
    if method and method.strip():
        keep = keep & (F.lower("method") == method.strip().lower())
    if route and route.strip():
        keep = keep & contains_ci("route", route)
    if project and project.strip():
        keep = keep & (F.col("project") == project.strip())
    if acting and acting.strip():
        keep = keep & (contains_ci("controller", acting) | contains_ci("handler", acting) | contains_ci("action", acting) | contains_ci("method_name", acting))
    if authorization and authorization.strip():
        keep = keep & contains_ci("authorization", authorization)
    known = rows.withColumn("handler_or_method", F.coalesce("handler", "method_name"))
    first = F.upper(F.coalesce(F.col(ENDPOINT_SORTS.get(sort.strip().lower(), "route")), F.lit("")))
    return known.filter(F.coalesce(keep, F.lit(False))).orderBy(first.desc() if descending else first.asc(), "stableKey").drop("handler_or_method").offset(skip).limit(take)


def controller_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, name, qualified, kind, project, endpoints, services) of every controller and handler.

    Its endpoints are those that an edge joins to it, and those that name it (case ignored), in order of their keys; its services are
    the names of what it injects, calls or refers to, or that does so to it.
    """
    chosen = nodes.filter(is_controller_or_handler()).select(SNAP, "stableKey", F.col("displayName").alias("name"), F.col("qualifiedName").alias("qualified"), F.col("nodeKind").alias("kind"), F.col("projectStableKey").alias("project"))
    around = incident(edges).join(chosen.select(SNAP, F.col("stableKey").alias("node")), [SNAP, "node"], "left_semi")
    rows = endpoint_rows(nodes, edges)
    by_edge = around.select(SNAP, F.col("node").alias("stableKey"), F.col("other").alias("endpoint")).join(rows.select(SNAP, F.col("stableKey").alias("endpoint")), [SNAP, "endpoint"], "left_semi")
    named = rows.select(SNAP, F.col("stableKey").alias("endpoint"), F.explode(F.array_distinct(F.array_compact(F.array(F.lower("controller"), F.lower("handler"))))).alias("low"))
    by_name = chosen.select(SNAP, "stableKey", F.lower("name").alias("low")).join(named, [SNAP, "low"]).select(SNAP, "stableKey", "endpoint")
    # a pair counts once; pairs are combined per task before they are gathered
    endpoints = by_edge.select(SNAP, "stableKey", "endpoint").unionByName(by_name).distinct().groupBy(SNAP, "stableKey").agg(F.array_sort(F.collect_list("endpoint")).alias("endpoints"))
    names = nodes.select(SNAP, F.col("stableKey").alias("other"), "displayName")
    services = around.filter(F.col("edgeKind").isin(*SERVICE_EDGES)).join(names, [SNAP, "other"]).groupBy(SNAP, F.col("node").alias("stableKey")).agg(F.array_join(F.array_sort(F.collect_set("displayName")), ", ").alias("services"))
    joined = chosen.join(endpoints, [SNAP, "stableKey"], "left").join(services, [SNAP, "stableKey"], "left")
    return joined.withColumns({"endpoints": F.coalesce("endpoints", F.array().cast("array<string>")), "services": F.coalesce("services", F.lit(""))})


def _one(found: DataFrame, key: str | None, name: str | None, by_name: Column, what: str) -> DataFrame:
    if bool(key and key.strip()) == bool(name and name.strip()):
        raise ValueError(f"{what}IdentityInvalid")
    hits = found.filter(F.col("stableKey") == key.strip() if key and key.strip() else by_name)
    count = hits.limit(2).count()
    if count == 0:
        raise LookupError(f"{what}NotFound")
    if count > 1:
        raise LookupError(f"{what}Ambiguous")
    return hits


def controller_or_handler(details: DataFrame, key: str | None = None, name: str | None = None) -> DataFrame:
    """The one controller or handler with a key, or with a name (display or qualified, case ignored) that no other has; an error else."""
    low = (name or "").strip().lower()
    return _one(details, key, name, (F.lower("name") == low) | F.coalesce(F.lower("qualified") == low, F.lit(False)), "ControllerOrHandler")


def project_by(nodes: DataFrame, key: str | None = None, name: str | None = None) -> DataFrame:
    """The one project node with a key, or with a display name (case ignored) that no other has; an error else."""
    return _one(nodes.filter(F.col("nodeKind") == "Project"), key, name, F.lower("displayName") == (name or "").strip().lower(), "Project")


def worker_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, key, worker_kind, project, consumers, jobs): hosted services with the queues, topics and scheduled jobs that an edge joins to them; and of those that no service covers each as a worker of its own."""
    sort = F.when(F.col("nodeKind").isin("Queue", "Topic"), "consumer").when(is_scheduled_job(), "job")
    hosted = nodes.filter(F.col("nodeKind") == "HostedService")
    parts = nodes.filter(F.col("nodeKind") != "HostedService").withColumn("sort", sort).filter(F.col("sort").isNotNull()).select(SNAP, F.col("stableKey").alias("other"), "sort", "nodeKind", F.col("projectStableKey").alias("project"))
    joined = incident(edges).join(hosted.select(SNAP, F.col("stableKey").alias("node")), [SNAP, "node"], "left_semi").join(parts.select(SNAP, "other", "sort"), [SNAP, "other"]).select(SNAP, "node", "other", "sort").distinct()
    held = joined.groupBy(SNAP, F.col("node").alias("stableKey")).agg(*[F.array_sort(F.collect_list(F.when(F.col("sort") == s, F.col("other")))).alias(n) for s, n in (("consumer", "consumers"), ("job", "jobs"))])
    none = F.array().cast("array<string>")
    services = hosted.join(held, [SNAP, "stableKey"], "left").select(SNAP, F.col("stableKey").alias("key"), F.coalesce(metadata_text("metadata", "runtimeKind"), F.col("nodeKind")).alias("worker_kind"), F.col("projectStableKey").alias("project"), *[F.coalesce(c, none).alias(c) for c in ("consumers", "jobs")])
    alone = parts.join(joined.select(SNAP, "other"), [SNAP, "other"], "left_anti")
    kind = F.when(F.col("sort") == "job", "ScheduledJob").when(F.col("nodeKind") == "Topic", "TopicConsumer").otherwise("QueueConsumer")
    own = alone.select(SNAP, F.concat(F.lit("worker://"), "other").alias("key"), kind.alias("worker_kind"), "project", *[F.when(F.col("sort") == s, F.array("other")).otherwise(none).alias(n) for s, n in (("consumer", "consumers"), ("job", "jobs"))])
    return services.unionByName(own)


def _holding(text: str):
    return lambda key: contains_ci(key, text)


def worker_page(rows: DataFrame, project: str | None = None, kind: str | None = None, queue: str | None = None, job: str | None = None, skip: int = 0, take: int = 50) -> DataFrame:
    """A page of :func:`worker_rows` in key order: the kind with case ignored, also where only a part of the worker is of it; queue and job as a part of a key."""
    keep = F.lit(True)
    if project and project.strip():
        keep = keep & (F.col("project") == project.strip())
    if kind and kind.strip():
        low = kind.strip().lower()
        inner = (F.size("jobs") > 0) if low == "scheduledjob" else (F.size("consumers") > 0) if low in ("queueconsumer", "topicconsumer") else F.lit(False)
        keep = keep & ((F.lower("worker_kind") == low) | inner)
    for text, column in ((queue, "consumers"), (job, "jobs")):
        if text and text.strip():
            keep = keep & F.exists(column, _holding(text))
    return rows.filter(F.coalesce(keep, F.lit(False))).orderBy("key").offset(skip).limit(take)


def usages_of(usages: DataFrame, symbol: str, direction: str = "Incoming", skip: int = 0, take: int = 50) -> DataFrame:
    """A page of the usages of one symbol, by direction, in the order of kind, source, target and key."""
    if direction not in ("Incoming", "Outgoing"):
        raise ValueError("DirectionInvalid")
    side = "source" if direction == "Outgoing" else "target"
    return usages.filter(F.col(side) == symbol).orderBy("edgeKind", "source", "target", "stableKey").offset(skip).limit(take)


def data_access_after_page(page: DataFrame, context: str | None = None) -> DataFrame:
    """What a tool shows of a page of data-access facts: one context's, sorted by family and name with case ignored, project and key exactly. The filter comes after the page, so it may leave fewer rows than there are."""
    kept = page.filter(F.col("stableKey") == context.strip()) if context and context.strip() else page
    return kept.orderBy(F.upper("family"), F.coalesce("project", F.lit("")), F.upper("name"), "stableKey")


def finding_uses(findings: DataFrame) -> DataFrame:
    """(scope, evidence, kind, key, relation) of findings, the fourth kind of record that an evidence supports: ``evidenceStableKeys``, of which ``primaryEvidenceStableKey`` is the first proof."""
    spread = findings.select(SNAP, F.col("stableKey").alias("key"), "primaryEvidenceStableKey", F.explode(F.array_distinct(F.array_compact("evidenceStableKeys"))).alias("evidence"))
    primary = F.coalesce(F.col("primaryEvidenceStableKey") == F.col("evidence"), F.lit(False))
    return spread.select(SNAP, "evidence", F.lit("Finding").alias("kind"), "key", F.when(primary, "PrimaryEvidence").otherwise("SupportingEvidence").alias("relation"))
