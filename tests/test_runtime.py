import pytest

from gneiss.operators import runtime as r

NODE = "snapshotStableKey string, stableKey string, nodeKind string, displayName string, qualifiedName string, projectStableKey string, metadata string"
NODES = [
    ("s", "c1", "Controller", "Orders", "Shop.Orders", "p1", "{}"), ("s", "c2", "Controller", "orders", "Shop.Other", "p2", "{}"), ("s", "m1", "Method", "Handle", None, "p1", '{"runtimeRole":"handler"}'),
    ("s", "e1", "Endpoint", "E1", None, "p1", '{"httpMethod":"GET","route":"/a","authorization":"Admin"}'), ("s", "e2", "Endpoint", "E2", "Q.E2", "p1", '{"httpMethod":"post","controller":"ORDERS"}'), ("s", "e3", "Endpoint", "E3", None, "p2", "{}"),
    ("s", "h1", "HostedService", "H1", None, "p1", "{}"), ("s", "h2", "HostedService", "H2", None, "p1", '{"runtimeKind":"Worker"}'), ("s", "q1", "Queue", "Q1", None, "p1", "{}"), ("s", "t1", "Topic", "T1", None, "p1", "{}"), ("s", "j1", "Method", "J1", None, "p1", '{"cron":"* *"}'), ("s", "j2", "Pipeline", "J2", None, None, '{"workerKind":"ScheduledJob"}'),
    ("s", "p1", "Project", "Shop", None, None, "{}"), ("s", "p2", "Project", "shop", None, None, "{}"), ("s", "p3", "Project", "Only", None, None, "{}"),
]
EDGES = [("s", "x1", "CALLS", "c1", "e1"), ("s", "x2", "REFERENCES", "m1", "e3"), ("s", "x3", "HANDLES", "h1", "q1"), ("s", "x4", "HANDLES", "h1", "j1"), ("s", "x5", "HANDLES", "h1", "j1"), ("s", "x6", "INJECTS", "c1", "gone")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "snapshotStableKey string, stableKey string, edgeKind string, source string, target string")


def test_endpoints_and_their_pages(graph):
    rows = r.endpoint_rows(*graph)
    assert {(x.stableKey, x.controller, x.handler, x.route) for x in rows.collect()} == {("e1", "Orders", None, "/a"), ("e2", "ORDERS", None, "Q.E2"), ("e3", None, "Handle", "E3")}
    keys = lambda **options: [x.stableKey for x in r.endpoint_page(rows, **options).collect()]
    assert keys() == ["e1", "e3", "e2"] and keys(method=" POST ") == ["e2"] and keys(route="/A") == ["e1"] and keys(project="p2") == ["e3"] and keys(acting="order") == ["e1", "e2"] and keys(authorization="adm") == ["e1"]
    assert keys(sort="handler", descending=True) == ["e3", "e1", "e2"] and keys(sort="method", skip=1, take=1) == ["e1"] and keys(method=" ") == ["e1", "e3", "e2"] and keys(sort="unheard of") == ["e1", "e3", "e2"]


def test_controllers(graph):
    details = r.controller_details(*graph)
    got = {x.stableKey: (list(x.endpoints), x.services) for x in details.collect()}
    assert got == {"c1": (["e1", "e2"], "E1"), "c2": (["e1", "e2"], ""), "m1": (["e3"], "E3")}
    assert r.controller_or_handler(details, name=" shop.ORDERS ").first().stableKey == "c1" and r.controller_or_handler(details, key="m1").first().name == "Handle"
    for options, error in (({}, ValueError), ({"key": "c1", "name": "x"}, ValueError), ({"name": "ORDERS"}, LookupError), ({"key": "e1"}, LookupError)):
        with pytest.raises(error):
            r.controller_or_handler(details, **options)


def test_projects_by_name(graph):
    assert r.project_by(graph[0], name="only").first().stableKey == "p3" and r.project_by(graph[0], key="p1").first().displayName == "Shop"
    with pytest.raises(LookupError, match="ProjectAmbiguous"):
        r.project_by(graph[0], name="SHOP")
    with pytest.raises(LookupError, match="ProjectNotFound"):
        r.project_by(graph[0], key="c1")


def test_workers(graph):
    rows = r.worker_rows(*graph)
    got = {x.key: (x.worker_kind, list(x.consumers), list(x.jobs)) for x in rows.collect()}
    assert got == {"h1": ("HostedService", ["q1"], ["j1"]), "h2": ("Worker", [], []), "worker://t1": ("TopicConsumer", ["t1"], []), "worker://j2": ("ScheduledJob", [], ["j2"])}
    keys = lambda **options: [x.key for x in r.worker_page(rows, **options).collect()]
    assert keys(kind="scheduledJob") == ["h1", "worker://j2"] and keys(queue="T") == ["worker://t1"] and keys(job="J1") == ["h1"] and keys(project="p1", take=1) == ["h1"] and keys(project="p9") == []


def test_usages_findings_and_data_access(spark):
    usages = spark.createDataFrame([("k2", "CALLS", "a", "b"), ("k1", "CALLS", "a", "b"), ("k3", "CALLS", "b", "a")], "stableKey string, edgeKind string, source string, target string")
    assert [x.stableKey for x in r.usages_of(usages, "a", "Outgoing").collect()] == ["k1", "k2"] and [x.stableKey for x in r.usages_of(usages, "a").collect()] == ["k3"]
    with pytest.raises(ValueError):
        r.usages_of(usages, "a", "Both")
    findings = spark.createDataFrame([("s", "f", "e1", ["e1", "e2", None, "e2"]), ("s", "g", None, None)], "snapshotStableKey string, stableKey string, primaryEvidenceStableKey string, evidenceStableKeys array<string>")
    assert {(x.evidence, x.key, x.relation) for x in r.finding_uses(findings).collect()} == {("e1", "f", "PrimaryEvidence"), ("e2", "f", "SupportingEvidence")}
    page = spark.createDataFrame([("k2", "EF", "p", "b"), ("k1", "ef", None, "B"), ("k3", "ADO", "p", "a")], "stableKey string, family string, project string, name string")
    assert [x.stableKey for x in r.data_access_after_page(page).collect()] == ["k3", "k1", "k2"] and [x.stableKey for x in r.data_access_after_page(page, " k2 ").collect()] == ["k2"]


def test_empty(spark, graph):
    none = [x.limit(0) for x in graph]
    assert r.endpoint_rows(*none).count() == r.controller_details(*none).count() == r.worker_rows(*none).count() == 0
