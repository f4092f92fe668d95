from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gneiss.functions import columns as c
from gneiss.operators import extract, ingest, selection
from gneiss.operators.metrics import framework_risk, graph_metrics, modernization_scopes
from gneiss.operators.services import catalogue_page
from gneiss.operators.versions import holding


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


V = "v"


def test_text_functions(spark):
    assert each(spark, ["  a\u00a0", "", " \u2003", None], c.blank_to_null("v")) == ["a", None, None, None]
    assert each(spark, ["ABC%", "x", None, ""], c.contains_ci("v", "c%")) == [True, False, False, False]
    assert each(spark, ["a.b.C.M", "C.M", "M", None, "a. .b.c"], c.infer_namespace("v")) == ["a.b", None, None, None, "a"]
    assert each(spark, ["a.b.C.M", "M", None], c.infer_container("v")) == ["C", None, None]
    assert each(spark, ["my Password=1", "x" * 300, "", None], c.preview("v", 240)) == [c.REDACTED_PREVIEW, "x" * 240, None, None]
    assert each(spark, ["https://u:p@h.example:80/x?y", "svc/path?q", "a@b/c", "token-host", None, " "], c.safe_host("v")) == ["h.example", "svc", None, None, None, None]
    assert each(spark, [" .\\a\\\\b/ ", "/root", "C:\\x", "a//b", None], c.relative_path("v")) == ["a/b", None, None, "a/b", None]
    assert each(spark, ["a\\b/c.cs", "c", None], c.file_name("v")) == ["c.cs", "c", None]


def test_wildcards(spark):
    assert each(spark, ["a.b", "axb", "a\nb", "A.b"], c.wildcard(F.col("v"), "a.b")) == [True, False, False, False]
    assert each(spark, ["src/x/y.cs", "src/", "xsrc/"], c.wildcard(F.col("v"), "src/*")) == [True, True, False]
    with pytest.raises(ValueError):
        c.wildcard(F.col("v"), "*" * 257)


def test_metadata_is_read_by_type(spark):
    values = ['{"a.b":"x","n":1,"t":true}', '{"a.b":5}', "no json", None, '{"z":["p"," ","q "]}']
    assert each(spark, values, c.metadata_text("v", "a.b", "n")) == ["x", None, None, None, None]
    assert each(spark, values, c.metadata_int("v", "n"))[0] == 1
    assert each(spark, values, c.metadata_flag("v", "t")) == [True, False, False, False, False]
    assert each(spark, values, c.string_or_list("v", "z"))[4] == ["p", "q"] and each(spark, values, c.string_or_list("v", "a.b"))[0] == ["x"]
    assert each(spark, ['{"ok":"1","Bad":"2","mySecret":"3"}'], c.safe_metadata("v")) == [{"ok": "1"}]


def test_sql_texts(spark):
    tables = c.sql_tables(c.sql_tokens("v"))
    values = ["select * from [a].[b] x join c on 1=1", "INSERT INTO t(a) VALUES (1)", "UPDATE s.t SET a=1", "DELETE FROM t", "MERGE t USING s ON 1=1", "CREATE TABLE x (a int)", "UPDATE", "", None, "EXEC p"]
    assert each(spark, values, tables) == [["a.b", "dbo.c"], ["dbo.t"], ["s.t"], ["dbo.t"], ["dbo.t", "dbo.s"], ["dbo.x"], [], [], [], []]
    assert each(spark, ["Server=x;Password='p w';User Id=sa;", "PASSWORD=abc"], c.redact_sql("v")) == ["Server=x;Credential=[REDACTED];User Id=[REDACTED_USER];", "Credential=[REDACTED]"]


def test_risk_and_round_half_up(spark):
    number, text = framework_risk(F.col("v"))
    assert each(spark, ["net10.0", "net9.0", "net6.0", "v4.8", "netstandard2.0", "", None], F.struct(number.alias("n"), text.alias("t"))) == [(0, "Current"), (1, "Supported"), (2, "OutOfSupportModernDotNet"), (3, "LegacyDotNetFramework"), (2, "UnknownRisk"), (None, "Unknown"), (None, "Unknown")]


EDGE = "snapshotStableKey string, stableKey string, edgeKind string, source string, target string"
NODE = "snapshotStableKey string, stableKey string, nodeKind string, parentNodeStableKey string"


def test_graph_metrics_of_a_small_graph(spark):
    nodes = spark.createDataFrame([("s", k, "Project", None) for k in ("api", "app", "domain", "json")], NODE)
    edges = spark.createDataFrame([("s", "1", "REFERENCES", "api", "app"), ("s", "2", "USES_PACKAGE", "api", "json"), ("s", "3", "REFERENCES", "app", "domain"), ("s", "4", "REFERENCES", "domain", "api"), ("s", "5", "CONTAINS", "api", "domain"), ("s", "6", "CALLS", "json", "json")], EDGE)
    got = {r.stableKey: (r.fan_in, r.fan_out, r.neighbourhood, float(r.centrality)) for r in graph_metrics(nodes, edges).collect()}
    assert got["api"] == (1, 2, 3, 0.5) and got["json"] == (2, 1, 2, 0.5) and got["app"] == (1, 1, 2, 0.333333)
    assert graph_metrics(nodes.limit(0), edges).count() == 0


def test_scopes_without_projects_take_all(spark):
    nodes = spark.createDataFrame([("s", "r", "Repository", None), ("s", "sol", "Solution", "r"), ("s", "a", "Project", "sol"), ("s", "b", "Project", None)], NODE)
    got = {(r.scope_kind, r.scope_key, r.project) for r in modernization_scopes(nodes).collect()}
    assert ("Repository", "r", "a") in got and ("Repository", "r", "b") in got and ("Solution", "sol", "b") not in got and ("Snapshot", None, "b") in got


def test_versions(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([("s", "k", t[0], "old"), ("s", "k", t[2], "new"), ("s", "k", t[1], "mid"), ("s", None, t[0], "null key"), ("s", "n", None, "no time")], "snapshotStableKey string, stableKey string, loadedUtc timestamp_ntz, v string")
    assert {(r.stableKey, r.v) for r in holding(df, ["v"]).collect()} == {("k", "new"), (None, "null key"), ("n", "no time")}
    assert holding(df.limit(0), ["v"]).count() == 0


def test_selection(spark):
    t = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([("r", "a", t(1), t(2), "x"), ("r", "b", t(1), t(2), "x"), ("r", "c", t(1), None, "x"), ("q", "d", t(3), t(3), "x")], "repositoryStableKey string, stableKey string, startedUtc timestamp_ntz, completedUtc timestamp_ntz, status string")
    assert {r.stableKey for r in selection.latest_snapshots(df).collect()} == {"b", "d"}
    assert {(r.current, r.previous) for r in selection.latest_pairs(df).collect()} == {("b", "a")}
    assert {(r.stableKey, r.previous) for r in selection.previous_comparable(df).collect()} == {("a", "b"), ("b", "a"), ("c", None), ("d", None)}
    assert {(r.repositoryStableKey, r.state) for r in selection.current_snapshots(df).collect()} == {("r", "ambiguous"), ("q", "current")}
    assert selection.selector_kind(" Latest ") == "latest" and selection.selector_kind("snapshot://x") == "explicit"
    with pytest.raises(ValueError):
        selection.selector_kind("summary://x")


def test_ingest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 3)], "snapshotStableKey string, stableKey string, v int")
    folder = str(tmp_path / "t")
    ingest.write_snapshots(df, folder)
    ingest.write_snapshots(df.filter("snapshotStableKey = 's1'").withColumn("v", F.col("v") * 10).limit(1), folder, replace=True)
    rows = {(r.snapshotStableKey, r.stableKey, r.v) for r in spark.read.parquet(folder).collect()}
    assert len(rows) == 2 and ("s2", "a", 3) in rows and all(v in (10, 20) for s, _, v in rows if s == "s1")
    merged = ingest.upsert([df, df.withColumn("v", F.col("v") + 100).filter("stableKey = 'a'")], ["snapshotStableKey", "stableKey"])
    assert {(r.snapshotStableKey, r.stableKey, r.v) for r in merged.collect()} == {("s1", "a", 101), ("s1", "b", 2), ("s2", "a", 103)}
    assert ingest.without(df, spark.createDataFrame([("s1",)], "stableKey string")).count() == 1


def test_project_files_and_types(spark):
    new = '<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFrameworks>net8.0;net48</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="B"/><PackageReference Include="A"/><ProjectReference Include="..\\x\\y.csproj"/></ItemGroup></Project>'
    old = '<?xml version="1.0"?>\n<Project ToolsVersion="4.0" xmlns="urn:x"><PropertyGroup><TargetFrameworkVersion>v4.8</TargetFrameworkVersion><OutputType>Exe</OutputType></PropertyGroup></Project>'
    df = spark.createDataFrame([(1, "a/New.csproj", new), (2, "a\\Old.VBPROJ", old), (3, "c.csproj", "broken"), (4, "d.csproj", None), (5, "e.cs", new)], "k int, p string, t string")
    got = {r.k: r for r in extract.project_facts(df, "k", "p", "t").collect()}
    assert set(got) == {1, 2}
    assert (got[1].name, list(got[1].frameworks), got[1].old_style, list(got[1].packages), list(got[1].references)) == ("New", ["net8.0", "net48"], False, ["A", "B"], ["../x/y.csproj"])
    assert (got[2].name, list(got[2].frameworks), got[2].old_style) == ("Old", ["v4.8"], True)
    both = "Microsoft.NET.Sdk.Web Microsoft.NET.Sdk.Worker"
    assert each(spark, [new, old, both, "x", None], extract.application_type(F.col("v"))) == ["Api", "Console", "Contradictory", "Unknown", "Unknown"]


def test_markup_mappings_and_calls(spark):
    razor = '@page "/a/{id}"\n@inject My.Service<X> s\n<Panel />\n<a href="/b">x</a>'
    xaml = '<Window x:Class="A.B"><TextBlock Text="{Binding Path=User.Name}" Click="OnGo"/><Style Value="{StaticResource Red}"/></Window>'
    df = spark.createDataFrame([(1, razor), (2, xaml), (3, None), (4, "")], "k int, t string")
    got = {(r.k, r.fact, r.value) for r in extract.markup_facts(df, "k", "t").collect()}
    assert {(1, "route", "/a/{id}"), (1, "inject", "My.Service<X>"), (1, "component", "Panel"), (1, "link", "/b"), (2, "class", "A.B"), (2, "binding", "User.Name"), (2, "handler", "OnGo"), (2, "resource", "Red")} <= got
    dbml = '<Database><Table Name="dbo.Orders" Member="O"><Type Name="Order"><Column Name="Id" Type="int"/><Column Name="Total" /></Type></Table></Database>'
    maps = spark.createDataFrame([(1, dbml), (2, '<x><TableAdapter BaseClass="c" Name="Clients"/></x>')], "k int, t string")
    assert {(r.k, r.kind, r.table, r.column) for r in extract.mapping_facts(maps, "k", "t").collect()} == {(1, "dbml", "dbo.Orders", "Id"), (1, "dbml", "dbo.Orders", "Total"), (2, "xsd", "Clients", None)}
    code = spark.createDataFrame([(1, 'app.MapGet("/a/{x}", F);\napp.MapPost( "b", G);')], "k int, t string")
    assert {(r.method, r.route) for r in extract.mapped_endpoints(code, "k", "t").collect()} == {("GET", "/a/{x}"), ("POST", "b")}
    side = "{} string, method string, route string, base_url string, config_key string"
    calls = spark.createDataFrame([("1", "get", "/A/{id}?q", None, None), ("2", "GET", "b", "http://X", None), ("3", "GET", "b", None, None), ("4", "GET", "b", "http://no", None), ("5", "GET", "zz", None, None)], side.format("call"))
    ends = spark.createDataFrame([("e1", "GET", "a/{key}", None, None), ("e2", "GET", "/b", "HTTP://x", None), ("e3", "GET", "/b", "http://y", None)], side.format("endpoint"))
    assert {(r.call, r.state, r.endpoint) for r in extract.match_calls(calls, ends).collect()} == {("1", "matched", "e1"), ("2", "matched", "e2"), ("3", "unknown", None), ("4", "unknown", None), ("5", "unknown", None)}


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, "a.json", '{"A":{"B":[1,{"C":null}]},"ApiKey":"x"}'), (2, "b.json", "broken"), (3, "c.json", None), (4, "d.config", '<add key="K" value="1"/><add name="N" />')], "k int, p string, t string")
    got = {(r.k, r.name, r.source, r.secret_like) for r in extract.configuration_keys(df, "k", "p", "t").collect()}
    assert got == {(1, "A:B:0", "json", False), (1, "A:B:1:C", "json", False), (1, "ApiKey", "json", True), (4, "K", "xml", False), (4, "N", "xml", False)}


def test_risk_filter_keeps_its_quirk(spark):
    df = spark.createDataFrame([("a", "A", True, False), ("b", "B", False, False), ("c", "C", True, True)], "stableKey string, name string, has_findings boolean, has_unknown boolean").withColumn("type", F.lit("x"))
    assert [r.stableKey for r in catalogue_page(df, has_risk=False).collect()] == ["a", "b"]
