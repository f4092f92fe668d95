import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gneiss.operators import findings as f
from gneiss.operators import rules as r

FACTS = "snapshotStableKey string, stableKey string, nodeKind string, confidence decimal(3,2), frameworks array<string>, namespaces array<string>, symbols array<string>, packages array<string>, files array<string>, calls array<string>, attributes array<string>, metrics map<string,decimal(38,6)>, unknown_reasons array<string>"


def rule(detection, code="R", **more):
    return r.read_rule(json.dumps({"ruleCode": code, "name": "n", "category": "c", "severity": "High", "version": "1.0.0", "detection": detection} | more))


def facts(spark, rows):
    rows = [x | {"metrics": {k: Decimal(v) for k, v in x["metrics"].items()} if x.get("metrics") else None, "confidence": Decimal(x["confidence"]) if x.get("confidence") else None} for x in rows]
    base = {"snapshotStableKey": "s", "nodeKind": "Type", "confidence": None, "frameworks": None, "namespaces": None, "symbols": None, "packages": None, "files": None, "calls": None, "attributes": None, "metrics": None, "unknown_reasons": []}
    return spark.createDataFrame([tuple((base | x)[c.split()[0]] for c in FACTS.split(", ")) for x in rows], FACTS)


def matched(spark, rows, *rules):
    return {(x.rule_code, x.node) for x in r.evaluate(facts(spark, rows), rules).collect()}


def c(kind, operator, value=None, **more):
    return {"kind": kind, "operator": operator, "value": value} | more


@pytest.mark.parametrize(
    ("operator", "value", "hit"),
    [("Equals", "Abc", True), ("Equals", "abc", False), ("NotEquals", "Abc", False), ("NotEquals", "x", True), ("In", ["x", "Abc"], True), ("NotIn", ["x"], True), ("NotIn", ["Abc"], False), ("Contains", "b", True), ("Contains", "%", False),
     ("StartsWith", "A", True), ("EndsWith", "bc", True), ("MatchesPattern", "A?c", True), ("MatchesPattern", "*c", True), ("MatchesPattern", "b", False), ("MatchesPattern", "A.c", False)],
)
def test_text_operators(spark, operator, value, hit):
    condition = c("symbol", operator, **({"values": value, "value": None} if isinstance(value, list) else {})) if isinstance(value, list) else c("symbol", operator, value)
    got = matched(spark, [{"stableKey": "has", "symbols": ["Abc"]}, {"stableKey": "none"}, {"stableKey": "empty", "symbols": []}], rule({"match": "all", "conditions": [condition]}))
    assert got == ({("R", "has")} if hit else set())


def test_any_fact_may_satisfy_a_negative_operator(spark):
    assert matched(spark, [{"stableKey": "a", "packages": ["x", "y"]}], rule({"conditions": [c("package", "NotEquals", "x")]})) == {("R", "a")}


def test_groups_kinds_metrics_and_evidence(spark):
    detection = {"nodeKinds": ["Type"], "match": "all", "conditions": [c("metric-threshold", "GreaterThan", 2, metric="M")], "groups": [{"match": "none", "conditions": [c("package", "Equals", "p")]}, {"match": "any", "conditions": [c("file-pattern", "MatchesPattern", "src/*"), c("method-call", "Contains", "Go")]}]}
    rows = [
        {"stableKey": "yes", "metrics": {"M": 3}, "files": ["src/a.cs"], "calls": ["Go()"]}, {"stableKey": "package", "metrics": {"M": 3}, "files": ["src/a.cs"], "packages": ["p"]}, {"stableKey": "low", "metrics": {"M": 2}, "files": ["src/a.cs"]},
        {"stableKey": "kind", "nodeKind": "Method", "metrics": {"M": 3}, "files": ["src/a.cs"]}, {"stableKey": "neither", "metrics": {"M": 9}},
    ]
    got = r.evaluate(facts(spark, rows), [rule(detection)]).collect()
    assert [x.node for x in got] == ["yes"]
    assert list(got[0].evidence) == ["file-pattern:src/a.cs", "method-call:Go()", "metric:M=3.000000"]


def test_warnings_switches_and_empty(spark):
    one = rule({"conditions": [c("symbol", "NotEquals", "x")], "nodeKinds": ["Type"]})
    off = rule({"conditions": [c("symbol", "Equals", "x")]}, "OFF", enabled=False)
    df = facts(spark, [{"stableKey": "a"}, {"stableKey": "b", "symbols": ["q"]}, {"stableKey": "m", "nodeKind": "Method"}])
    assert {(x.rule_code, x.node, x.kind) for x in r.warnings(df, [one, off]).collect()} == {("R", "a", "symbol")}
    assert {x.node for x in r.evaluate(df, [one, off]).collect()} == {"b"}
    assert r.evaluate(df, [off]).count() == 0 and r.evaluate(facts(spark, []), [one]).count() == 0


def test_reading_reports_all_that_is_wrong(tmp_path):
    with pytest.raises(r.RuleError) as e:
        r.read_rule(json.dumps({"ruleCode": "a", "severity": "Odd", "version": "1", "detection": {"match": "some", "conditions": [{"kind": "x", "operator": "Equals"}]}}))
    assert set(e.value.codes) == {"nameMissing", "categoryMissing", "SeverityInvalid", "VersionInvalid", "MatchInvalid", "ConditionKindInvalid"}
    deep = {"conditions": [c("symbol", "Equals", "x")]}
    for _ in range(40):
        deep = {"groups": [deep]}
    with pytest.raises(r.RuleError, match="NestingTooDeep"):
        rule(deep)
    text = json.dumps({"ruleCode": "a", "name": "n", "category": "c", "severity": "Low", "version": "1.0.0", "detection": {"conditions": [c("symbol", "Equals", "x")]}})
    (tmp_path / "a.json").write_text(text)
    assert [x.code for x in r.load_rules(tmp_path)] == ["a"]
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(r.RuleError, match="a.json\\+b.json"):
        r.load_rules(tmp_path)


def test_confidence_and_findings(spark):
    df = spark.createDataFrame([("0.90", "0.95", 1), ("1.00", "0.50", 20), ("0.50", "0.25", 0)], "a string, b string, n int").select(f.derived_confidence(F.col("a").cast("decimal(3,2)"), F.col("b").cast("decimal(3,2)"), F.col("n")).alias("c"))
    assert [str(x.c) for x in df.collect()] == ["0.81", "0.25", "0.13"]
    one = rule({"conditions": [c("symbol", "Equals", "x")]})
    rows = facts(spark, [{"stableKey": "a", "symbols": ["x"], "confidence": 1, "unknown_reasons": ["why"]}, {"stableKey": "a", "symbols": ["x"], "confidence": 1, "unknown_reasons": ["why"]}])
    made = f.findings_of(r.evaluate(rows, [one])).collect()
    assert len(made) == 1 and made[0].historyKey.startswith("history://finding/") and str(made[0].confidence) == "0.95"


def test_hotlist_orders_severities_as_words(spark):
    df = spark.createDataFrame([("s", f"k{i}", "R", "1", sev, "Open", ["n"]) for i, sev in enumerate(["Critical", "High", "Medium", "Low", "Info"])], "snapshotStableKey string, stableKey string, ruleCode string, ruleVersion string, severity string, status string, affectedNodeStableKeys array<string>")
    known = spark.createDataFrame([("R", "1", "cat")], "ruleCode string, version string, category string")
    page = f.hotlist(df, known)
    assert [x.severity for x in page.collect()] == ["Medium", "Low", "Info", "High", "Critical"]
    assert [x.severity for x in f.resorted(page).orderBy("position").collect()] == ["Critical", "High", "Medium", "Low", "Info"]
    assert f.hotlist(df, known, page_size=0).count() == 1 and f.hotlist(df, known, {"category": "other"}).count() == 0


def test_latest_version_is_that_of_the_text(spark):
    df = spark.createDataFrame([("R", "9.0.0"), ("R", "10.0.0")], "ruleCode string, version string")
    assert r.latest_versions(df).first().version == "9.0.0"
