"""Declarative rules over facts of nodes: a rule's JSON is compiled to one boolean column.

A fact column is an array of texts for each condition kind, and a map of numbers for metrics. Nothing is evaluated row by row in
Python: all rules of a catalog are columns over one scan of the facts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.columns import name_parts, string_or_list, wildcard

SNAP = "snapshotStableKey"
# Condition kinds and the fact columns that they read; operators on texts and on numbers.
FACTS = {
    "target-framework-membership": "frameworks", "namespace": "namespaces", "symbol": "symbols", "package": "packages", "file-pattern": "files", "method-call": "calls", "attribute": "attributes",
}
METRIC = "metric-threshold"
TEXT_OPERATORS = ("Equals", "NotEquals", "In", "NotIn", "Contains", "StartsWith", "EndsWith", "MatchesPattern")
NUMBER_OPERATORS = ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual")
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
MAX_NESTING = 32


class RuleError(ValueError):
    """A rule that cannot be compiled; ``codes`` says why."""

    def __init__(self, *codes: str) -> None:
        super().__init__(", ".join(codes))
        self.codes = list(codes)


@dataclass(frozen=True)
class Rule:
    code: str
    version: str
    category: str
    severity: str
    enabled: bool
    detection: Mapping
    confidence: float = 1.0
    name: str = ""
    tags: Sequence[str] = field(default_factory=tuple)


def read_rule(text: str) -> Rule:
    """A rule of its JSON; all that is wrong with it is told at once."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as problem:
        raise RuleError("JsonInvalid") from problem
    codes = [f"{name}Missing" for name in ("ruleCode", "name", "category", "severity", "version", "detection") if not raw.get(name)]
    if raw.get("severity") and raw["severity"] not in SEVERITIES:
        codes.append("SeverityInvalid")
    if raw.get("version") and not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.\-]+)?", str(raw["version"])):
        codes.append("VersionInvalid")
    if isinstance(raw.get("detection"), Mapping):
        codes += _check_group(raw["detection"], 1)
    if codes:
        raise RuleError(*codes)
    return Rule(raw["ruleCode"], raw["version"], raw["category"], raw["severity"], bool(raw.get("enabled", True)), raw["detection"], float(raw.get("confidence", 1.0)), raw["name"], tuple(raw.get("tags", ())))


def load_rules(folder: str | Path) -> list[Rule]:
    """The rules of a folder's JSON files (not of folders below); the same code and version twice is an error that names the files."""
    rules, places = [], {}
    for path in sorted(Path(folder).glob("*.json")):
        rule = read_rule(path.read_text(encoding="utf-8"))
        places.setdefault((rule.code, rule.version), []).append(path.name)
        rules.append(rule)
    doubled = [f"RuleDuplicate:{code}/{version}:{'+'.join(names)}" for (code, version), names in places.items() if len(names) > 1]
    if doubled:
        raise RuleError(*doubled)
    return rules


def _check_group(group: Mapping, depth: int) -> list[str]:
    if depth > MAX_NESTING:
        return ["NestingTooDeep"]
    codes = [] if group.get("match", "all") in ("all", "any", "none") else ["MatchInvalid"]
    if not group.get("conditions") and not group.get("groups"):
        codes.append("GroupEmpty")
    for condition in group.get("conditions", ()):
        kind, operator = condition.get("kind"), condition.get("operator")
        if kind == METRIC:
            codes += [] if operator in NUMBER_OPERATORS and condition.get("metric") and condition.get("value") is not None else ["ConditionInvalid"]
        elif kind in FACTS:
            codes += [] if operator in TEXT_OPERATORS and (condition.get("value") is not None or condition.get("values")) else ["ConditionInvalid"]
        else:
            codes.append("ConditionKindInvalid")
    for inner in group.get("groups", ()):
        codes += _check_group(inner, depth + 1)
    return codes


def _test(operator: str, expected: Sequence[str]):
    """A text operator as a function of one fact; texts are compared with their case."""
    any_of = lambda f, cs: reduce(lambda a, b: a | b, cs)
    return {
        "Equals": lambda f: f.isin(*expected), "In": lambda f: f.isin(*expected), "NotEquals": lambda f: ~f.isin(*expected), "NotIn": lambda f: ~f.isin(*expected),
        "Contains": lambda f: any_of(f, [F.contains(f, F.lit(e)) for e in expected]), "StartsWith": lambda f: any_of(f, [F.startswith(f, F.lit(e)) for e in expected]),
        "EndsWith": lambda f: any_of(f, [F.endswith(f, F.lit(e)) for e in expected]), "MatchesPattern": lambda f: any_of(f, [wildcard(f, e) for e in expected]),
    }[operator]


def _condition(condition: Mapping) -> tuple[Column, Column]:
    """Whether a condition holds, and the evidence for it. No facts means no match, for the negative operators too."""
    kind, operator = condition["kind"], condition["operator"]
    if kind == METRIC:
        value = F.col("metrics")[condition["metric"]]
        bound = F.lit(str(condition["value"])).cast("decimal(38,6)")
        holds = {"GreaterThan": value > bound, "GreaterThanOrEqual": value >= bound, "LessThan": value < bound, "LessThanOrEqual": value <= bound}[operator]
        shown = F.concat(F.lit(f"metric:{condition['metric']}="), value.cast("string"))
        return F.coalesce(holds, F.lit(False)), F.when(F.coalesce(holds, F.lit(False)), F.array(shown)).otherwise(F.array().cast("array<string>"))
    expected = [str(v) for v in (condition.get("values") or [condition["value"]])]
    matching = F.filter(F.coalesce(F.col(FACTS[kind]), F.array().cast("array<string>")), _test(operator, expected))
    return F.size(matching) > 0, F.transform(matching, lambda f: F.concat(F.lit(f"{kind}:"), f))


def compile_group(group: Mapping, kinds: Column | None = None) -> tuple[Column, Column]:
    """A group as a boolean column and its evidence, which keeps that of conditions that hold even where the group does not."""
    parts = [_condition(c) for c in group.get("conditions", ())] + [compile_group(g) for g in group.get("groups", ())]
    tests, proofs = [p[0] for p in parts], [p[1] for p in parts]
    match = group.get("match", "all")
    holds = reduce(lambda a, b: a & b, tests) if match == "all" else reduce(lambda a, b: a | b, tests)
    if match == "none":
        holds = ~holds
    if group.get("nodeKinds"):
        holds = holds & F.col("nodeKind").isin(*group["nodeKinds"])
    return holds, F.concat(*proofs)


def _kinds(group: Mapping) -> list[str]:
    return [c["kind"] for c in group.get("conditions", ())] + [k for g in group.get("groups", ()) for k in _kinds(g)]


def evaluate(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Matches of enabled rules: (scope, rule_code, rule_version, severity, node, evidence, fact_confidence, rule_confidence, unknown_count).

    A rule with ``nodeKinds`` looks at nodes of these kinds only. One scan serves all rules.
    """
    on = [r for r in rules if r.enabled]
    none = facts.select(SNAP, F.lit("").alias("rule_code"), F.lit("").alias("rule_version"), F.lit("").alias("severity"), F.col("stableKey").alias("node"), F.array().cast("array<string>").alias("evidence"), F.col("confidence").alias("fact_confidence"), F.lit(1).cast("decimal(3,2)").alias("rule_confidence"), F.lit(0).alias("unknown_count")).limit(0)
    if not on:
        return none
    hits = []
    for rule in on:
        holds, proof = compile_group(rule.detection)
        hits.append(F.when(holds, F.struct(F.lit(rule.code).alias("rule_code"), F.lit(rule.version).alias("rule_version"), F.lit(rule.severity).alias("severity"), F.lit(rule.confidence).cast("decimal(3,2)").alias("rule_confidence"), F.array_sort(F.array_distinct(proof)).alias("evidence"))))
    matched = facts.select(SNAP, "stableKey", "confidence", F.coalesce(F.size("unknown_reasons"), F.lit(0)).alias("unknown_count"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return matched.select(SNAP, "hit.rule_code", "hit.rule_version", "hit.severity", F.col("stableKey").alias("node"), "hit.evidence", F.col("confidence").alias("fact_confidence"), "hit.rule_confidence", "unknown_count")


def warnings(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(scope, rule_code, node, kind): conditions of a rule whose facts a candidate node lacks."""
    parts = []
    for rule in (r for r in rules if r.enabled):
        candidate = F.col("nodeKind").isin(*rule.detection["nodeKinds"]) if rule.detection.get("nodeKinds") else F.lit(True)
        for kind in sorted(set(_kinds(rule.detection))):
            facts_column = F.col("metrics") if kind == METRIC else F.col(FACTS[kind])
            parts.append(F.when(candidate & (F.coalesce(F.size(facts_column), F.lit(0)) <= 0), F.struct(F.lit(rule.code).alias("rule_code"), F.lit(kind).alias("kind"))))
    spread = facts.select(SNAP, F.col("stableKey").alias("node"), F.explode(F.array_compact(F.array(*parts))).alias("w"))
    return spread.select(SNAP, "w.rule_code", "node", "w.kind")


def node_facts(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, metrics: DataFrame) -> DataFrame:
    """The facts of every node that rules may ask for. Of several metrics of one name the greatest value counts."""
    key = [SNAP, "stableKey"]
    packages = edges.filter(F.col("edgeKind") == "USES_PACKAGE").join(nodes.filter(F.col("nodeKind") == "Package").select(SNAP, F.col("stableKey").alias("target"), "displayName"), [SNAP, "target"])
    packages = packages.groupBy(SNAP, F.col("source").alias("stableKey")).agg(F.array_sort(F.collect_set("displayName")).alias("packages"))
    paths = evidence.select(SNAP, F.col("stableKey").alias("primaryEvidenceStableKey"), "filePath")
    numbers = metrics.groupBy(SNAP, F.col("node").alias("stableKey"), "metricKind").agg(F.max("numericValue").alias("v")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("metricKind", F.col("v").cast("decimal(38,6)")))).alias("metrics"))
    base = nodes.join(paths, [SNAP, "primaryEvidenceStableKey"], "left").join(packages, key, "left").join(numbers, key, "left")
    listed = lambda *names: F.array_distinct(F.concat(*[string_or_list("metadata", n) for n in names]))
    some = lambda *cs: F.array_distinct(F.array_compact(F.array(*cs)))
    parts = name_parts("qualifiedName")
    space = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "."))
    return base.select(
        *key, "nodeKind", "confidence", listed("project.targetFramework", "project.targetFrameworks", "project.legacyTargetFramework").alias("frameworks"),
        F.array_distinct(F.concat(listed("semantic.namespaces", "semantic.namespace"), some(space))).alias("namespaces"), F.array_distinct(F.concat(listed("semantic.symbols"), some(F.col("qualifiedName"), F.col("displayName")))).alias("symbols"),
        "packages", F.array_distinct(F.concat(listed("project.path"), some(F.col("filePath")))).alias("files"), listed("semantic.methodCalls").alias("calls"), listed("semantic.attributes").alias("attributes"), "metrics",
        some(F.when(F.col("unknownState.hasUnknownData"), F.col("unknownState.unknownReason"))).alias("unknown_reasons"),
    )


def latest_versions(rules: DataFrame) -> DataFrame:
    """The version of each rule that is greatest as text, which is not the order of version numbers."""
    return rules.withColumn("__n", F.row_number().over(Window.partitionBy("ruleCode").orderBy(F.col("version").desc()))).filter("__n = 1").drop("__n")


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.code, r.version, r.name, r.category, r.severity, r.enabled) for r in rules], "ruleCode string, version string, name string, category string, severity string, enabled boolean")
