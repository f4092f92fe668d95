"""Findings: made of rule matches, suppressed, listed and followed through history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = "snapshotStableKey"
UNIT, RECORD = "\u001f", "\u001e"
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0}


def derived_confidence(rule: Column, fact: Column, unknowns: Column) -> Column:
    """Rule times fact confidence, less 5 per cent for each unknown, 50 at most; two digits, halves away from zero."""
    penalty = F.least(F.lit("0.5").cast("decimal(3,2)"), (unknowns * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(10,2)"))
    value = (rule * fact).cast("decimal(10,4)") * (F.lit(1).cast("decimal(3,2)") - penalty)
    return F.round(F.least(F.lit(1).cast("decimal(10,6)"), F.greatest(F.lit(0).cast("decimal(10,6)"), value.cast("decimal(10,6)"))), 2).cast("decimal(3,2)")


def findings_of(matches: DataFrame) -> DataFrame:
    """One finding for each match of a rule by :func:`gneiss.operators.rules.evaluate`; a second with the same identity in a snapshot is left out."""
    evidence = F.array_join(F.col("evidence"), RECORD)
    identity = F.sha2(F.concat_ws(UNIT, "rule_version", "node", "node", evidence), 256)
    history = F.concat(F.lit("history://finding/"), F.sha2(F.concat_ws(UNIT, "rule_code", "rule_version", "node", "node", evidence), 256))
    made = matches.select(
        SNAP, F.concat(F.lit("finding://"), F.col(SNAP), F.lit("/"), F.col("rule_code"), F.lit("/"), identity).alias("stableKey"), F.col("rule_code").alias("ruleCode"), F.col("rule_version").alias("ruleVersion"), "severity",
        F.lit("Open").alias("status"), F.col("node").alias("primaryNodeStableKey"), F.array("node").alias("affectedNodeStableKeys"), history.alias("historyKey"), derived_confidence(F.col("rule_confidence"), F.col("fact_confidence"), F.col("unknown_count")).alias("confidence"),
        F.array_join("evidence", ", ").alias("evidence"),
    )
    return made.dropDuplicates([SNAP, "stableKey"])


def suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings with the status Suppressed and the reason, where a suppression (ruleCode, ruleVersion, primaryNodeStableKey, historyKey, reason) meets them in all four keys."""
    keys = ["ruleCode", "ruleVersion", "primaryNodeStableKey", "historyKey"]
    one = suppressions.groupBy(*keys).agg(F.min("reason").alias("suppressionReason"))
    joined = findings.join(one, keys, "left")
    return joined.withColumn("status", F.when(F.col("suppressionReason").isNotNull(), "Suppressed").otherwise(F.col("status")))


def history(findings: DataFrame) -> DataFrame:
    """(historyKey, first_seen, latest_seen, records) over all snapshots."""
    return findings.groupBy("historyKey").agg(F.min(SNAP).alias("first_seen"), F.max(SNAP).alias("latest_seen"), F.count("*").alias("records"))


def hotlist(findings: DataFrame, rules: DataFrame, filters: Mapping[str, object] | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of findings with their rule's category. Severities are ordered as words, descending, then by rule, key and snapshot.

    Page sizes are kept within 1 to 200. The category filter meets the rule of the same code and version.
    """
    page_size, page = min(200, max(1, page_size)), max(1, page)
    joined = findings.join(rules.select("ruleCode", F.col("version").alias("ruleVersion"), "category"), ["ruleCode", "ruleVersion"], "left")
    for name, value in (filters or {}).items():
        joined = joined.filter(F.array_contains("affectedNodeStableKeys", value) if name == "affectedNode" else F.col(name) == value)
    ordered = joined.orderBy(F.col("severity").desc(), "ruleCode", "stableKey", SNAP)
    return ordered.offset((page - 1) * page_size).limit(page_size)


def severity_rank(severity: Column) -> Column:
    """True ranks, Critical highest; others -1."""
    out = F.lit(-1)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.lower(severity) == name.lower(), rank).otherwise(out)
    return out


def resorted(page: DataFrame, by: str = "severity") -> DataFrame:
    """A page in the order of the tools: by true severity, or latest snapshot first, then rule and key. Which findings are on the page does not change."""
    first = severity_rank(F.col("severity")).desc() if by == "severity" else F.coalesce(F.col(SNAP), F.lit("")).desc()
    return page.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(first, "ruleCode", "stableKey")))


def highest_severity(findings: DataFrame) -> DataFrame:
    """(node, findings, highest) of the affected nodes."""
    spread = findings.select("stableKey", "severity", F.explode(F.array_distinct("affectedNodeStableKeys")).alias("node"))
    return spread.groupBy("node").agg(F.count("*").alias("findings"), F.max_by("severity", severity_rank(F.col("severity"))).alias("highest"))
