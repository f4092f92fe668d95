"""Differences between two snapshots of records by key and fingerprint, over several domains."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAP = "snapshotStableKey"
# The fields that are compared, and the order of domains and changes.
COMPARED = ("displayName", "kind", "evidenceStableKeys", "unknown")
DOMAIN_ORDER = ("Nodes", "Edges", "Findings", "Metrics")
CHANGE_ORDER = ("Added", "Removed", "Changed", "Unchanged")


def comparable(rows: DataFrame, domain: str, display: Column, kind: Column, project: Column, targets: Column, severity: Column, evidence: Column, unknown: Column) -> DataFrame:
    """Records of one domain in the form in which they are compared; arrays are sorted and distinct."""
    plain = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))
    return rows.select(
        SNAP, F.lit(domain).alias("domain"), "stableKey", "fingerprint", display.alias("displayName"), kind.alias("kind"), project.alias("project"), plain(targets).alias("targets"), severity.alias("severity"),
        plain(evidence).alias("evidenceStableKeys"), unknown.alias("unknown"),
    )


def compare(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records of the pairs (current, previous) side by side: (current, previous, domain, stableKey, change, changed_fields, and the fields of the current record, else the previous).

    Equal fingerprints are Unchanged whatever the fields say. The fields named for a change are ``fingerprint`` and those that differ, sorted.
    """
    fields = ["fingerprint", *COMPARED, "project", "targets", "severity"]
    side = lambda which: records.join(pairs.withColumnRenamed(which, SNAP).withColumn(which, F.col(SNAP)), SNAP).drop(SNAP)
    key = ["current", "previous", "domain", "stableKey"]
    now = side("current").select(*key, F.struct(*fields).alias("now"))
    then = side("previous").select(*key, F.struct(*fields).alias("was"))
    both = now.join(then, key, "full")
    same = F.col("now.fingerprint").eqNullSafe(F.col("was.fingerprint"))
    change = F.when(F.col("was").isNull(), "Added").when(F.col("now").isNull(), "Removed").when(same, "Unchanged").otherwise("Changed")
    differing = [F.when(~F.col(f"now.{f}").eqNullSafe(F.col(f"was.{f}")), F.lit("unknownState" if f == "unknown" else f)) for f in COMPARED]
    named = F.when(change == "Changed", F.array_sort(F.array_compact(F.array(F.lit("fingerprint"), *differing)))).otherwise(F.array().cast("array<string>"))
    value = lambda f: F.coalesce(F.col(f"now.{f}"), F.col(f"was.{f}")).alias(f)
    return both.select(*key, change.alias("change"), named.alias("changed_fields"), *[value(f) for f in fields])


def ordinal(column: Column, values: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; others come last, at 99."""
    out = F.lit(99)
    for i in range(len(values) - 1, -1, -1):
        out = F.when(column == values[i], i).otherwise(out)
    return out


def summaries(compared: DataFrame) -> DataFrame:
    """Counts per pair and domain; item filters do not touch them."""
    count = lambda kind: F.count_if(F.col("change") == kind).alias(kind.lower())
    return compared.groupBy("current", "previous", "domain").agg(*[count(k) for k in CHANGE_ORDER])


def items(compared: DataFrame, filters: Mapping[str, str] | None = None, unchanged: bool = False) -> DataFrame:
    """The differences that pass the filters (domain, change, project, kind, severity, target), with their place in controlled order."""
    keep = F.lit(True) if unchanged else F.col("change") != "Unchanged"
    for name, value in (filters or {}).items():
        if name == "target":
            keep = keep & ((F.col("stableKey") == value) | F.array_contains("targets", value))
        else:
            keep = keep & (F.col(name) == value)
    return compared.filter(keep).withColumn("domain_order", ordinal(F.col("domain"), DOMAIN_ORDER)).withColumn("change_order", ordinal(F.col("change"), CHANGE_ORDER))
