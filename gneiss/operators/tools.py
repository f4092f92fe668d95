"""What the tools lay on top of a query: pages with totals, limits, facets, confidence levels, re-sorting of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = "snapshotStableKey"
LEVELS = (("High", 0.8), ("Medium", 0.5))


@dataclass(frozen=True)
class Page:
    """A page of rows, the number of all rows, and whether rows before or after it are left out."""

    rows: DataFrame
    total: int
    truncated: bool


def page(rows: DataFrame, order: list[Column], skip: int = 0, take: int = 50, most: int = 200) -> Page:
    """Rows in an explicit order; a size beyond ``most`` is an error, not a smaller page."""
    if not 1 <= take <= most or skip < 0:
        raise ValueError("TakeInvalid")
    total = rows.count()
    return Page(rows.orderBy(*order).offset(skip).limit(take), total, skip > 0 or total > skip + take)


def with_total(rows: DataFrame, groups: list[str], order: list[Column], take: int) -> DataFrame:
    """The first ``take`` rows of each group, each with the group's ``total``; totals are counted before, on the map side."""
    totals = rows.groupBy(*groups).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    first = rows.withColumn("position", place).filter(F.col("position") <= take)
    return first.join(totals, groups)


def facets(rows: DataFrame, groups: list[str], kind: str, order: Column, take: int) -> DataFrame:
    """(*groups, kind, shown, total): how many rows of each kind are among the first ``take`` in order, and how many there are."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order, "key"))
    marked = rows.select(*groups, kind, place.alias("place"))
    return marked.groupBy(*groups, kind).agg(F.count_if(F.col("place") <= take).alias("shown"), F.count("*").alias("total"))


def confidence_level(value: Column, unknowns: Column) -> Column:
    """High from 0.8, Medium from 0.5, Low above 0, else Unknown; with unknowns below 0.85 at most Medium."""
    plain = F.when(value >= 0.8, "High").when(value >= 0.5, "Medium").when(value > 0, "Low").otherwise("Unknown")
    return F.when(unknowns & (value < 0.85) & (plain == "High"), "Medium").otherwise(plain)


def confidences(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(*groups, least, mean, most, level): three ways in which tools sum up confidence."""
    per = rows.groupBy(*groups).agg(F.min("confidence").alias("least"), F.avg("confidence").alias("mean"), F.max("confidence").alias("most"), F.bool_or("unknown").alias("unknowns"))
    return per.select(*groups, "least", "mean", "most", confidence_level(F.col("mean"), F.col("unknowns")).alias("level"))


def rule_context(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(finding, rule_key, title): the rule of each finding, code and version with case ignored; its name, else the code."""
    named = rules.groupBy(F.lower("ruleCode").alias("c"), F.lower("version").alias("v")).agg(F.min("name").alias("name"))
    keyed = findings.select("stableKey", "ruleCode", "ruleVersion", F.lower("ruleCode").alias("c"), F.lower("ruleVersion").alias("v"))
    return keyed.join(named, ["c", "v"], "left").select(F.col("stableKey").alias("finding"), F.concat(F.lit("rule://"), "ruleCode", F.lit("/"), "ruleVersion").alias("rule_key"), F.coalesce("name", "ruleCode").alias("title"))


def metric_list(metrics: DataFrame, kind: str | None = None, project: str | None = None) -> DataFrame:
    """Metrics by kind, node and value; the project filter compares the metric's own node."""
    kept = metrics
    if kind:
        kept = kept.filter(F.col("metricKind") == kind)
    if project:
        kept = kept.filter(F.col("node") == project)
    return kept.orderBy(SNAP, "metricKind", F.coalesce("node", F.lit("")), F.col("numericValue").desc())


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Repeated notes once: the first of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def missing_scope(repositories: set[str], snapshots: dict[str, str], repository: str | None, snapshot: str | None) -> str | None:
    """The first thing that a request names and that is not there: RepositoryNotFound, then SnapshotNotFound; None if all is. ``snapshots`` maps keys to repositories."""
    if repository is not None and repository not in repositories:
        return "RepositoryNotFound"
    if snapshot is not None and snapshot.strip().lower() in ("latest", "current"):
        there = [k for k, r in snapshots.items() if repository in (None, r)]
        return None if there else "SnapshotNotFound"
    if snapshot is not None and (snapshot not in snapshots or repository not in (None, snapshots[snapshot])):
        return "SnapshotNotFound"
    return None
