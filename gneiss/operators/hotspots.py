"""Hotspots: metrics above a threshold and nodes with many open findings, ranked within their category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAP = "snapshotStableKey"
# Which metric feeds which category, and from which value on.
THRESHOLDS = (
    ("GraphFanIn", "HighFanIn", 5), ("GraphFanIn", "SharedLibrary", 8), ("GraphFanOut", "HighFanOut", 5), ("GraphDependencyDepth", "DependencyDepth", 4), ("GraphTransitiveDependencyCount", "TransitiveDependencyCount", 10),
    ("GraphCycleParticipation", "CycleParticipation", 1), ("ModernizationDataAccessSpread", "DataAccessSpread", 3), ("ModernizationSharedTableUsageCount", "SharedTableUsage", 2),
)
CONCENTRATION, CONCENTRATION_FROM = "HotlistFindingConcentration", 3


def finding_concentration(findings: DataFrame, least: int = CONCENTRATION_FROM) -> DataFrame:
    """Nodes with at least ``least`` open findings: (scope, target, category, score, confidence, unknown_reason)."""
    open_ = findings.filter(F.col("status") == "Open").select(SNAP, "stableKey", "confidence", F.when(F.col("hasUnknownData"), F.col("unknownReason")).alias("reason"), F.explode(F.array_distinct("affectedNodeStableKeys")).alias("target"))
    grouped = open_.groupBy(SNAP, "target").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons")).filter(F.col("n") >= least)
    return grouped.select(SNAP, "target", F.lit(CONCENTRATION).alias("category"), F.col("n").cast("decimal(38,6)").alias("score"), "confidence", F.nullif("reasons", F.lit("")).alias("unknown_reason"))


def metric_hotspots(metrics: DataFrame) -> DataFrame:
    """Metrics (scope, node, metricKind, numericValue, confidence) above the thresholds of the categories that they feed."""
    # eight fixed rows; a metric may feed two categories, so it is unfolded in place and not joined
    feeds = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c).alias("c"), F.lit(t).alias("t")) for m, c, t in THRESHOLDS])
    spread = metrics.withColumn("feed", F.explode(F.filter(feeds, lambda f: (f["m"] == F.col("metricKind")) & (f["t"] <= F.col("numericValue")))))
    return spread.select(SNAP, F.col("node").alias("target"), F.col("feed.c").alias("category"), F.col("numericValue").cast("decimal(38,6)").alias("score"), "confidence", F.lit(None).cast("string").alias("unknown_reason"))


def ranked(hotspots: DataFrame) -> DataFrame:
    """Places within snapshot and category: score descending, then target; no place is shared."""
    return hotspots.withColumn("rank", F.row_number().over(Window.partitionBy(SNAP, "category").orderBy(F.col("score").desc(), "target")))
