"""Writing snapshots: keyed upserts, canonical evidence, validation of references, deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = "snapshotStableKey"


def upsert(stages: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows of several stages, of which the last that has a key wins; within a stage any one row of a key."""
    every = stages[0].withColumn("__stage", F.lit(0))
    for i, more in enumerate(stages[1:], 1):
        every = every.unionByName(more.withColumn("__stage", F.lit(i)))
    rest = [c for c in stages[0].columns if c not in key]
    last = every.groupBy(*key).agg(F.max_by(F.struct(*rest), "__stage").alias("__v"))
    return last.select(*key, *[F.col(f"__v.{c}").alias(c) for c in rest])


def canonical_evidence(evidence: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(scope, stableKey, canonical): evidence with an equal payload in a snapshot is one; its least key stands for it. Nulls equal each other."""
    mark = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in payload]), 256)
    marked = evidence.select(SNAP, "stableKey", mark.alias("__mark"))
    return marked.withColumn("canonical", F.min("stableKey").over(Window.partitionBy(SNAP, "__mark"))).drop("__mark")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, stableKey, missing_end, missing_key): ends of edges that are no node of the snapshot."""
    known = nodes.select(SNAP, F.col("stableKey").alias("end"))
    ends = edges.select(SNAP, "stableKey", F.explode(F.array(F.struct(F.lit("source").alias("which"), F.col("source").alias("end")), F.struct(F.lit("target").alias("which"), F.col("target").alias("end")))).alias("e")).select(SNAP, "stableKey", "e.*")
    return ends.join(known, [SNAP, "end"], "left_anti").select(SNAP, "stableKey", F.col("which").alias("missing_end"), F.col("end").alias("missing_key"))


def endpoint_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, edges, matched): how many edges have both ends; a writer refuses a snapshot where the two differ."""
    bad = dangling_edges(nodes, edges).select(SNAP, "stableKey").distinct().withColumn("bad", F.lit(1))
    joined = edges.select(SNAP, "stableKey").join(bad, [SNAP, "stableKey"], "left")
    return joined.groupBy(SNAP).agg(F.count("*").alias("edges"), F.count_if(F.col("bad").isNull()).alias("matched"))


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(scope, family, records): what a snapshot holds, and so what its deletion takes away."""
    parts = [df.groupBy(SNAP).agg(F.count("*").alias("records")).select(SNAP, F.lit(name).alias("family"), "records") for name, df in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def without(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of the snapshots that are not among ``snapshots`` (stableKey)."""
    return rows.join(snapshots.select(F.col("stableKey").alias(SNAP)).distinct(), SNAP, "left_anti")


#: Records of a snapshot up to which one task writes it.
SNAPSHOT_RECORDS = 1_000_000


def write_snapshots(rows: DataFrame, folder: str, replace: bool = False) -> None:
    """Write rows partitioned by snapshot: appended, or with ``replace`` in place of what the snapshots among them had.

    A snapshot is written by one task; one of more than SNAPSHOT_RECORDS by as many as it needs.
    """
    sizes = rows.groupBy(SNAP).count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= SNAPSHOT_RECORDS:
        spread = rows.repartition(F.col(SNAP))
    else:
        parts = sizes.select(SNAP, F.ceil(F.col("count") / SNAPSHOT_RECORDS).cast("long").alias("__parts"))
        salted = rows.join(parts, SNAP).withColumn("__salt", F.pmod(F.xxhash64("stableKey"), F.col("__parts")))
        spread = salted.repartition(F.col(SNAP), F.col("__salt")).drop("__parts", "__salt")
    writer = spread.write.partitionBy(SNAP)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    else:
        writer.mode("append").parquet(folder)


def invalid_records(rows: DataFrame) -> DataFrame:
    """(scope, stableKey, problem): confidence outside of [0, 1], unknown data without a reason, blank keys."""
    checks: list[tuple[str, Column]] = [
        ("ConfidenceOutOfRange", ~F.col("confidence").between(0, 1)), ("UnknownReasonMissing", F.col("unknownState.hasUnknownData") & F.col("unknownState.unknownReason").isNull()), ("KeyBlank", F.trim("stableKey") == ""),
    ]
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return rows.select(SNAP, "stableKey", F.explode(problems).alias("problem"))
