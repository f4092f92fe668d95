from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gneiss.sources.schemas import KEYS, SCHEMAS
from gneiss.sources.store import SnapshotStore, StoreError

KNOWN = "named_struct('hasUnknownData', false, 'unknownReason', cast(null as string))"


def rows(spark, name, values):
    """Rows of a table with the columns given, the rest null."""
    empty = spark.createDataFrame([], SCHEMAS[name])
    fields = {f.name: f for f in empty.schema}
    df = None
    for v in values:
        one = spark.range(1).select(*[F.lit(v[n]).cast(f.dataType).alias(n) if n in v else (F.expr(KNOWN).alias(n) if n == "unknownState" else F.lit(None).cast(f.dataType).alias(n)) for n, f in fields.items()])
        df = one if df is None else df.unionByName(one)
    return df if df is not None else empty


def test_write_read_replace_delete(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.read("nodes").count() == 0 and set(KEYS) == set(SCHEMAS)
    node = lambda s, k, c="1.0": {"snapshotStableKey": s, "stableKey": k, "nodeKind": "Type", "confidence": Decimal(c)}
    s1, s2 = "snapshot://a/1", "snapshot://a/2"
    nodes = rows(spark, "nodes", [node(s1, "x"), node(s1, "y"), node(s1, "y"), node(s2, "x")])
    edges = rows(spark, "edges", [{"snapshotStableKey": s1, "stableKey": "e", "edgeKind": "CALLS", "sourceNodeStableKey": "x", "targetNodeStableKey": "y", "confidence": Decimal("0.5")}])
    heads = rows(spark, "snapshots", [{"stableKey": k, "repositoryStableKey": "r", "startedUtc": datetime(2024, 1, 1), "status": "Completed"} for k in (s1, s2)])
    assert store.write({"nodes": nodes, "edges": edges, "snapshots": heads}) == {"nodes": 3, "edges": 1, "snapshots": 2}
    assert store.write({"nodes": nodes, "snapshots": heads}) == {"nodes": 3, "snapshots": 2}
    assert store.read("nodes").count() == 3 and store.read("snapshots").count() == 2
    store.write({"nodes": rows(spark, "nodes", [node(s1, "z")])})
    assert {(r.snapshotStableKey, r.stableKey) for r in store.read("nodes").collect()} == {(s1, "z"), (s2, "x")}
    gone = store.delete([s1])
    assert (gone["nodes"], gone["edges"], gone["snapshots"], gone["metrics"]) == (1, 1, 1, 0)
    assert [r.stableKey for r in store.read("snapshots").collect()] == [s2] and store.read("edges").count() == 0 and store.read("nodes").count() == 1
    store.recreate()
    assert store.read("nodes").count() == 0


def test_all_that_is_wrong_is_told(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    nodes = rows(spark, "nodes", [{"snapshotStableKey": "s", "stableKey": "x", "confidence": Decimal("1.5")}])
    edges = rows(spark, "edges", [{"snapshotStableKey": "s", "stableKey": "e", "sourceNodeStableKey": "x", "targetNodeStableKey": "gone"}])
    metrics = rows(spark, "metrics", [{"snapshotStableKey": "s", "stableKey": "m"}])
    evidence = rows(spark, "evidence", [{"snapshotStableKey": "s", "stableKey": "v", "startLine": 5, "endLine": 4}])
    with pytest.raises(StoreError) as e:
        store.write({"nodes": nodes, "edges": edges, "metrics": metrics, "evidence": evidence})
    assert set(e.value.codes) == {"EdgeEndMissing", "MetricWithoutValue", "EvidenceLinesInvalid", "nodes.ConfidenceOutOfRange"}
    assert store.read("nodes").count() == 0
    with pytest.raises(StoreError, match="nodes.nodeKindMissing"):
        store.write({"nodes": nodes.drop("nodeKind")})


def test_large_snapshots_are_spread(spark, tmp_path, monkeypatch):
    from gneiss.operators import ingest

    monkeypatch.setattr(ingest, "SNAPSHOT_RECORDS", 10)
    df = spark.range(45).select(F.lit("s").alias("snapshotStableKey"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("stableKey"))
    ingest.write_snapshots(df, str(tmp_path / "big"))
    assert spark.read.parquet(str(tmp_path / "big")).count() == 45
