import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gneiss.operators import tools

ROOT = Path(__file__).resolve().parent.parent


def test_page_and_totals(spark):
    df = spark.createDataFrame([("s", i, i % 2 == 0) for i in range(7)], "snapshotStableKey string, key int, kind boolean")
    p = tools.page(df, [F.col("key").desc()], 2, 3)
    assert ([r.key for r in p.rows.collect()], p.total, p.truncated) == ([4, 3, 2], 7, True)
    assert not tools.page(df, [F.col("key")], 0, 7).truncated and tools.page(df.limit(0), [F.col("key")]).total == 0
    for bad in ({"take": 0}, {"take": 201}, {"skip": -1}):
        with pytest.raises(ValueError):
            tools.page(df, [F.col("key")], **bad)
    assert {(r.kind, r.shown, r.total) for r in tools.facets(df, ["snapshotStableKey"], "kind", F.lit(0), 3).collect()} == {(True, 2, 4), (False, 1, 3)}
    assert [(r.key, r.total) for r in tools.with_total(df, ["snapshotStableKey"], [F.col("key")], 2).orderBy("key").collect()] == [(0, 7), (1, 7)]


def test_levels_and_scopes(spark):
    df = spark.createDataFrame([(0.9, True), (0.82, True), (0.82, False), (0.5, False), (0.1, True), (0.0, False)], "v double, u boolean")
    assert [r.l for r in df.select(tools.confidence_level(F.col("v"), F.col("u")).alias("l")).collect()] == ["High", "Medium", "High", "Medium", "Low", "Unknown"]
    there = ({"r"}, {"snapshot://a": "r"})
    assert tools.missing_scope(*there, "x", "snapshot://a") == "RepositoryNotFound" and tools.missing_scope(*there, "r", "snapshot://b") == "SnapshotNotFound"
    assert tools.missing_scope(*there, "r", "Latest") is None and tools.missing_scope({"r", "q"}, there[1], "q", "latest") == "SnapshotNotFound"


def test_queries_and_sql_agree_in_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_the_core_does_not_know_the_subpackage():
    for path in ROOT.glob("gneiss/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"gneiss\.llm|from \.*llm", path.read_text(encoding="utf-8")), path
    assert os.path.exists(ROOT / "__spark_entry__.py")
