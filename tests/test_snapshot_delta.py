import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.operators.snapshot_delta import Tables, consecutive, differing, expected, snapshot_delta

ROWS = "snap string, k1 string, k2 string, fp string, kh int"


def delta(spark, rows, pairs, **options):
    df = spark.createDataFrame(rows, ROWS)
    pr = spark.createDataFrame(pairs, "later string, earlier string, line string")
    out = snapshot_delta(df, pr, "snap", ["k1", "k2"], F.lower("fp"), **options).collect()
    got = {(r.later, r.k1, r.k2): r.change for r in out}
    assert len(got) == len(out)
    return got


def brute(rows, pairs):
    tables = {}
    for s, a, b, fp, _ in rows:
        low = None if fp is None else fp.lower()
        t = tables.setdefault(s, {})
        t[a, b] = max([x for x in (t.get((a, b)), low) if x is not None], default=None)
    out = {}
    for later, earlier, _ in pairs:
        now, was = tables.get(later, {}), tables.get(earlier, {})
        for k in now.keys() | was.keys():
            change = "added" if k not in was else "removed" if k not in now else "changed" if now[k] != was[k] else None
            if change:
                out[(later, *k)] = change
    return out


def sample(seed, n):
    rng = random.Random(seed)
    base = {(f"c{rng.randrange(3)}", f"t{i}"): f"F{rng.randrange(5)}" for i in range(n)}
    rows = []
    for s in range(4):
        rows += [(f"s{s}", a, b, fp if rng.random() < 0.5 else fp.lower(), 0) for (a, b), fp in base.items()]
        for k in rng.sample(sorted(base), n // 5):
            base[k] = f"G{rng.randrange(99)}"
        for k in rng.sample(sorted(base), n // 10):
            del base[k]
        base |= {("new", f"n{s}-{i}"): "x" for i in range(n // 8)}
    rows += [("s9", "c", f"t{i}", "x", 0) for i in range(9)]
    return rows, [("s1", "s0", "r"), ("s2", "s1", "r"), ("s3", "s2", "r"), ("s9", "none", "q")]


@pytest.mark.parametrize("options", [{}, {"bucket_records": 40}, {"bucket_records": 7}])
def test_against_brute_force(spark, options):
    rows, pairs = sample(5, 120)
    assert delta(spark, rows, pairs, **options) == brute(rows, pairs)


def elements(seed, n, change):
    """Elements of three pairs in two buckets, and the change of each key."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for pid in range(3):
        for i in range(n):
            k1, k2, d = (int(x) for x in rng.integers(-(2**63), 2**63 - 1, 3))
            kind = rng.choice(["same", "added", "removed", "changed"], p=[1 - change, change / 3, change / 3, change / 3])
            rows += [(pid, i % 2, 1, k1, k2, d)] * (kind != "removed") + [(pid, i % 2, -1, k1, k2, d + (kind == "changed"))] * (kind != "added")
            if kind != "same":
                truth[pid, k1, k2] = str(kind)
    return pd.DataFrame(rows, columns=["pid", "bucket", "sign", "k1", "k2", "d"]), truth


@pytest.mark.parametrize(("change", "options"), [(0.0, {}), (0.02, {}), (0.5, {}), (1.0, {}), (0.3, {"per_pair": 0.0, "spare": 3}), (0.3, {"per_pair": 0.0, "spare": 3, "rounds": 0})])
def test_failed_tables_are_enlarged_and_at_last_compared(change, options):
    rows, truth = elements(3, 200, change)
    got = differing(rows, **options)
    assert {(r.pid, r.k1, r.k2): r.change for r in got.itertuples()} == truth and len(got) == len(truth)


def test_tables_are_sized_by_the_change():
    rows, truth = elements(7, 3000, 0.02)
    sign = rows["sign"].to_numpy()
    words = [rows[c].to_numpy().view(np.uint64) for c in ("k1", "k2", "d")]
    from gneiss.operators.snapshot_delta import _mixed

    guess = expected(rows["pid"].to_numpy(), sign, _mixed(*words), 3)
    assert (guess < 600).all() and len(rows) > 17_000  # some hundred cells for thousands of rows
    small = Tables(np.array([3]))
    small.add(np.zeros(50, dtype=int), np.ones(50, dtype=int), [w[:50] for w in words])
    assert small.peel()[1].tolist() == [0]


def test_versions(spark):
    df = spark.createDataFrame([("b", "r", 1, "k", "x"), ("b", "r", 2, "k", "y"), ("b", "r", None, "k", "z"), ("a", "r", 5, "k", "Y"), ("b", None, 1, "n", "x"), ("b", None, 3, "m", "x"), ("c", "r", 1, "k", "q")], "snap string, rec string, at int, key string, fp string").withColumn("at", F.expr("timestampadd(DAY, at, timestamp_ntz'2024-01-01')"))
    pairs = spark.createDataFrame([("b", "a", "l")], "later string, earlier string, line string")
    got = snapshot_delta(df, pairs, "snap", ["key"], F.lower("fp"), "rec", "at").collect()
    assert [(r.later, r.earlier, r.change, r.key) for r in got] == [("b", "a", "added", "m")]


def test_nulls_repeats_and_empty(spark):
    rows = [("b", None, "x", "1", 0), ("a", None, "x", "1", 0), ("a", "k", None, None, 0), ("b", "k", None, "2", 0), ("b", "d", "d", "1", 0), ("b", "d", "d", "2", 0), ("b", "d", "d", "2", 0), (None, "z", "z", "1", 0), ("a", "", "x", "1", 0)]
    pairs = [("b", "a", "l")]
    assert delta(spark, rows, pairs) == brute(rows, pairs) == {("b", "k", None): "changed", ("b", "d", "d"): "added", ("b", "", "x"): "removed"}
    assert delta(spark, [], pairs) == {}
    assert delta(spark, rows, []) == {}


def test_consecutive(spark):
    df = spark.createDataFrame([("a", "r", 1), ("b", "r", 2), ("b", "r", 2), ("c", "q", 1), ("d", "r", 2)], "k string, r string, t int")
    assert {(x.later, x.earlier) for x in consecutive(df, "k", "r", [F.col("t"), F.col("k")]).collect()} == {("b", "a"), ("d", "b")}
