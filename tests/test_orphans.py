import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gneiss.operators import orphans as o
from gneiss.work import read_parts
from gneiss.streaming.orphans import LedgerSink, parent_events, reference_events

PARENT = "snap string, k string, at timestamp_ntz, gone timestamp_ntz, scope string"
REF = "snap string, k string, at timestamp_ntz, one string, many array<string>, field string"
T0 = datetime(2024, 1, 1)


def frames(spark, parents, refs):
    p = o.parents_of(spark.createDataFrame(parents, PARENT), "p", "snap", "k", "at", "gone")
    r = o.references_of(spark.createDataFrame(refs, REF), "r", "snap", "k", "at", {"one": ("p", "one"), "many": ("p", "many")})
    return r, p


def pending(ledger):
    rows = [(x.scope, x.record, x.field, x.key) for x in ledger.pending.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(parents, refs):
    latest = {}
    for s, k, at, gone, _ in parents:
        if s is not None and k is not None and ((s, k) not in latest or at > latest[s, k][0]):
            latest[s, k] = (at, gone is None)
    held = {}
    for s, k, at, one, many, _ in refs:
        if s is not None and k is not None and ((s, k) not in held or at > held[s, k][0]):
            held[s, k] = (at, one, many)
    out = set()
    for (s, k), (_, one, many) in held.items():
        for f, v in [("one", one), *(("many", m) for m in many or [])]:
            if v is not None and not latest.get((s, v), (0, False))[1]:
                out.add((s, k, f, v))
    return out


def history(seed, n):
    rng, at = random.Random(seed), iter(range(10**6))
    when = lambda: T0 + timedelta(seconds=next(at))
    parents = [(rng.choice("ab"), f"k{rng.randrange(12)}", when(), None if rng.random() < 0.6 else T0, "x") for _ in range(n)]
    refs = [(rng.choice("ab"), f"r{rng.randrange(15)}", when(), rng.choice([None, *(f"k{i}" for i in range(14))]), rng.choice([None, [], [f"k{rng.randrange(14)}", None, "k1", "k1"]]), "x") for _ in range(n)]
    rng.shuffle(parents)
    rng.shuffle(refs)
    return parents, refs


@pytest.mark.parametrize("batches", [1, 4])
def test_ledger_against_brute_force(spark, batches):
    parents, refs = history(batches, 60)
    ledger, n = o.OrphanLedger(), len(parents) // batches
    for i in range(batches):
        ledger = ledger.apply(*frames(spark, parents[i * n : (i + 1) * n], refs[i * n : (i + 1) * n]))
        assert pending(ledger) == brute(parents[: (i + 1) * n], refs[: (i + 1) * n])


def test_parts_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(o, "PARTS", 2)
    parents, refs = history(11, 50)
    ledger = o.OrphanLedger()
    for i in range(5):
        before = ledger
        ledger = ledger.apply(*frames(spark, parents[i * 10 : i * 10 + 10], refs[i * 10 : i * 10 + 10]))
        assert pending(ledger) == brute(parents[: i * 10 + 10], refs[: i * 10 + 10])
        assert all(len(paths) <= 2 for paths in ledger.parts.values())
    assert o.OrphanLedger.from_json(ledger.to_json()) == ledger and before.seq == 4


def test_a_batch_writes_its_own_rows_only(spark):
    parents, refs = history(5, 200)
    ledger = o.OrphanLedger().apply(*frames(spark, parents, refs))
    after = ledger.apply(*frames(spark, [("new", "k1", T0, None, "")], [("new", "r1", T0, "k1", ["k2"], ""), ("a", "r1", T0 + timedelta(days=9), "k1", None, "")]))
    for name in ("parents", "records", "links", "opened"):
        assert after.parts[name][:-1] == ledger.parts[name]
        assert read_parts(spark, after.parts[name][-1:], o.SCHEMAS[name]).count() <= 3
    assert ("new", "r1", "many", "k2") in pending(after)


def shuffled_scans(plan):
    """Tables of the state that a plan moves through an exchange other than a broadcast, before anything narrows them."""
    out, lines = set(), plan.splitlines()
    for i, line in enumerate(lines):
        if table := re.search(r"FileScan parquet .*gneiss-orphans/(\w+)/", line):
            depth, above = len(re.match(r"[\s:+\-]*", line)[0]), []
            for up in reversed(lines[:i]):
                if (d := len(re.match(r"[\s:+\-]*", up)[0])) < depth:
                    depth, above = d, [*above, up.strip(" :+-*")]
            upto = next((x for x in above if "Join" in x or "Exchange" in x), "")
            if re.match(r"(\(\d+\) )?Exchange", upto):
                out.add(table[1])
    return out


def test_deletions_do_not_shuffle_the_reverse_index(spark, monkeypatch):
    """Whatever the state's size is, which the threshold of 0 stands for."""
    plans, kept = {}, o.Files.kept

    def watched(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(self, df, name)

    monkeypatch.setattr(o.Files, "kept", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        parents, refs = history(5, 100)
        ledger = o.OrphanLedger().apply(*frames(spark, parents, refs))
        late = [("a", f"k{i}", T0 + timedelta(days=9), T0, "") for i in range(12)]
        more = [("a", "r99", T0 + timedelta(days=9), "k1", ["k13"], "")]
        after = ledger.apply(*frames(spark, late, more))
        assert pending(after) == brute(parents + late, refs + more)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "links" in plans["named"] and shuffled_scans(plans["named"]) == set()
    assert "parents" in plans["keys"] and shuffled_scans(plans["keys"]) <= {"unmet"}


@pytest.mark.parametrize("bits", [16, 26])
def test_many_keys_go_by_a_sieve(spark, monkeypatch, bits):
    monkeypatch.setattr(o, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(o, "SIEVE", bits)
    parents, refs = history(12, 60)
    ledger = o.OrphanLedger()
    for i in range(3):
        ledger = ledger.apply(*frames(spark, parents[i * 20 : i * 20 + 20], refs[i * 20 : i * 20 + 20]))
        assert pending(ledger) == brute(parents[: i * 20 + 20], refs[: i * 20 + 20])


def test_a_sieve_loses_nothing_and_lets_little_through(spark):
    rows = spark.range(-20_000, 20_000).select(F.xxhash64("id").alias("h1"), "id").unionByName(spark.createDataFrame([(None, 7), (-1, 8), (-(2**63), 9), (2**63 - 1, 10)], "h1 bigint, id bigint"))
    keys = rows.filter("id % 40 = 0 OR id IN (8, 9, 10)").select("h1").dropna()
    passed, others = (set(x.id for x in part.collect()) for part in o._sifted(rows.withColumn("id", F.concat("id", F.lit(":"), F.coalesce("h1", F.lit(0)))), keys, "h1"))
    wanted = {x.id for x in rows.join(keys, "h1", "left_semi").withColumn("id", F.concat("id", F.lit(":"), "h1")).collect()}
    assert wanted <= passed and len(passed) <= len(wanted) + 20 and len(passed) + len(others) == 40_004


def test_salted_path(spark, monkeypatch):
    monkeypatch.setattr(o, "BROADCAST_KEYS", 0)
    parents, refs = history(9, 50)
    assert pending(o.OrphanLedger().apply(*frames(spark, parents, refs))) == brute(parents, refs)


def test_arrival_deletion_and_correction(spark):
    t = lambda i: T0 + timedelta(days=i)
    one = o.OrphanLedger().apply(*frames(spark, [], [("a", "r", t(1), "x", ["y"], "")]))
    assert pending(one) == {("a", "r", "one", "x"), ("a", "r", "many", "y")}
    two = one.apply(*frames(spark, [("a", "x", t(2), None, ""), ("b", "y", t(2), None, "")], []))
    assert pending(two) == {("a", "r", "many", "y")}
    three = two.apply(*frames(spark, [("a", "x", t(3), t(3), "")], []))
    assert pending(three) == {("a", "r", "one", "x"), ("a", "r", "many", "y")}
    four = three.apply(*frames(spark, [("a", "x", t(2), None, "")], [("a", "r", t(4), "x", None, "")]))
    assert pending(four) == {("a", "r", "one", "x")}
    five = four.apply(*frames(spark, [], []))
    assert pending(five) == pending(four)
    again = five.apply(*frames(spark, [("a", "x", t(3), t(3), "")], [("a", "r", t(4), "x", None, "")]))
    assert pending(again) == pending(five)


def test_empty_nulls_and_counts(spark):
    empty = o.OrphanLedger().apply(*frames(spark, [], []))
    assert pending(empty) == set()
    odd = o.OrphanLedger().apply(*frames(spark, [(None, "x", T0, None, ""), ("a", None, T0, None, "")], [(None, "r", T0, "x", None, ""), ("a", None, T0, "x", None, ""), ("a", "r", T0, "x", ["x", None], ""), ("zz", "r", T0, "q", None, "")]))
    assert pending(odd) == {("a", "r", "one", "x"), ("a", "r", "many", "x"), ("zz", "r", "one", "q")}
    scopes = spark.createDataFrame([("a", T0), ("a", T0)], "k string, started timestamp_ntz")
    counts = {(r.month, r.orphans, r.scopes) for r in o.orphan_counts(odd.pending, scopes, "k", "started").collect()}
    assert counts == {("2024-01", 2, 1), (None, 1, 1)}


def test_stream_of_batches(spark, tmp_path):
    parents, refs = history(4, 40)
    r, p = frames(spark, parents, refs)
    events = reference_events(r).unionByName(parent_events(p), allowMissingColumns=True)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    states = []
    sink = LedgerSink(lambda ledger, n: states.append((n, ledger.pending.count())))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert pending(sink.ledger) == brute(parents, refs)
    assert [n for n, _ in states] == list(range(len(states))) and len(states) >= 2


def test_a_sink_goes_on_where_the_last_one_ended(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(o, "PARTS", 2)
    parents, refs = history(8, 60)
    folder = f"file://{tmp_path}/ledger"
    for i in range(4):
        part = slice(i * 12, i * 12 + 12)
        r, p = frames(spark, parents[part], refs[part])
        sink = LedgerSink(folder=folder)  # a new driver each time
        events = reference_events(r).unionByName(parent_events(p), allowMissingColumns=True)
        sink(events, i)
        sink(events, i)  # delivered again
        again = LedgerSink(folder=folder)
        again(events, i)
        assert again.ledger == sink.ledger and again.last == i
        assert pending(again.ledger) == brute(parents[: i * 12 + 12], refs[: i * 12 + 12])
    named = {p for paths in sink.ledger.parts.values() for p in paths}
    assert {x.name for x in (tmp_path / "ledger").glob("*/part=*")} == {p.rpartition("/")[2] for p in named}
