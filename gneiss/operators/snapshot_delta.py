"""What changed between full snapshots.

Records are (key, digest) pairs of hashes, 24 bytes each. One exchange brings a hash bucket of all snapshots of a line together; there
each pair of neighbouring snapshots gets an invertible Bloom lookup table of the bucket, from which equal pairs cancel out (counts
subtract, hashes combine by exclusive or) and only those that differ are peeled off. The tables are as large as the change, not as the
snapshots: sums of random signs, which cancel out in the same way, tell beforehand how many pairs differ. A table that does not peel is
built again with more cells. Keys are spelt out at the end, for recovered pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.work import staged

#: Records of a line, over all of its snapshots, that share a bucket, about.
BUCKET_RECORDS = 16_384
#: Cells of a table: so many for each pair expected to differ, and so many more. A failed table gets GROWTH times as many, at most ROUNDS times.
PER_PAIR, SPARE, GROWTH, ROUNDS = 2.0, 9, 4, 4
HASHES, SIGNS = 3, 8
#: Rows that are solved together, whole buckets at a time.
SOLVED_ROWS = 100_000

_U = np.uint64


def _mixed(*words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of columns of 64-bit words."""
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15, dtype=_U)
    for word in words:
        h = (h ^ word.astype(_U)) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(32)
    return h


def consecutive(snapshots: DataFrame, key: str, within: str, order: Sequence[Column]) -> DataFrame:
    """Pairs (later, earlier) of neighbours of each sequence; a repeated ``key`` counts once, the first of a sequence has no pair."""
    once = snapshots.dropDuplicates([key])
    line = Window.partitionBy(within).orderBy(*order)
    return once.select(F.col(key).alias("later"), F.lag(key).over(line).alias("earlier"), F.col(within).alias("line")).filter(F.col("earlier").isNotNull())


def expected(table: np.ndarray, sign: np.ndarray, element: np.ndarray, tables: int) -> np.ndarray:
    """How many elements of each table differ, about: the mean square of sums of random signs, in which equal elements cancel out."""
    squares = np.zeros(tables)
    for j in range(SIGNS):
        turned = np.where((element >> _U(j)) & _U(1) == 0, sign, -sign)
        squares += np.bincount(table, weights=turned, minlength=tables) ** 2
    return squares / SIGNS


class Tables:
    """Invertible Bloom lookup tables side by side, each with a number of cells of its own."""

    def __init__(self, cells: np.ndarray) -> None:
        self.part = np.maximum(1, -(-cells.astype(np.int64) // HASHES))
        self.start = np.concatenate([[0], np.cumsum(self.part * HASHES)])
        size = int(self.start[-1])
        self.owner = np.repeat(np.arange(len(cells)), self.part * HASHES)
        self.n = np.zeros(size, dtype=np.int64)
        self.words = [np.zeros(size, dtype=_U) for _ in range(4)]  # both halves of the key's hash, the digest's, and that of all three

    def add(self, table: np.ndarray, sign: np.ndarray, words: Sequence[np.ndarray]) -> None:
        element = _mixed(*words)
        for j in range(HASHES):
            place = self.start[table] + j * self.part[table] + (_mixed(element, np.full(len(element), j, dtype=_U)) % self.part[table].astype(_U)).astype(np.int64)
            np.add.at(self.n, place, sign)
            for column, word in zip(self.words, (*words, element)):
                np.bitwise_xor.at(column, place, word)

    def peel(self) -> tuple[pd.DataFrame, np.ndarray]:
        """The elements (table, k1, k2, d, sign) that differ, and the tables that did not come out empty."""
        found = [pd.DataFrame({"table": np.zeros(0, dtype=np.int64), **{c: np.zeros(0, dtype=_U) for c in ("k1", "k2", "d")}, "sign": np.zeros(0, dtype=np.int64)})]
        while True:
            at = np.flatnonzero(np.abs(self.n) == 1)
            at = at[self.words[3][at] == _mixed(*(w[at] for w in self.words[:3]))]
            if not len(at):
                break
            pure = pd.DataFrame({"table": self.owner[at], **{c: w[at] for c, w in zip(("k1", "k2", "d"), self.words)}, "sign": self.n[at]}).drop_duplicates(["table", "k1", "k2", "d"])
            found.append(pure)
            self.add(pure["table"].to_numpy(), -pure["sign"].to_numpy(), [pure[c].to_numpy() for c in ("k1", "k2", "d")])
        failed = np.unique(self.owner[(self.n != 0) | np.logical_or.reduce([w != 0 for w in self.words])])
        out = pd.concat(found, ignore_index=True)
        return out[~out["table"].isin(failed)], failed


def differing(rows: pd.DataFrame, rounds: int = ROUNDS, per_pair: float = PER_PAIR, spare: int = SPARE) -> pd.DataFrame:
    """Of the elements (pid, bucket, sign, k1, k2, d) those without a partner of the other sign: (pid, k1, k2, change)."""
    table, names = pd.factorize(pd.MultiIndex.from_arrays([rows["pid"], rows["bucket"]]))
    words = [rows[c].to_numpy().astype(np.int64).view(_U) for c in ("k1", "k2", "d")]
    sign = rows["sign"].to_numpy().astype(np.int64)
    cells = per_pair * expected(table, sign, _mixed(*words), len(names)) + spare
    found, todo = [], np.arange(len(names))
    for _ in range(rounds + 1):
        number = np.full(len(names), -1)
        number[todo] = np.arange(len(todo))
        mine = number[table] >= 0
        tables = Tables(cells[todo])
        tables.add(number[table[mine]], sign[mine], [w[mine] for w in words])
        out, failed = tables.peel()
        found.append(out.assign(table=todo[out["table"].to_numpy()]))
        todo = todo[failed]
        cells = cells * GROWTH
        if not len(todo):
            break
    if len(todo):  # tables that still do not peel are compared element by element
        left = np.isin(table, todo)
        pairs = pd.DataFrame({"table": table[left], "k1": words[0][left], "k2": words[1][left], "d": words[2][left], "sign": sign[left]})
        pairs = pairs.groupby(["table", "k1", "k2", "d"], as_index=False, sort=False)["sign"].sum()
        found.append(pairs[pairs["sign"] != 0])
    both = pd.concat(found, ignore_index=True)
    keys = both.groupby(["table", "k1", "k2"], as_index=False, sort=False)["sign"].agg(["min", "max"]).reset_index()
    change = np.where(keys["min"] > 0, "added", np.where(keys["max"] < 0, "removed", "changed"))
    pid = np.array([n[0] for n in names], dtype=np.int64)[keys["table"].to_numpy().astype(np.int64)] if len(keys) else np.zeros(0, dtype=np.int64)
    half = lambda c: keys[c].to_numpy().astype(_U).view(np.int64)
    return pd.DataFrame({"pid": pid, "k1": half("k1"), "k2": half("k2"), "change": change})


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows are sorted by (line, bucket); a bucket may go on in the next batch."""
    held: list[pd.DataFrame] = []
    size = 0

    def solved(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sides = [frame.loc[frame[side] >= 0, [side, "line", "bucket", "k1", "k2", "d"]].rename(columns={side: "pid"}).assign(sign=sign) for side, sign in (("plus", 1), ("minus", -1))]
        both = pd.concat(sides, ignore_index=True)
        if len(both):
            yield differing(both)

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < SOLVED_ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame["line"] == frame["line"].iloc[-1]) & (frame["bucket"] == frame["bucket"].iloc[-1])
        if not last.all():
            yield from solved(frame[~last])
        held, size = [frame[last]], int(last.sum())
    if size:
        yield from solved(pd.concat(held, ignore_index=True))


def snapshot_delta(records: DataFrame, pairs: DataFrame, snapshot: str, key: Sequence[str], digest: Column, record: str | None = None, order: str | None = None, bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """Records added, removed or changed between the snapshots of each pair: (later, earlier, change, *key).

    ``pairs`` has (later, earlier, line), where a snapshot belongs to one line and is the later one of one pair and the earlier one of
    one pair at most; a snapshot of ``pairs`` without records counts as empty. ``change`` is ``added``, ``removed`` or ``changed`` (the
    digests differ; a null digest equals only a null one). With ``record`` and ``order``, rows of a snapshot with one ``record`` are
    versions, of which that with the greatest ``order`` counts (a null order least, rows that tie are taken to be identical). Rows of
    a snapshot that then repeat a key count once, with the digest whose hash is greatest. Null key fields equal each other, and null
    records too. Rows with a null snapshot, and other columns, are ignored. Keys are compared by hashes of 128 bits, digests by 64.
    """
    pairs = staged(pairs.withColumn("pid", F.monotonically_increasing_id()), "delta-pairs")
    plus, minus = pairs.select(F.col("later").alias("snapshot"), F.xxhash64("line").alias("line"), F.col("pid").alias("plus")), pairs.select(F.col("earlier").alias("snapshot"), F.xxhash64("line").alias("l"), F.col("pid").alias("minus"))
    sides = plus.join(minus, "snapshot", "full").select("snapshot", F.coalesce("line", "l").alias("line"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("plus", "minus")])
    sides = staged(sides.withColumn("sid", F.monotonically_increasing_id()), "delta-snapshots")
    rows = records.filter(F.col(snapshot).isNotNull())
    k = _hashes(key)
    d = F.xxhash64(F.coalesce(digest.cast("string"), F.lit("")), digest.isNull())
    if record is None:
        small = rows.select(F.col(snapshot).alias("snapshot"), *k, d.alias("d")).join(sides, "snapshot").drop("snapshot")
    else:
        # settled over columns of fixed width, which hash aggregation holds, and only for snapshots of a pair
        r = [F.xxhash64(record).alias("r1"), F.xxhash64(F.lit(5), record).alias("r2")]
        small = rows.select(F.col(snapshot).alias("snapshot"), *k, d.alias("d"), *r, F.coalesce(F.col(order), F.lit("0001-01-01").cast(rows.schema[order].dataType)).alias("o")).join(sides, "snapshot").drop("snapshot")
        small = small.groupBy("line", "sid", "plus", "minus", "r1", "r2").agg(*[F.max_by(c, "o").alias(c) for c in ("k1", "k2", "d")])
    small = staged(small.select("line", "sid", "plus", "minus", "k1", "k2", "d"), "delta-records")
    # lines of more than one bucket: at most one for each ``bucket_records`` rows
    large = small.groupBy("line").count().filter(F.col("count") > bucket_records).select("line", F.ceil(F.col("count") / bucket_records).cast("int").alias("buckets"))
    placed = small.join(large, "line", "left").withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.coalesce("buckets", F.lit(1))).cast("int"))
    together = placed.drop("buckets").repartition("line", "bucket")
    # what repeats a key lies in the same partition already
    together = together.groupBy("line", "bucket", "sid", "plus", "minus", "k1", "k2").agg(F.max("d").alias("d")).drop("sid")
    found = together.sortWithinPartitions("line", "bucket").mapInPandas(_solve, "pid bigint, k1 bigint, k2 bigint, change string")
    found = staged(found, "delta-found")
    spelt = rows.select(*key).distinct().select(*_hashes(key), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(key)])
    named = found.join(pairs, "pid").join(spelt, ["k1", "k2"])
    return named.select("later", "earlier", "change", *[F.col(f"k_{i}").alias(c) for i, c in enumerate(key)])


def _hashes(key: Sequence[str]) -> list[Column]:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key] + [F.col(c).isNull() for c in key]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(11), *parts).alias("k2")]
