"""References to records that do not exist.

An :class:`OrphanLedger` keeps, in files of the shared folder, the parent index (which keys exist), the referring records, a reverse
index from keys to the records that refer to them, and a log of orphans opened and closed. A batch of new rows writes its own rows
only, one part of each table: its references probe the parent index, its arriving parents close the orphans that wait for them, its
deletions open references again that the reverse index names. Rows of scopes that were never seen before need no look at older parts
at all; for the rest, the few late rows and corrections, hashes and times of older parts are read and held against them where they lie.
Every PARTS batches the parts are put together.

Keys are matched as 128-bit hashes, so that a probe moves few bytes however long the keys are; the strings stay with the records.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.work import Files, read_parts, shared_folder

#: Keys (16 bytes each) up to which a set of them is broadcast: some tens of MB in memory. Beyond, a sieve of them is, and the join shuffles what passes it.
BROADCAST_KEYS = 400_000
#: Bits of a sieve as a power of two: 8 MB, however many keys it is made of.
SIEVE = 26
SALTS = 32
#: Batches whose parts lie side by side before they are put together.
PARTS = 16

HASH = ["h1", "h2"]
RECORD = ["r1", "r2"]
_EARLIEST = "0001-01-01"


def pair_hash(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(77), *columns).alias("h2")]


def parents_of(rows: DataFrame, table: str, scope: str, key: str, order: str, deleted: str) -> DataFrame:
    """Versions of parent records for a ledger: (h1, h2, s, at, alive), s being the scope's hash. Rows with a null scope or key are no parents."""
    kept = rows.filter(F.col(scope).isNotNull() & F.col(key).isNotNull())
    return kept.select(*pair_hash(F.lit(table), F.col(scope), F.col(key)), F.xxhash64(scope).alias("s"), F.col(order).cast("timestamp_ntz").alias("at"), F.col(deleted).isNull().alias("alive"))


def references_of(rows: DataFrame, table: str, scope: str, record: str, order: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Versions of referring records: (ref_table, scope, record, at, refs array of (field, table, key)).

    ``fields`` names for each referring column its parent table and ``one`` (a key) or ``many`` (an array of keys). Null keys and
    repeats in an array are left out. Rows with a null scope or record key are left out.
    """
    parts = []
    for name, (parent, kind) in fields.items():
        keys = F.array(F.col(name)) if kind == "one" else F.coalesce(F.col(name), F.array().cast("array<string>"))
        keys = F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))
        parts.append(F.transform(keys, _reference(name, parent)))
    kept = rows.filter(F.col(scope).isNotNull() & F.col(record).isNotNull())
    return kept.select(F.lit(table).alias("ref_table"), F.col(scope).alias("scope"), F.col(record).alias("record"), F.col(order).cast("timestamp_ntz").alias("at"), F.concat(*parts).alias("refs"))


def _reference(name: str, table: str):
    return lambda key: F.struct(F.lit(name).alias("field"), F.lit(table).alias("table"), key.alias("key"))


# Of parents, was says whether the key lived before, and late whether its scope was known; of records, was says that an older version was held.
SCHEMAS = {
    "parents": "h1 bigint, h2 bigint, s bigint, at timestamp_ntz, alive boolean, was boolean, late boolean, seq int",
    "records": "ref_table string, scope string, record string, refs array<struct<field:string,table:string,key:string>>, r1 bigint, r2 bigint, at timestamp_ntz, was boolean, seq int",
    "links": "k int, r1 bigint",
    "scopes": "s bigint",
    "opened": "ref_table string, scope string, record string, field string, key string, h1 bigint, h2 bigint, r1 bigint, r2 bigint, seq int",
}


@dataclass(frozen=True)
class OrphanLedger:
    """State of the references, parents and waiting orphans after ``seq`` batches; :meth:`apply` gives the state after another.

    Of the versions of a record (one key, several ``at``) the latest holds, whatever the order of arrival, and of equally late ones that
    of the later batch; a late row that is older than the one held changes nothing. A null ``at`` is the earliest. Of equally late
    versions of a parent one that lives wins. Empty batches change nothing. The state is a list of files (``parts``) and can be kept
    as text (:meth:`to_json`); files of a state are left alone by later ones until :meth:`apply` puts parts together, which
    removes those of the states before.
    """

    seq: int = 0
    parts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: The folder of the state's files; the session's shared folder unless set.
    folder: str | None = None

    def to_json(self) -> str:
        return json.dumps({"seq": self.seq, "parts": self.parts})

    @classmethod
    def from_json(cls, text: str, folder: str | None = None) -> OrphanLedger:
        kept = json.loads(text)
        return cls(kept["seq"], {k: tuple(v) for k, v in kept["parts"].items()}, folder)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """All parts of a table."""
        return read_parts(spark, self.parts.get(name, ()), SCHEMAS[name])

    @property
    def pending(self) -> DataFrame:
        """The orphans that are open: (ref_table, scope, record, field, key, h1, h2)."""
        return self._open(SparkSession.active()).drop("r1", "r2", "seq")

    def _open(self, spark: SparkSession) -> DataFrame:
        """What was opened and not closed later: by a parent that arrived where the scope was known, or by a newer version of the record."""
        opened = self.table(spark, "opened")
        closings = ((self.table(spark, "parents").filter("late AND alive AND NOT was"), HASH), (self.table(spark, "records").filter("was"), RECORD))
        for closing, on in closings:
            closed = closing.groupBy(*on).agg(F.max("seq").alias("closed"))
            opened = opened.join(closed, on, "left").filter(F.col("closed").isNull() | (F.col("seq") >= F.col("closed"))).drop("closed")
        return opened.select("ref_table", "scope", "record", "field", "key", *HASH, *RECORD, "seq")

    # ---- a batch --------------------------------------------------------------------------------------------------------------
    def apply(self, references: DataFrame, parents: DataFrame) -> OrphanLedger:
        spark = references.sparkSession
        files = Files(spark, self.folder or f"{shared_folder(spark)}/gneiss-orphans", keep=self.folder is not None)
        seq = self.seq + 1
        new: dict[str, str] = {}

        def put(name: str, rows: DataFrame) -> DataFrame:
            new[name] = files.write(rows, name)
            return read_parts(spark, [new[name]], SCHEMAS[name])

        first = not self.parts.get("scopes")
        named = references.select(*_record(), F.xxhash64("scope").alias("s"))
        scopes = put("scopes", parents.select("s").unionByName(named.select("s")).distinct())
        # rows of scopes that are known may meet older ones; those of new scopes cannot
        old = scopes.join(self.table(spark, "scopes"), "s", "left_semi")
        if not first:
            # written first, so that their size is known: few late keys are broadcast, and what is held is not shuffled to meet them
            late_keys = parents.join(old, "s", "left_semi").select(F.lit(0).alias("kind"), *HASH).unionByName(named.join(old, "s", "left_semi").select(F.lit(1).alias("kind"), *[F.col(r).alias(h) for r, h in zip(RECORD, HASH)]))
            late_keys = files.kept(late_keys.distinct(), "late")

        def put_parents() -> DataFrame:
            fresh = latest_parents(parents)
            if first:
                rows = fresh.withColumns({"was": F.lit(False), "late": F.lit(False)})
            else:
                before = latest_parents(_parted(self.table(spark, "parents"), late_keys.filter("kind = 0"), HASH)[0])
                before = before.select(*HASH, F.col("at").alias("at0"), F.col("alive").alias("was"))
                newer = F.col("at0").isNull() | (F.col("at") > F.col("at0")) | ((F.col("at") == F.col("at0")) & (F.col("alive") | ~F.col("was")))
                rows = fresh.join(before, HASH, "left").filter(newer).join(old.withColumn("late", F.lit(True)), "s", "left")
            flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("was", "late")]
            return put("parents", rows.select(*HASH, "s", "at", "alive", *flags, F.lit(seq).alias("seq")))

        def put_records() -> DataFrame:
            # one version is all that most records have: only hashes are shuffled to tell the others, and the texts are written from where they lie
            seen = named.groupBy(*RECORD).agg(F.count("*").alias("n"))
            odd = seen.filter("n > 1").select(*RECORD, F.lit(None).cast("timestamp_ntz").alias("at0"))
            if not first:
                late = late_keys.filter("kind = 1").select(*[F.col(h).alias(r) for h, r in zip(HASH, RECORD)])
                heads = _parted(self.table(spark, "records"), late, RECORD)[0].select(*RECORD, F.col("at").alias("at0"))
                odd = odd.unionByName(heads).groupBy(*RECORD).agg(F.max("at0").alias("at0"))
            odd = files.kept(odd, "odd")
            rows = references.withColumns(dict(zip(RECORD, _record()))).withColumn("at", F.coalesce("at", F.lit(_EARLIEST).cast("timestamp_ntz")))
            several, plain = _parted(rows, odd, RECORD)
            plain = plain.withColumn("was", F.lit(False))
            rest = latest_records(several).join(odd, RECORD).filter(F.col("at0").isNull() | (F.col("at") >= F.col("at0"))).withColumn("was", F.col("at0").isNotNull())
            shown = ["ref_table", "scope", "record", "refs", *RECORD, "at", "was"]
            return put("records", plain.select(*shown).unionByName(rest.select(*shown)).withColumn("seq", F.lit(seq)))

        fresh_parents, fresh = _at_once(put_parents, put_records)
        flat = _spread(fresh)
        hashed = F.array_distinct(F.transform("refs", lambda ref: _short(*pair_hash(ref["table"], F.col("scope"), ref["key"]))))
        links = fresh.select(F.explode(hashed).alias("k"), "r1")
        # only distinct hashes are probed; a key that everything refers to is one row by then
        unmet = flat.groupBy(*HASH).agg(F.max(F.xxhash64("scope")).alias("s")).join(fresh_parents.select(*HASH, "alive"), HASH, "left")
        unmet = unmet.filter("alive IS NULL OR NOT alive").select(*HASH, "s", F.col("alive").isNotNull().alias("dead"))
        _, keys = _at_once(lambda: put("links", links), lambda: files.kept(unmet, "unmet"))
        if not first:
            asked = files.kept(keys.filter("NOT dead").join(old, "s", "left_semi").select(*HASH), "asked")
            alive = latest_parents(_parted(self.table(spark, "parents"), asked, HASH)[0]).filter("alive")
            keys = files.kept(keys.join(alive.select(*HASH), HASH, "left_anti"), "keys")
        opened = _within(flat, keys.select(*HASH))
        if not first:
            gone = files.kept(fresh_parents.filter("was AND NOT alive").select(*HASH), "gone")
            if not gone.isEmpty():
                opened = opened.unionByName(self._referring(spark, files, gone, new["records"], seq))
        put("opened", opened.select("ref_table", "scope", "record", "field", "key", *HASH, *RECORD, F.lit(seq).alias("seq")))
        files.drop_kept()
        gc.collect()  # frames of the batch refer to each other, and hold plans and broadcast tables in the JVM until they go
        after = replace(self, seq=seq, parts={name: (*self.parts.get(name, ()), path) for name, path in new.items()})
        return after._together(spark, files, set(new.values())) if len(after.parts["records"]) > PARTS else after

    def _referring(self, spark: SparkSession, files: Files, gone: DataFrame, own: str, seq: int) -> DataFrame:
        """References to keys that are gone now, of records that hold and are not in the batch (``own``), by the reverse index."""
        named = files.kept(_parted(self.table(spark, "links"), gone.select(_short("h1", "h2").alias("k")), ["k"])[0].select("r1").distinct(), "named")
        rows = _parted(read_parts(spark, [*self.parts["records"], own], SCHEMAS["records"]), named, ["r1"])[0]
        last = rows.groupBy(*RECORD).agg(F.max("seq").alias("seq")).filter(F.col("seq") < seq)
        return _within(_spread(rows.join(last, [*RECORD, "seq"], "left_semi")), gone)

    def _together(self, spark: SparkSession, files: Files, own: set[str]) -> OrphanLedger:
        """The same state in one part of each table; versions that no longer hold, and closed orphans, are left out. ``own`` are the parts that no state before has."""
        records = self.table(spark, "records")
        last = records.groupBy(*RECORD).agg(F.max("seq").alias("seq"))
        whole = {
            "parents": latest_parents(self.table(spark, "parents")).withColumns({"was": F.col("alive"), "late": F.lit(False), "seq": F.lit(self.seq)}),
            "records": records.join(last, [*RECORD, "seq"], "left_semi").withColumn("was", F.lit(False)),
            "links": self.table(spark, "links").distinct(),
            "scopes": self.table(spark, "scopes").distinct(),
            "opened": self._open(spark),
        }
        parts = {name: (files.write(rows, name),) for name, rows in whole.items()}
        files.remove(p for paths in self.parts.values() for p in paths if self.folder is None or p in own)
        return replace(self, parts=parts)


def _at_once(*steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """Steps that do not need each other, as jobs side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(step)) for step in steps]]


def latest_parents(versions: DataFrame) -> DataFrame:
    """Of each parent the latest version, over columns of fixed width, which hash aggregation holds."""
    at = F.coalesce("at", F.lit(_EARLIEST).cast("timestamp_ntz"))
    lives, dead = F.max(F.when(F.col("alive"), at)), F.max(F.when(~F.col("alive"), at))
    return versions.groupBy(*HASH).agg(F.max("s").alias("s"), F.greatest(lives, dead).alias("at"), F.coalesce(lives >= dead, lives.isNotNull()).alias("alive"))


def latest_records(rows: DataFrame) -> DataFrame:
    """Of each record the latest version, with the hashes of the record and of its scope."""
    named = rows.withColumns(dict(zip(RECORD, _record()))).withColumn("at", F.coalesce("at", F.lit(_EARLIEST).cast("timestamp_ntz")))
    last = named.groupBy(*RECORD).agg(F.max_by(F.struct("ref_table", "scope", "record", "at", "refs"), "at").alias("v"))
    return last.select("v.*", *RECORD)


def _record() -> list[Column]:
    return [h.alias(r) for h, r in zip(pair_hash(F.col("ref_table"), F.col("scope"), F.col("record")), RECORD)]


def _short(*hashes: str | Column) -> Column:
    """32 bits of a key's hash; what the reverse index finds by it is held against the whole hash."""
    return F.hash(*hashes)


def _spread(held: DataFrame) -> DataFrame:
    """One row for each reference of each record."""
    flat = held.select("ref_table", "scope", "record", *RECORD, F.explode("refs").alias("ref"))
    return flat.select("ref_table", "scope", "record", *RECORD, F.col("ref.field").alias("field"), F.col("ref.key").alias("key"), *pair_hash(F.col("ref.table"), F.col("scope"), F.col("ref.key")))


def _parted(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have one of the written keys, and the others. Neither is shuffled: few keys are broadcast, of many a sieve is, and only what passes it is moved."""
    keys = keys.select(*on)
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, "left_semi"), rows.join(F.broadcast(keys), on, "left_anti")
    passed, kept = _sifted(rows, keys, on[0])
    return passed.join(keys, on, "left_semi"), kept.unionByName(passed.join(keys, on, "left_anti"))


def _sifted(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the keys, and rows that have none, by a bitmap over the low bits of a hash: rows of 512 words of 64 bits, broadcast."""

    def low(shift: int, width: int) -> Column:
        return F.shiftright(F.col(on).cast("bigint"), shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")

    words = keys.groupBy(low(15, SIEVE - 15).alias("sieve"), low(6, 9).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({on} & 63 AS INT))")).alias("bits"))
    words = words.groupBy("sieve").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    sieve = F.broadcast(words.select("sieve", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.col("words")[i], F.lit(0).cast("bigint"))).alias("words")))
    word = F.get("words", low(6, 9))
    may = (low(15, SIEVE - 15) == F.col("sieve")) & (F.call_function("getbit", word, low(0, 6)) == 1)
    return rows.join(sieve, may, "left_semi"), rows.join(sieve, may, "left_anti")


def _within(references: DataFrame, keys: DataFrame) -> DataFrame:
    if keys.count() <= BROADCAST_KEYS:
        return references.join(F.broadcast(keys), HASH, "left_semi")
    # a missing key may have a third of all references: its rows are spread over salts, and the key is repeated for each
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = _sifted(references, keys, "h1")[0].withColumn("salt", F.pmod(F.xxhash64("record", "field"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*HASH, "salt"], "left_semi").drop("salt")


def orphan_counts(pending: DataFrame, scopes: DataFrame, scope: str, time: str) -> DataFrame:
    """Open orphans per referring table and month of the scope's ``time``: (ref_table, month, orphans, scopes).

    Scopes that ``scopes`` lacks, or whose time is null, count under a null month.
    """
    months = scopes.dropDuplicates([scope]).select(F.col(scope).alias("scope"), F.date_format(time, "yyyy-MM").alias("month"))
    by_scope = pending.groupBy("ref_table", "scope").agg(F.count("*").alias("n"))
    return by_scope.join(months, "scope", "left").groupBy("ref_table", "month").agg(F.sum("n").alias("orphans"), F.count("*").alias("scopes"))
