"""A store of snapshots: one parquet table for each kind of record, those of snapshots partitioned by snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import ingest
from gneiss.work import staged
from gneiss.sources.schemas import KEYS, SCHEMAS

SNAP = "snapshotStableKey"


class StoreError(ValueError):
    """Records that a store refuses; ``codes`` says why, all reasons at once."""

    def __init__(self, *codes: str) -> None:
        super().__init__(", ".join(codes))
        self.codes = list(codes)


@dataclass(frozen=True)
class SnapshotStore:
    """Tables below one folder of a file system that all executors share."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        """A table with its schema; empty if nothing was written yet."""
        path = f"{self.folder}/{name}"
        if not self._there(path):
            path = f"{self.folder}/.{name}-old"  # a replacement that was broken off
        if not self._there(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        frame = self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(frame.schema).parquet(path).select(*frame.columns)

    def write(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Write the records of some snapshots, in place of what these snapshots had; how many of each table were written.

        Of rows with one key any one counts. Refused as a whole, before anything is written: edges whose ends are no nodes of their
        snapshot, metrics without a number or text, confidence out of range, unknown data without a reason.
        """
        # written once, as the checks, the write and the count all read it
        ready = {name: staged(self._shaped(name, df), f"store-{name}") for name, df in tables.items()}
        problems = self._problems(ready)
        if problems:
            raise StoreError(*problems)
        written = {}
        for name, df in ready.items():
            if SNAP in df.columns:
                ingest.write_snapshots(df, f"{self.folder}/{name}", replace=True)
            else:
                merged = ingest.upsert([self.read(name), df], list(KEYS[name]))
                self._replace(name, merged)
            written[name] = df.count()
        return written

    def delete(self, snapshots: list[str]) -> dict[str, int]:
        """Take snapshots out of all tables; how many records of each table went."""
        gone = {}
        for name in SCHEMAS:
            rows = self.read(name)
            key = SNAP if SNAP in rows.columns else "stableKey" if name == "snapshots" else None
            if key is None:
                continue
            hit = rows.filter(F.col(key).isin(snapshots))
            gone[name] = hit.count()
            if not gone[name]:
                continue
            if key == SNAP:
                for snapshot in snapshots:  # a partition is dropped, the others are not touched
                    self._drop(f"{self.folder}/{name}/{SNAP}={_partition(snapshot)}")
            else:
                self._replace(name, rows.filter(~F.col(key).isin(snapshots)))
        return gone

    def recreate(self) -> None:
        """Drop everything."""
        for name in SCHEMAS:
            self._drop(f"{self.folder}/{name}")

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing:
            raise StoreError(*[f"{name}.{c}Missing" for c in missing])
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).dropDuplicates(list(KEYS[name]))

    def _problems(self, tables: dict[str, DataFrame]) -> list[str]:
        checks = {}
        if "edges" in tables:
            nodes = tables.get("nodes", self.read("nodes"))
            ends = tables["edges"].select(SNAP, "stableKey", F.col("sourceNodeStableKey").alias("source"), F.col("targetNodeStableKey").alias("target"))
            checks["EdgeEndMissing"] = ingest.dangling_edges(nodes, ends)
        if "metrics" in tables:
            checks["MetricWithoutValue"] = tables["metrics"].filter(F.col("numericValue").isNull() & F.col("textValue").isNull())
        if "evidence" in tables:
            checks["EvidenceLinesInvalid"] = tables["evidence"].filter((F.col("startLine") < 1) | (F.col("endLine") < F.col("startLine")))
        problems = [code for code, bad in checks.items() if not bad.isEmpty()]
        for name, df in tables.items():
            if "unknownState" in df.columns:
                problems += [f"{name}.{r['problem']}" for r in ingest.invalid_records(df).select("problem").distinct().orderBy("problem").collect()]
        return problems

    def _replace(self, name: str, df: DataFrame) -> None:
        """The old table is put aside until the new one stands, so that a break leaves one of them."""
        path, beside, old = (f"{self.folder}/{x}" for x in (name, f".{name}-new", f".{name}-old"))
        df.write.mode("overwrite").parquet(beside)
        if self._there(path):
            self._drop(old)
            self._rename(path, old)
        self._rename(beside, path)
        self._drop(old)

    def _rename(self, path: str, to: str) -> None:
        files, where = self._files(path)
        if not files.rename(where, self._path(to)):
            raise StoreError("RenameFailed")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        where = self._path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _there(self, path: str) -> bool:
        files, where = self._files(path)
        return files.exists(where)

    def _drop(self, path: str) -> None:
        files, where = self._files(path)
        files.delete(where, True)


def _partition(value: str) -> str:
    """A partition value as folder names spell it."""
    special = set('"#%\'*/:=?\\\x7f{[]^') | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in value)
