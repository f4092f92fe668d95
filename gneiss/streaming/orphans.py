"""The orphan ledger as a stream: each micro-batch of versions is one batch of the ledger, and counts are written as they stand.

The stream's events are one table with a ``role``: ``parent`` rows (h1, h2, at, alive) and ``reference`` rows (ref_table, scope,
record, at, refs). State is kept in a folder of its own: the ledger's files, and one small file for each batch that names them. A sink
made anew over the same folder goes on from the last of these, and a batch that is delivered again after a failure is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.orphans import OrphanLedger
from gneiss.work import Files

REFERENCE = ["ref_table", "scope", "record", "at", "refs"]
PARENT = ["h1", "h2", "s", "at", "alive"]
EVENT_SCHEMA = "role string, h1 bigint, h2 bigint, s bigint, at timestamp_ntz, alive boolean, ref_table string, scope string, record string, refs array<struct<field:string,table:string,key:string>>"


def parent_events(parents: DataFrame) -> DataFrame:
    return parents.select(F.lit("parent").alias("role"), *PARENT)


def reference_events(references: DataFrame) -> DataFrame:
    return references.select(F.lit("reference").alias("role"), *REFERENCE)


class LedgerSink:
    """A function for ``foreachBatch`` that carries the ledger from batch to batch and hands each state on.

    ``folder`` is where the state is kept, on storage that all executors share; without one it lasts as long as the application.
    """

    def __init__(self, on_state: Callable[[OrphanLedger, int], None] | None = None, folder: str | None = None) -> None:
        self.on_state, self.folder = on_state, folder
        self.ledger, self.last = OrphanLedger(folder=folder), -1
        self._read = False

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self._resume(spark)
        if batch_id <= self.last:
            return
        references = batch.filter(F.col("role") == "reference").select(*REFERENCE)
        parents = batch.filter(F.col("role") == "parent").select(*PARENT)
        before = self.ledger
        self.ledger, self.last = before.apply(references, parents), batch_id
        if self.folder:
            self._save(spark, before)
        if self.on_state:
            self.on_state(self.ledger, batch_id)

    def _resume(self, spark: SparkSession) -> None:
        if self._read or not self.folder:
            return
        self._read = True
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            ids = [int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit()]
            if ids:
                self.last = max(ids)
                self.ledger = OrphanLedger.from_json(spark.read.text(f"{self.folder}/state/{self.last}").first()[0], self.folder)

    def _save(self, spark: SparkSession, before: OrphanLedger) -> None:
        """The new state is written beside the old one and renamed; then the state before the last, and files that none names, go."""
        jvm = spark.sparkContext._jvm
        where = f"{self.folder}/state/{self.last}"
        spark.createDataFrame([(self.ledger.to_json(),)], "state string").coalesce(1).write.mode("overwrite").text(where + ".new")
        path = jvm.org.apache.hadoop.fs.Path(where)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(jvm.org.apache.hadoop.fs.Path(where + ".new"), path)
        for status in files.listStatus(path.getParent()):
            name = status.getPath().getName()
            if name != str(self.last):
                files.delete(status.getPath(), True)
        named = {p for paths in self.ledger.parts.values() for p in paths}
        Files(spark, self.folder, keep=True).remove(p for paths in before.parts.values() for p in paths if p not in named)
