"""Shared working storage: where lineage is cut.

Intermediate results are written to the folder that the cluster names in ``spark.checkpoint.dir``, which all executors share, so
that a lost executor costs a re-read and not a recomputation. Only where that setting is missing and all tasks run on this machine
(tests, a laptop) is a local folder made; on a cluster the setting is needed.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; set first where the cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gneiss-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each application, so that functions in Python run wherever they land."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as own:  # on the driver only; executors fetch the copy in the shared folder
        local = os.path.join(own, "gneiss.zip")
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith((".py", ".json")):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("gneiss", os.path.relpath(path, root)))
        target = f"{shared_folder(spark)}/gneiss-{uuid.uuid4().hex}.zip"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where.getParent())
        files.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path("file://" + local), where)
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a cut in the lineage that survives lost executors.

    The files are removed when the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gneiss-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _note(spark, path)
    return spark.read.schema(schema).parquet(path)


class Files:
    """Written tables of one owner in the shared folder: those that stay, and those that are dropped when a step is done."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool = False) -> None:
        self.spark, self.folder, self.keep = spark, folder, keep
        self.passing: list[str] = []

    def write(self, df: DataFrame, name: str) -> str:
        """Write a table and give its path; unless it is to be kept, its files are removed when the driver ends."""
        path = f"{self.folder}/{name}/part=p{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not self.keep:
            _note(self.spark, path)
        return path

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that is needed until :meth:`drop_kept`, and read it again."""
        schema = df.schema
        path = self.write(df, name)
        self.passing.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop_kept(self) -> None:
        self.remove(self.passing)
        self.passing = []

    def remove(self, paths: Iterable[str]) -> None:
        gone = set(paths)
        for path in gone:
            _delete(self.spark, path)
        _written[:] = [w for w in _written if w[1] not in gone]


def read_parts(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Tables that :class:`Files` wrote under one name, as one scan; an empty table for none."""
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", paths[0].rpartition("/")[0]).parquet(*paths)
    return rows.drop("part")


def _note(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Remove all that was staged so far. Frames made before, and those derived from them, cannot be read any more; what is kept of them for reuse is forgotten."""
    _clean()
    _written.clear()
    for forget in on_release:
        forget()


#: Called by :func:`release`, for modules that keep staged frames.
on_release: list[Callable[[], None]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by then  # noqa: BLE001
            return
