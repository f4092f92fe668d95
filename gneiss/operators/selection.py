"""Which snapshot a query speaks of: latest, previous, comparable, by lifecycle filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def taken_at() -> Column:
    """When a snapshot counts as taken: its completion, else its start."""
    return F.coalesce("completedUtc", "startedUtc")


def _newest(*groups: str) -> Window:
    return Window.partitionBy(*groups).orderBy(taken_at().desc(), F.col("startedUtc").desc(), F.col("stableKey").desc())


def latest_snapshots(headers: DataFrame) -> DataFrame:
    """The latest snapshot of each repository; ties in time go to the later start, then the greater key."""
    return headers.withColumn("__p", F.row_number().over(_newest("repositoryStableKey"))).filter("__p = 1").drop("__p")


def latest_pairs(headers: DataFrame) -> DataFrame:
    """(repositoryStableKey, current, previous) of the repositories with two snapshots or more."""
    ranked = headers.withColumn("__p", F.row_number().over(_newest("repositoryStableKey"))).filter("__p <= 2")
    both = ranked.groupBy("repositoryStableKey").agg(F.max(F.when(F.col("__p") == 1, F.col("stableKey"))).alias("current"), F.max(F.when(F.col("__p") == 2, F.col("stableKey"))).alias("previous"))
    return both.filter(F.col("previous").isNotNull())


def previous_comparable(headers: DataFrame) -> DataFrame:
    """As-of pairs (stableKey, previous): for each snapshot the last other one of its repository that was taken no later; ties go to the greater key.

    A self join on time is not needed: it is the neighbour in order, except for snapshots taken at one time, for whom it is the greatest key of these.
    """
    at = headers.select("repositoryStableKey", "stableKey", taken_at().alias("at"))
    order = Window.partitionBy("repositoryStableKey").orderBy("at", "stableKey")
    same = Window.partitionBy("repositoryStableKey", "at")
    greatest = F.max("stableKey").over(same)
    previous = F.when(F.col("stableKey") == greatest, F.lag("stableKey").over(order)).otherwise(greatest)
    return at.select("repositoryStableKey", "stableKey", previous.alias("previous"))


def current_snapshots(headers: DataFrame) -> DataFrame:
    """(repositoryStableKey, state, candidates): the snapshots taken last, of these the started last; ``ambiguous`` if several are left."""
    rank = F.rank().over(Window.partitionBy("repositoryStableKey").orderBy(taken_at().desc(), F.col("startedUtc").desc()))
    last = headers.withColumn("__r", rank).filter("__r = 1").groupBy("repositoryStableKey").agg(F.array_sort(F.collect_set("stableKey")).alias("candidates"))
    return last.select("repositoryStableKey", F.when(F.size("candidates") > 1, "ambiguous").otherwise("current").alias("state"), "candidates")


def lifecycle(headers: DataFrame, repository: str | None = None, branch: str | None = None, status: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Snapshots that pass all filters given; the range of starts includes both ends."""
    keep = F.lit(True)
    for column, value in (("repositoryStableKey", repository), ("branchName", branch), ("status", status)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    if since is not None:
        keep = keep & (F.col("startedUtc") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        keep = keep & (F.col("startedUtc") <= F.lit(until).cast("timestamp_ntz"))
    return headers.filter(keep).orderBy(F.col("startedUtc").desc(), "stableKey")


def retention_candidates(headers: DataFrame, keep_latest: int, cutoff: datetime) -> DataFrame:
    """Snapshots beyond the ``keep_latest`` newest of their repository that started before ``cutoff``."""
    place = F.row_number().over(_newest("repositoryStableKey"))
    return headers.withColumn("place", place).filter((F.col("place") > keep_latest) & (F.col("startedUtc") < F.lit(cutoff).cast("timestamp_ntz")))


def selector_kind(selector: str) -> str:
    """``latest`` for the words latest and current (case ignored), else ``explicit``, which must be a snapshot key."""
    text = selector.strip()
    if text.lower() in ("latest", "current"):
        return "latest"
    if not text.startswith("snapshot://"):
        raise ValueError("SnapshotSelectorInvalid")
    return "explicit"
