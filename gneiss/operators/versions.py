"""Versions of records: which row holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD_KEY = ("snapshotStableKey", "stableKey")


def holding(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = RECORD_KEY, order: str = "loadedUtc") -> DataFrame:
    """Of each record (rows with an equal ``key``, nulls equal to each other) the row with the greatest ``order``.

    One aggregation, combined on the map side, over the named ``columns`` only. Rows that tie are taken to be identical; should
    they differ, one whole row of them is kept. A null ``order`` holds only if the record has no other. An empty table gives an
    empty table.
    """
    rest = [c for c in dict.fromkeys(columns) if c not in key]
    latest = F.max_by(F.struct(*rest, F.col(order).alias("__o")), F.coalesce(F.col(order), F.lit("0001-01-01").cast("timestamp_ntz")))
    return rows.groupBy(*key).agg(latest.alias("__v")).select(*key, *[F.col(f"__v.{c}").alias(c) for c in rest])
