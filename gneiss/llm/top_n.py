"""Top N items within every group.

Each input partition keeps its own N best items of every group it sees, and the score of its N-th is a lower bound: at least N items
of the group are that good. The greatest bound of a group, over all partitions, filters what the partitions kept, and only the
survivors (N for each group, and those that tie with the bound) are ranked. A group with a third of all rows is cut to N rows for each
partition before anything is shuffled. All of it are built-in operators, so scores are compared as what they are, decimals of
38 digits included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.work import staged


def top_n(rows: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows with the highest ``score`` of each group: (*groups, score, *ties, rank).

    Equal scores are ordered by the text columns ``ties`` ascending in binary order, nulls last; rows that are equal in all of that
    get different ranks in no defined order. Rows with a null or NaN score never count; null group fields form a group of their own.
    Other columns are ignored. An empty table gives an empty table.
    """
    if n < 1 or not groups:
        raise ValueError("n must be at least 1, and there must be a group column")
    g, t = [f"g{i}" for i in range(len(groups))], [f"t{i}" for i in range(len(ties))]
    flat = rows.filter(F.col(score).isNotNull()).select(*[F.col(c).alias(a) for c, a in zip(groups, g)], F.col(score).alias("score"), *[F.col(c).cast("string").alias(a) for c, a in zip(ties, t)])
    if isinstance(flat.schema["score"].dataType, (T.FloatType, T.DoubleType)):
        flat = flat.filter(~F.isnan("score"))
    best = [F.col("score").desc(), *[F.col(a).asc_nulls_last() for a in t]]
    # a task cuts each group to n rows before the exchange by (partition, group), as the number of the partition is the same for all of its rows
    own = Window.partitionBy("part", *g).orderBy(*best)
    local = flat.withColumn("part", F.spark_partition_id()).withColumn("place", F.row_number().over(own)).filter(F.col("place") <= n)
    local = staged(local.drop("part"), "top-local")
    bounds = local.filter(F.col("place") == n).groupBy(*[F.col(a).alias(f"b_{a}") for a in g]).agg(F.max("score").alias("bound"))
    # bounds are at most one row for each group; null groups meet as well
    same = [F.col(a).eqNullSafe(F.col(f"b_{a}")) for a in g]
    near = local.join(bounds, same, "left").filter(F.col("bound").isNull() | (F.col("score") >= F.col("bound")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*g).orderBy(*best))).filter(F.col("rank") <= n)
    return ranked.select(*[F.col(a).alias(c) for a, c in zip(g, groups)], F.col("score").alias(score), *[F.col(a).alias(c) for a, c in zip(t, ties)], "rank")
