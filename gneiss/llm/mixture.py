"""Mixing sources to target weights.

The size of the mix is cut into blocks of equally many tokens. Blocks are given to sources by the highest quotients of
Sainte-Lague (share over odd numbers), as far as a source's documents last when each may appear ``max_repeats`` times. As this
apportionment never takes a block back when the house grows, the quotas of the output shards are the differences between growing
houses. Within a source, documents lie in a seeded random order; the order is passed as often as the quota asks for, and the place
of each appearance in it says to which block, and so to which shard, it belongs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.work import staged

#: Documents in an interval of the seeded order, about; sums over the intervals make the places of documents without ordering a source in one task.
INTERVAL_ROWS = 100_000


@dataclass(frozen=True)
class Source:
    """A source of a mix: its share, how often a document may appear, its tokens."""

    name: str
    share: float
    max_repeats: int
    tokens: int


def sainte_lague(shares: Sequence[float], limits: Sequence[int], seats: Sequence[int]) -> list[list[int]]:
    """Seats of each party at every house size in ``seats`` (ascending), with a limit of seats for each party.

    The highest quotient share / (2 won + 1) takes the next seat; ties go to the earlier party. Parties with no share or at their
    limit are passed over; when all are, the house stays as it is. Large houses are not counted up one by one: each party gets at
    once what is safely its own, and the rest by quotients.
    """
    won = [0] * len(shares)
    weight = [Fraction(max(s, 0.0)) for s in shares]
    out = []
    for size in seats:
        free = size - sum(won)
        open_ = [i for i in range(len(shares)) if weight[i] > 0 and won[i] < limits[i]]
        while open_ and free > 4 * len(shares):
            total = sum(weight[i] for i in open_)
            reach = sum(won[i] for i in open_) + free
            # a party is never more than its number of rivals below its exact share
            for i in open_:
                safe = min(limits[i], int(weight[i] / total * reach) - len(open_))
                won[i] = max(won[i], safe)
            left = size - sum(won)
            if left == free:
                break
            free = left
            open_ = [i for i in open_ if won[i] < limits[i]]
        heap = [(-weight[i] / (2 * won[i] + 1), i) for i in open_ if won[i] < limits[i]]
        heapify(heap)
        while heap and free > 0:
            _, i = heappop(heap)
            won[i] += 1
            free -= 1
            if won[i] < limits[i]:
                heappush(heap, (-weight[i] / (2 * won[i] + 1), i))
        out.append(list(won))
    return out


def largest_exact(sources: Sequence[Source]) -> int:
    """The most tokens with which every source that has any still reaches its share."""
    there = [s for s in sources if s.share > 0 and s.tokens > 0 and s.max_repeats > 0]
    if not there:
        return 0
    whole = sum(Fraction(s.share) for s in there)
    return int(min(Fraction(s.tokens * s.max_repeats) * whole / Fraction(s.share) for s in there))


@dataclass
class Mix:
    """``members`` (source, doc_id, copy, tokens, shard) and ``report`` (source, target_share, max_repeats, available, quota, mixed, actual_share)."""

    members: DataFrame
    report: DataFrame


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int | None = None, shards: int = 16, seed: int = 17) -> Mix:
    """Mix the documents of ``sizes`` (doc_id, source, tokens) to the shares of ``targets`` (source, target_share, max_repeats).

    ``total`` is the size in tokens; by default the largest with which every source reaches its share within its repeats. With a
    larger total, sources that run out give all they have and the others share the rest. ``block`` is the tokens of a block, by
    default a ten-thousandth of the total. Documents without tokens, without a source or from a source without a target are left
    out; a source of ``targets`` without documents is reported with 0. Of repeated rows in ``targets`` the first by share counts.
    Whole documents are taken, so a source misses its quota by half a document at most, unless it runs out. A source whose documents,
    with their repeats, have fewer tokens than one block gets none; a smaller ``block`` lets it in.
    """
    wanted = sorted({r["source"]: r for r in sorted(targets.select("source", "target_share", "max_repeats").filter(F.col("source").isNotNull()).collect(), key=lambda r: -(r["target_share"] or 0.0))}.values(), key=lambda r: r["source"])
    names = [r["source"] for r in wanted]  # one row for each source of the mix; the table of targets is fixed in size
    spark = sizes.sparkSession
    usable = sizes.filter(F.col("doc_id").isNotNull()).select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))
    usable = usable.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "source string")), "source", "left_semi")
    order = F.xxhash64("doc_id", F.lit(seed))
    usable = staged(usable.withColumn("order", order), "mix-sizes")
    # the leading bits of the order, so many that an interval stays small however many documents there are; the places are the same with any number
    bits = min(40, max(4, (usable.count() // INTERVAL_ROWS).bit_length() + 1))
    usable = usable.withColumn("interval", F.shiftright("order", 64 - bits)).filter(F.col("tokens") > 0)  # after writing, else the texts would be counted once more for the filter
    steps = usable.groupBy("source", "interval").agg(F.sum("tokens").alias("tokens"))
    have = {r["source"]: r["tokens"] for r in steps.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    sources = [Source(r["source"], float(r["target_share"] or 0.0), int(r["max_repeats"] or 0), int(have.get(r["source"], 0))) for r in wanted]
    total = largest_exact(sources) if total is None else total
    block = max(1, total // 10_000) if block is None else block
    limits = [s.tokens * s.max_repeats // block for s in sources]
    houses = [(k + 1) * (total // block) // shards for k in range(shards)]
    at = sainte_lague([s.share for s in sources], limits, houses) if sources else [[]]
    quota = {s.name: at[-1][i] * block for i, s in enumerate(sources)}
    bounds = [(s.name, k, (at[k - 1][i] if k else 0) * block, at[k][i] * block) for i, s in enumerate(sources) for k in range(shards)]
    plan = spark.createDataFrame([(s.name, s.share, s.max_repeats, s.tokens, quota[s.name]) for s in sources], "source string, target_share double, max_repeats int, available bigint, quota bigint")
    edges = spark.createDataFrame(bounds, "source string, shard int, low bigint, high bigint")

    line = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.withColumn("start", F.coalesce(F.sum("tokens").over(line), F.lit(0))).drop("tokens")
    within = Window.partitionBy("source", "interval").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = usable.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["source", "interval"]).join(F.broadcast(plan.select("source", "quota", "available", "max_repeats")), "source")
    # the middle of the c-th appearance lies at c * available + start + tokens / 2; it is in the mix if that is below the quota
    middle = F.col("start") + F.col("inside") + F.floor(F.col("tokens") / 2)
    copies = F.least(F.col("max_repeats").cast("long"), F.greatest(F.lit(0), F.ceil((F.col("quota") - middle) / F.col("available"))))
    placed = placed.withColumn("middle", middle).withColumn("copies", copies).filter(F.col("copies") > 0)
    each = placed.select("source", "doc_id", "tokens", F.col("middle"), "available", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
    each = each.withColumn("place", F.col("middle") + F.col("copy") * F.col("available"))
    e = F.broadcast(edges.filter("high > low").withColumnRenamed("source", "e_source"))
    members = each.join(e, (F.col("source") == F.col("e_source")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select("source", "doc_id", "copy", "tokens", "shard")
    members = staged(members, "mix-members")
    got = members.groupBy("source").agg(F.sum("tokens").alias("mixed"), F.max("copy").alias("repeats"))
    everything = Window.partitionBy(F.lit(1))
    report = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", "available", "quota", F.coalesce("mixed", F.lit(0)).alias("mixed"), (F.coalesce("repeats", F.lit(-1)) + 1).alias("most_repeats"))
    whole = F.sum("mixed").over(everything)
    return Mix(members, report.withColumn("actual_share", F.when(whole > 0, F.col("mixed") / whole).otherwise(F.lit(0.0))))
