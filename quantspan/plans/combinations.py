"""Combinations by their rank, so that none has to be listed in a plan or found by scanning masks."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks that one row is exploded into at a time.
BLOCK = 4096


def mask_at(rank: Column, n: int, k: int) -> Column:
    """The bit mask of ``k`` of ``n`` items at a rank (from 0), masks in ascending order.

    From the highest item down: an item belongs to the combination if the rank is not below the number of combinations
    that do without it and all higher ones, which is taken off the rank then.
    """
    if not 0 <= k <= n <= 62:
        raise ValueError("need 0 <= k <= n <= 62")
    without = F.array(*[F.lit(comb(item, left)).cast("long") for item in range(n) for left in range(k + 1)])
    start = F.struct(rank.cast("long").alias("rank"), F.lit(k).alias("left"), F.lit(0).cast("long").alias("mask"))

    def step(at: Column, item: Column) -> Column:
        skipped = F.get(without, item * (k + 1) + at["left"])
        taken = (at["left"] > 0) & (at["rank"] >= skipped)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), item)
        return F.struct(
            (at["rank"] - F.when(taken, skipped).otherwise(F.lit(0).cast("long"))).alias("rank"),
            (at["left"] - F.when(taken, 1).otherwise(0)).alias("left"),
            (at["mask"] + F.when(taken, bit).otherwise(F.lit(0).cast("long"))).alias("mask"),
        )

    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), start, step)["mask"]


def with_masks(rows: DataFrame, n: int, k: int, name: str = "mask") -> DataFrame:
    """Each row once for every combination of ``k`` of ``n`` items.

    Rows are dealt into blocks of ``BLOCK`` ranks first, so that one row's combinations are spread over tasks.
    """
    total = comb(n, k)
    blocks = -(-total // BLOCK)
    out = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks > 1:
        out = out.repartition(min(blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64("__block", *rows.columns))
    first = F.col("__block").cast("long") * BLOCK
    ranks = F.sequence(first, F.least(first + (BLOCK - 1), F.lit(total - 1).cast("long")))
    return out.withColumn(name, F.explode(F.transform(ranks, lambda rank: mask_at(rank, n, k)))).drop("__block")
