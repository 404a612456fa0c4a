"""Exact percentiles of skewed groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspan.plans.blocks import match_keys
from quantspan.session import materialize


def exact_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    p: float,
    out: str,
    accuracy: int = 10_000,
    stage: bool = True,
) -> DataFrame:
    """Linearly interpolated percentile per group, exact, without holding a group in memory.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here a
    bounded sketch brackets the wanted ranks, values below the bracket are only counted, and
    the exact ranks are read off the few values inside it. A
    bracket is as wide as the sketch errs and two ranks at least, so a small group's is its whole
    range. One that misses its ranks raises an error instead of giving a wrong value. The brackets, one row per group, are written first (``stage``): their
    size is known then, and the input is not shuffled to meet them while they are few.
    """
    widths = sorted({2.0 / accuracy, *(w for w in (1e-3, 1e-2, 1e-1, 1.0) if w > 2.0 / accuracy)})
    bounds = [x for w in widths for x in (max(0.0, p - w), min(1.0, p + w))]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("__v"))
    bracket = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", bounds, accuracy).alias("__q"),
    )
    wide_enough = [F.when(F.col("__n") * w >= 2, 2 * k) for k, w in enumerate(widths)]
    at_width = F.coalesce(*wide_enough, F.lit(2 * len(widths) - 2))
    bracket = bracket.select(
        *keys,
        "__n",
        F.col("__q")[at_width].alias("__lo"),
        F.col("__q")[at_width + 1].alias("__hi"),
    )
    if stage:
        bracket = materialize(bracket, "brackets")
    low = F.col("__v") < F.col("__lo")
    keep = F.col("__v") <= F.col("__hi")
    counted = (
        match_keys(rows, bracket, keys, "inner")
        .where(keep)
        .withColumn("__c", F.when(~low, F.col("__v")))
        .groupBy(*keys, "__n", "__c")
        .agg(F.count(F.lit(1)).alias("__k"))
    )
    upto = (
        Window.partitionBy(*keys).orderBy(F.col("__c").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    )
    h = F.lit(p) * (F.col("__n") - 1)
    k = F.floor(h)
    ranked = counted.withColumn("__end", F.sum("__k").over(upto)).withColumn("__start", F.col("__end") - F.col("__k"))
    at = lambda r: F.max(F.when((F.col("__start") <= r) & (r < F.col("__end")), F.col("__c")))
    picked = ranked.groupBy(*keys, "__n").agg(
        at(k).alias("__a"), at(F.least(k + 1, F.col("__n") - 1)).alias("__z")
    )
    value_at = F.col("__a") + (F.col("__z") - F.col("__a")) * (h - k)
    return picked.select(
        *keys,
        F.when(F.col("__a").isNotNull() & F.col("__z").isNotNull(), value_at)
        .otherwise(F.raise_error(F.lit("percentile bracket missed its rank; raise the accuracy")))
        .cast("double")
        .alias(out),
    )
