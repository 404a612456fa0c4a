"""Return series: log and simple returns, and the per-lookback strategy panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.quantile import exact_percentile
from quantspan.plans.blocks import DAY, carry_in, match_keys, time_bucket, with_halo
from quantspan.session import materialize
from quantspan.sources.bars import positioned

DEFAULT_LOOKBACKS = (10, 20, 30, 40, 50)


def bar_returns(bars: DataFrame, keys: Sequence[str] = ("instrument",), seconds: int = DAY) -> DataFrame:
    """``log_ret`` (NULL on the first bar) and ``simple_ret`` (0 on the first bar) per bar.

    The close before the first bar of a time bucket is carried in from earlier buckets.
    """
    keys = list(keys)
    rows = bars.withColumn("__b", time_bucket("ts", seconds))
    carried = carry_in(
        rows, keys, "__b", {"__c": F.max_by("close", "ts")}, {"__before": F.last("__c", ignorenulls=True)}
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("ts")
    prev = match_keys(rows.withColumn("__lag", F.lag("close").over(inside)), carried, [*keys, "__b"])
    before = F.coalesce("__lag", "__before")
    return (
        prev.withColumn("log_ret", F.log("close") - F.log(before))
        .withColumn("simple_ret", F.coalesce(F.try_divide(F.col("close"), before) - 1, F.lit(0.0)))
        .drop("__b", "__lag", "__before")
    )


def rolling_features(bars: DataFrame, lookbacks: Sequence[int], seconds: int = DAY, block: int = 8192) -> DataFrame:
    """Per bar and lookback: momentum sign and rolling volatility at the bar and one bar earlier.

    All lookbacks share one partitioning and one sort; blocks of an instrument run in parallel
    and see the last ``max(lookbacks) + 2`` bars of the block before.
    Output: instrument, ts, pos, n, ret, lookback, vol, prev_vol, prev_mom.
    """
    deep = max(lookbacks) + 2
    pos = positioned(bars.select("instrument", "ts", "close"), seconds=seconds, total="n")
    rows = with_halo(pos, "pos", deep, block)
    w = Window.partitionBy("instrument", "blk").orderBy("pos")
    rows = rows.withColumn("ret", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    per = []
    for lb in lookbacks:
        full = F.col("pos") >= lb - 1
        mom = F.coalesce(F.signum(F.col("close") - F.lag("close", lb).over(w)), F.lit(0.0))
        vol = F.when(full, F.stddev_samp("ret").over(w.rowsBetween(-(lb - 1), 0)))
        per.append((f"__m{lb}", f"__v{lb}", mom, vol))
    rows = rows.select("*", *[c.alias(n) for m, v, mom, vol in per for n, c in ((m, mom), (v, vol))])
    cells = F.array(
        *[
            F.struct(
                F.lit(lb).alias("lookback"),
                F.col(v).alias("vol"),
                F.lag(v).over(w).alias("prev_vol"),
                F.lag(m).over(w).alias("prev_mom"),
            )
            for lb, (m, v, _, _) in zip(lookbacks, per)
        ]
    )
    return (
        rows.withColumn("__cells", cells)
        .where(~F.col("halo"))
        .select("instrument", "ts", "pos", "n", "ret", F.explode("__cells").alias("__c"))
        .select("instrument", "ts", "pos", "n", "ret", "__c.*")
    )


def strategy_returns(
    bars: DataFrame,
    lookbacks: Sequence[int] = DEFAULT_LOOKBACKS,
    seconds: int = DAY,
    block: int = 8192,
    align: bool = True,
    stage: bool = True,
) -> DataFrame:
    """Return panel of the regime-switched momentum strategy, one config per lookback.

    The position taken at a bar earns the next bar's return: momentum in calm markets, its
    opposite while rolling volatility exceeds its median over the whole series. With ``align``
    every config keeps the tail all lookbacks share and ``t`` counts from its start. The median
    needs further passes over the rolling features, so they are written once (``stage``).
    Output: sleeve_id (the instrument), config_id, t, ts, ret, n_obs (length of the series).
    """
    features = rolling_features(bars, lookbacks, seconds, block)
    if stage:
        features = materialize(features, "features")
    median = exact_percentile(features, ["instrument", "lookback"], "vol", 0.5, "median_vol")
    if stage:
        median = materialize(median, "medians")
    rows = match_keys(features, median, ["instrument", "lookback"])
    fade = F.coalesce(F.col("prev_vol") > F.col("median_vol"), F.lit(False))
    position = F.coalesce(F.when(fade, -F.col("prev_mom")).otherwise(F.col("prev_mom")), F.lit(0.0))
    skip = F.lit(max(lookbacks) + 1) if align else F.col("lookback") + 1
    config = F.array_position(F.array(*[F.lit(x) for x in lookbacks]), F.col("lookback")).cast("int") - 1
    return (
        rows.withColumn("t", F.col("pos") - skip)
        .where("t >= 0")
        .select(
            F.col("instrument").alias("sleeve_id"),
            config.alias("config_id"),
            "t",
            "ts",
            (position * F.col("ret")).alias("ret"),
            (F.col("n") - skip).alias("n_obs"),
        )
    )


def max_drawdown(
    panel: DataFrame, keys: Sequence[str] = ("sleeve_id", "config_id"), block: int = 8192
) -> DataFrame:
    """Largest drawdown of the compounded return series per key.

    The peak starts at the first equity point. Blocks compound locally; growth and peak before
    a block are prefixes over the block totals.
    """
    keys = list(keys)
    rows = panel.select(*keys, "t", "ret").withColumn("blk", F.floor(F.col("t") / block).cast("long"))
    inside = Window.partitionBy(*keys, "blk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("eq", F.product(1 + F.col("ret")).over(inside))
    totals = local.groupBy(*keys, "blk").agg(F.max_by("eq", "t").alias("g"), F.max("eq").alias("m"))
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    prefixed = totals.withColumn("g0", F.coalesce(F.product("g").over(before), F.lit(1.0))).withColumn(
        "peak0", F.max(F.col("g0") * F.col("m")).over(before)
    )
    joined = match_keys(local, prefixed.select(*keys, "blk", "g0", "peak0"), [*keys, "blk"])
    equity = F.col("g0") * F.col("eq")
    peak = F.greatest(F.col("peak0"), F.col("g0") * F.max("eq").over(inside))
    return (
        joined.withColumn("dd", F.try_divide(peak - equity, peak))
        .groupBy(*keys)
        .agg(F.max("dd").alias("max_dd"))
    )
