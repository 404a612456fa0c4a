"""Cost calibrations kept up to date from increments of bars.

Bars are filed by period (a day, a month). For each instrument, hour and period the store has centred moments
of the spreads and of the returns within the period, sums of closes and volumes, the first and the last close,
and counts of the spreads in logarithmic bins. All of these add up over periods, so an increment rewrites the
periods it has bars of and no others, and a calibration reads one row per instrument, hour and period. What is
missing between two periods, the return from the last bar of one to the first of the next, follows from these rows.

The percentile is exact: merged counts tell in which bins the wanted ranks lie, and only the spreads of these
bins are read from the filed bars.

An increment may repeat bars or bring later versions of them: a bar replaces the one of its instrument and time.
The three tables of a period are all made from its bars, which are written first, so an increment that died is
mended by adding it again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspan.config import INSTRUMENT_SPECS
from quantspan.operators.costs import calibration_rows, spread_ticks
from quantspan.plans.blocks import match_keys
from quantspan.session import materialize
from quantspan.sources.tables import read_table

KEYS = ["instrument", "hour_utc"]
#: Ratio of a bin's upper to its lower bound.
BIN = 1.001
P95 = 0.95

BARS = "instrument string, hour_utc int, ts timestamp, close double, volume double, spread double, bin long, period timestamp"
PARTS = (
    "instrument string, hour_utc int, n long, spread_mean double, spread_m2 double, n_ret long, ret_mean double, ret_m2 double, "
    "close_sum double, n_close long, volume_sum double, n_volume long, first_close double, last_close double, period timestamp"
)
BINS = "instrument string, hour_utc int, bin long, k long, period timestamp"


def _put(df: DataFrame, path: str, schema: str) -> None:
    """Replace the periods that ``df`` has rows of."""
    names = df.sparkSession.createDataFrame([], schema).columns
    rows = df.select(*names).repartition("period", *[x for x in KEYS if x in names])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def _parts(rows: DataFrame) -> DataFrame:
    inside = Window.partitionBy(*KEYS, "period").orderBy("ts")
    rows = rows.withColumn("ret", F.log("close") - F.log(F.lag("close").over(inside)))
    return rows.groupBy(*KEYS, "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("spread").alias("spread_mean"),
        (F.var_pop("spread") * F.count("spread")).alias("spread_m2"),
        F.count("ret").alias("n_ret"),
        F.avg("ret").alias("ret_mean"),
        (F.var_pop("ret") * F.count("ret")).alias("ret_m2"),
        F.sum("close").alias("close_sum"),
        F.count("close").alias("n_close"),
        F.sum("volume").alias("volume_sum"),
        F.count("volume").alias("n_volume"),
        F.min_by("close", "ts").alias("first_close"),
        F.max_by("close", "ts").alias("last_close"),
    )


def add_bars(path: str, bars: DataFrame, period: str = "day", specs: Mapping[str, tuple[float, float]] = INSTRUMENT_SPECS) -> None:
    """File an increment of bars (instrument, ts, high, low, close, volume) in the store at ``path``."""
    spark = bars.sparkSession
    new = bars.select(
        "instrument",
        F.hour("ts").alias("hour_utc"),
        "ts",
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
        spread_ticks(specs).cast("double").alias("spread"),
    )
    usable = F.col("spread").isNotNull() & ~F.isnan("spread")
    new = new.withColumn("bin", F.when(usable, F.floor(F.log("spread") / F.log(F.lit(BIN)))).cast("long"))
    new = materialize(new.withColumn("period", F.date_trunc(period, "ts")), "increment")
    old = read_table(spark, f"{path}/bars", BARS)
    kept = match_keys(old, new.select("period").distinct(), ["period"], "left_semi")
    kept = match_keys(kept, new.select("instrument", "ts"), ["instrument", "ts"], "left_anti")
    newest = new.groupBy("instrument", "ts").agg(F.max(F.struct(*[x for x in new.columns if x not in ("instrument", "ts")])).alias("r"))
    rows = materialize(kept.unionByName(newest.select("instrument", "ts", "r.*")), "filed")
    _put(rows, f"{path}/bars", BARS)
    _put(_parts(rows), f"{path}/parts", PARTS)
    _put(rows.where("bin is not null").groupBy(*KEYS, "bin", "period").agg(F.count(F.lit(1)).alias("k")), f"{path}/bins", BINS)


def _spread_of(parts: DataFrame, n: str, mean: str, m2: str, name: str) -> DataFrame:
    """``KEYS``, ``<name>_mean`` and ``<name>_var`` of all parts together, from centred moments."""
    parts = parts.where(F.col(n) > 0).select(*KEYS, F.col(n).alias("n"), F.col(mean).alias("mean"), F.col(m2).alias("m2"))
    whole = parts.groupBy(*KEYS).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    off = F.col("mean") - F.col("all_mean")
    return match_keys(parts, whole, KEYS, "inner").groupBy(*KEYS).agg(
        F.first("all_mean").alias(f"{name}_mean"), (F.sum(F.col("m2") + F.col("n") * off * off) / F.sum("n")).alias(f"{name}_var")
    )


def _percentile(spark: SparkSession, path: str, p: float) -> DataFrame:
    """The percentile of the spreads per ``KEYS``, interpolated between two exact ranks."""
    bins = read_table(spark, f"{path}/bins", BINS).groupBy(*KEYS, "bin").agg(F.sum("k").alias("k"))
    group = Window.partitionBy(*KEYS)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("n", F.sum("k").over(group)).withColumn("end", F.sum("k").over(upto)).withColumn("start", F.col("end") - F.col("k"))
    h = F.lit(p) * (F.col("n") - 1)
    low, high = F.floor(h), F.least(F.floor(h) + 1, F.col("n") - 1)
    holds = lambda r: (F.col("start") <= r) & (r < F.col("end"))
    wanted = materialize(bins.where(holds(low) | holds(high)).select(*KEYS, "bin", "n", F.col("start").alias("before")), "bins")
    values = read_table(spark, f"{path}/bars", BARS).select(*KEYS, "bin", "spread")
    counts = match_keys(values, wanted, [*KEYS, "bin"], "inner").groupBy(*KEYS, "n", "before", "bin", "spread").agg(F.count(F.lit(1)).alias("k"))
    within = Window.partitionBy(*KEYS, "bin").orderBy("spread").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("end", F.col("before") + F.sum("k").over(within)).withColumn("start", F.col("end") - F.col("k"))
    picked = ranked.groupBy(*KEYS, "n").agg(F.max(F.when(holds(low), F.col("spread"))).alias("a"), F.max(F.when(holds(high), F.col("spread"))).alias("z"))
    return picked.select(*KEYS, (F.col("a") + (F.col("z") - F.col("a")) * (h - low)).alias("spread_ticks_p95"))


def calibration(
    spark: SparkSession, path: str, specs: Mapping[str, tuple[float, float]] = INSTRUMENT_SPECS, calibrated_at: Column | None = None
) -> DataFrame:
    """What ``costs.calibrate`` gives for all bars filed so far; no rows while there are none."""
    parts = read_table(spark, f"{path}/parts", PARTS)
    before = F.last("last_close", ignorenulls=True).over(
        Window.partitionBy(*KEYS).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    )
    between = parts.select(*KEYS, (F.log("first_close") - F.log(before)).alias("ret_mean")).where("ret_mean is not null")
    between = between.select(*KEYS, F.lit(1).cast("long").alias("n_ret"), "ret_mean", F.lit(0.0).alias("ret_m2"))
    returns = parts.select(*KEYS, "n_ret", "ret_mean", "ret_m2").unionByName(between)
    spreads = _spread_of(parts, "n", "spread_mean", "spread_m2", "spread")
    sigma = _spread_of(returns, "n_ret", "ret_mean", "ret_m2", "ret")
    sums = parts.groupBy(*KEYS).agg(
        (F.sum("close_sum") / F.sum("n_close")).alias("price"),
        F.greatest(F.sum("volume_sum") / F.sum("n_volume"), F.lit(1.0)).alias("liquidity"),
        F.sum("n").alias("n_samples"),
    )
    stats = sums.join(spreads, KEYS).join(sigma, KEYS, "left").join(_percentile(spark, path, P95), KEYS)
    stats = stats.withColumn("sigma", F.coalesce(F.sqrt("ret_var"), F.lit(0.0)))
    stats = stats.withColumnsRenamed({"spread_mean": "spread_ticks_mean", "spread_var": "slippage_var"})
    return calibration_rows(stats, specs, calibrated_at)
