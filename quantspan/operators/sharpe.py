"""Return moments per config and the Sharpe statistics built on them.

The panel is scanned once into centred moments per (sleeve, config, cell), where a cell is the
overlap of one cross-validation group and one symmetric-partition block. Everything after that
(any combination of groups or blocks) merges moments and never touches returns again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.functions.normal import norm_cdf, norm_ppf
from quantspan.plans.blocks import array_split_block

EULER_GAMMA = 0.5772156649015329


def series_length(panel: DataFrame) -> DataFrame:
    """Observations per sleeve (``t`` is dense from 0)."""
    return panel.groupBy("sleeve_id").agg((F.max("t") + 1).alias("n_obs"))


def cell_moments(panel: DataFrame, n_groups: int, n_blocks: int) -> DataFrame:
    """One row per (sleeve, config) with the array of its cells' moments.

    The array has at most ``n_groups + n_blocks - 1`` entries. Sums are taken map-side first, so
    a hot sleeve or config only sends its cells. A panel that carries its ``n_obs`` needs no join.
    """
    sized = panel if "n_obs" in panel.columns else panel.join(series_length(panel), "sleeve_id")
    cells = (
        sized.select(
            "sleeve_id",
            "config_id",
            "ret",
            array_split_block(F.col("t"), F.col("n_obs"), n_groups).alias("grp"),
            array_split_block(F.col("t"), F.col("n_obs"), n_blocks).alias("blk"),
        )
        .groupBy("sleeve_id", "config_id", "grp", "blk")
        .agg(
            F.count("ret").alias("n"),
            F.avg("ret").alias("mean"),
            F.var_pop("ret").alias("v"),
            F.skewness("ret").alias("s"),
            F.kurtosis("ret").alias("k"),
        )
        .withColumn("m2", F.col("v") * F.col("n"))
        .withColumn("m3", F.coalesce(F.col("s") * F.pow("m2", F.lit(1.5)) / F.sqrt("n"), F.lit(0.0)))
        .withColumn("m4", F.coalesce((F.col("k") + 3) * F.col("m2") * F.col("m2") / F.col("n"), F.lit(0.0)))
    )
    return cells.groupBy("sleeve_id", "config_id").agg(
        F.array_sort(F.collect_list(F.struct("grp", "blk", "n", "mean", "m2", "m3", "m4"))).alias("cells")
    )


def _total(cells: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + term(c))


def merged_mean(cells: Column) -> tuple[Column, Column]:
    n = _total(cells, lambda c: c["n"].cast("double"))
    return n, _total(cells, lambda c: c["n"] * c["mean"]) / n


def sharpe_of(n: Column, mean: Column, m2: Column) -> Column:
    """mean / sample deviation; 0 for fewer than two values or a constant series."""
    sd = F.sqrt(F.try_divide(m2, n - 1))
    flat = F.lit(1e-12) * F.greatest(F.abs(mean), F.lit(1e-300))
    return F.when((n > 1) & (sd > flat), mean / sd).otherwise(F.lit(0.0))


def with_moments(df: DataFrame, cells: Column, higher: bool = False) -> DataFrame:
    """Add n, mean, m2 (and m3, m4) of the merged ``cells`` and their ``sharpe``."""
    out = df.withColumn("cells_", cells)
    c = F.col("cells_")
    n, mean = merged_mean(c)
    out = out.withColumn("n", n).withColumn("mean", mean)
    d = lambda x: x["mean"] - F.col("mean")
    out = out.withColumn("m2", _total(c, lambda x: x["m2"] + x["n"] * d(x) * d(x)))
    if higher:
        out = out.withColumn(
            "m3", _total(c, lambda x: x["m3"] + 3 * x["m2"] * d(x) + x["n"] * d(x) * d(x) * d(x))
        ).withColumn(
            "m4",
            _total(
                c,
                lambda x: x["m4"]
                + 4 * x["m3"] * d(x)
                + 6 * x["m2"] * d(x) * d(x)
                + x["n"] * d(x) * d(x) * d(x) * d(x),
            ),
        )
    return out.withColumn("sharpe", sharpe_of(F.col("n"), F.col("mean"), F.col("m2"))).drop("cells_")


def config_stats(moments: DataFrame) -> DataFrame:
    """Per config: n_obs, mean, std, sharpe, population skewness and (non-excess) kurtosis."""
    m = with_moments(moments, F.col("cells"), higher=True)
    n, m2 = F.col("n"), F.col("m2")
    return m.select(
        "sleeve_id",
        "config_id",
        n.cast("long").alias("n_obs"),
        F.col("mean"),
        F.coalesce(F.sqrt(F.try_divide(m2, n - 1)), F.lit(0.0)).alias("std"),
        "sharpe",
        F.when((n > 2) & (m2 > 0), F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5))).otherwise(0.0).alias("skew"),
        F.when((n > 3) & (m2 > 0), n * F.col("m4") / (m2 * m2)).otherwise(3.0).alias("kurt"),
    )


def sharpe_moments(panel: DataFrame) -> DataFrame:
    """``config_stats`` straight from returns, one aggregation."""
    n, sd = F.col("n_obs"), F.coalesce(F.col("std"), F.lit(0.0))
    flat = F.lit(1e-12) * F.greatest(F.abs("mean"), F.lit(1e-300))
    return (
        panel.groupBy("sleeve_id", "config_id")
        .agg(
            F.count("ret").alias("n_obs"),
            F.avg("ret").alias("mean"),
            F.stddev_samp("ret").alias("std"),
            F.skewness("ret").alias("skew"),
            F.kurtosis("ret").alias("kurt"),
        )
        .select(
            "sleeve_id",
            "config_id",
            "n_obs",
            "mean",
            sd.alias("std"),
            F.when(sd > flat, F.col("mean") / sd).otherwise(0.0).alias("sharpe"),
            F.when((n > 2) & F.col("skew").isNotNull(), F.col("skew")).otherwise(0.0).alias("skew"),
            F.when((n > 3) & F.col("kurt").isNotNull(), F.col("kurt") + 3).otherwise(3.0).alias("kurt"),
        )
    )


def psr_z(sr: Column, sr0: Column, n: Column, skew: Column, kurt: Column) -> Column:
    spread = F.greatest(F.lit(1e-12), 1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    return (sr - sr0) * F.sqrt(n - 1) / F.sqrt(spread)


def probabilistic_sharpe(sr: Column, sr0: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true Sharpe exceeds ``sr0``; 0 below two observations."""
    return F.when(n < 2, F.lit(0.0)).otherwise(norm_cdf(psr_z(sr, sr0, n, skew, kurt)))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected best Sharpe of ``trials`` skill-less configs whose Sharpes have ``variance``."""
    usable = (trials >= 2) & (variance > 0)
    safe = F.when(usable, trials.cast("double")).otherwise(F.lit(2.0))
    best = (1 - EULER_GAMMA) * norm_ppf(1 - 1 / safe) + EULER_GAMMA * norm_ppf(1 - 1 / (safe * math.e))
    return F.when(usable, F.sqrt(variance) * best).otherwise(F.lit(0.0))


def deflated_sharpe(stats: DataFrame, trials: Column, variance: Column | None = None) -> DataFrame:
    """Add ``sr0``, ``z`` and ``dsr`` to rows with n_obs, sharpe, skew, kurt."""
    n = F.col("n_obs")
    var = F.coalesce(variance, F.lit(0.0)) if variance is not None else 1.0 / F.greatest(F.lit(1), n - 1)
    return (
        stats.withColumn("sr0", expected_max_sharpe(var, trials))
        .withColumn("z", psr_z(F.col("sharpe"), F.col("sr0"), n, F.col("skew"), F.col("kurt")))
        .withColumn("dsr", F.when(n < 2, F.lit(0.0)).otherwise(norm_cdf(F.col("z"))))
    )
