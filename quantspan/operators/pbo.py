"""Probability of backtest overfitting by combinatorially symmetric cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.operators.sharpe import sharpe_of
from quantspan.plans.combinations import with_masks

def _block_arrays(moments: DataFrame, n_partitions: int) -> DataFrame:
    """Cells merged to arrays n, mean and m2 with one entry per block."""
    blocks = F.sequence(F.lit(0), F.lit(n_partitions - 1))
    of = lambda b: F.filter("cells", lambda x: x["blk"] == b)
    rows = moments.select("sleeve_id", "config_id", F.transform(blocks, of).alias("per"))
    total = lambda cells, term: F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + term(x))
    rows = rows.withColumn("bn", F.transform("per", lambda p: total(p, lambda x: x["n"].cast("double"))))
    rows = rows.withColumn("bs", F.transform("per", lambda p: total(p, lambda x: x["n"] * x["mean"])))
    rows = rows.withColumn("bm", F.transform(F.arrays_zip("bs", "bn"), lambda z: z["bs"] / z["bn"]))
    spread = lambda p, m: total(p, lambda x: x["m2"] + x["n"] * (x["mean"] - m) * (x["mean"] - m))
    rows = rows.withColumn("b2", F.transform(F.arrays_zip("per", "bm"), lambda z: spread(z["per"], z["bm"])))
    return rows.drop("per", "bs")


def _is_oos(moments: DataFrame, n_partitions: int) -> DataFrame:
    """In-sample and out-of-sample Sharpe per (sleeve, config, mask).

    Cells are merged to one (n, mean, m2) per block first. A mask (every choice of half the blocks, by its
    rank) then adds up its blocks' terms, written out one by one so that they compile into plain arithmetic.
    """
    if n_partitions % 2 or not 2 <= n_partitions <= 62:
        raise ValueError("n_partitions must be even and fit a mask")
    rows = _block_arrays(moments, n_partitions)
    at = lambda name, b: F.get(F.col(name), F.lit(b))
    flat = rows.select(
        "sleeve_id",
        "config_id",
        *[at(name, b).alias(f"{name}{b}") for name in ("bn", "bm", "b2") for b in range(n_partitions)],
    )
    out = with_masks(flat, n_partitions, n_partitions // 2)
    for side in ("is", "oos"):
        wanted = 0 if side == "oos" else 1

        def added(term, wanted=wanted):
            bit = lambda b: F.getbit("mask", F.lit(b)) == wanted
            return sum((F.when(bit(b), term(b)).otherwise(0.0) for b in range(n_partitions)), F.lit(0.0))

        out = out.withColumn(f"{side}_n", added(lambda b: F.col(f"bn{b}")))
        out = out.withColumn(
            f"{side}_mean", added(lambda b: F.col(f"bn{b}") * F.col(f"bm{b}")) / F.col(f"{side}_n")
        )
        gap = lambda b, side=side: F.col(f"bm{b}") - F.col(f"{side}_mean")
        out = out.withColumn(
            f"{side}_m2", added(lambda b, gap=gap: F.col(f"b2{b}") + F.col(f"bn{b}") * gap(b) * gap(b))
        )
    sharpe = lambda side: sharpe_of(F.col(f"{side}_n"), F.col(f"{side}_mean"), F.col(f"{side}_m2"))
    return out.select(
        "sleeve_id", "config_id", "mask", sharpe("is").alias("is_sharpe"), sharpe("oos").alias("oos_sharpe")
    )


def cscv_logits(moments: DataFrame, n_partitions: int = 10) -> DataFrame:
    """Per combination: the in-sample winner's relative out-of-sample rank and its logit.

    The winner is an aggregate and its average rank two counts, so neither step orders the
    configs of a sleeve in one task. Ties go to the lowest config.
    """
    perf = _is_oos(moments, n_partitions)
    best = perf.groupBy("sleeve_id", "mask").agg(
        F.max(F.struct("is_sharpe", (-F.col("config_id")).alias("neg"), "oos_sharpe")).alias("b")
    )
    best = best.select("sleeve_id", "mask", (-F.col("b.neg")).alias("best_config"), F.col("b.oos_sharpe").alias("best_oos"))
    ranks = (
        perf.join(best, ["sleeve_id", "mask"])
        .groupBy("sleeve_id", "mask", "best_config")
        .agg(
            F.count(F.lit(1)).alias("n_configs"),
            (
                F.count_if(F.col("oos_sharpe") < F.col("best_oos"))
                + (F.count_if(F.col("oos_sharpe") == F.col("best_oos")) + 1) / 2
            ).alias("oos_rank"),
        )
    )
    w = F.least(F.greatest(F.col("oos_rank") / (F.col("n_configs") + 1), F.lit(1e-9)), F.lit(1 - 1e-9))
    return ranks.withColumn("w", w).withColumn("logit", F.log(F.col("w") / (1 - F.col("w"))))


def pbo(moments: DataFrame, n_partitions: int = 10) -> DataFrame:
    """One row per sleeve: pbo (share of combinations with logit <= 0), n_combos, median_logit.

    ``moments`` must have been cut with ``n_blocks = n_partitions``. Sleeves with fewer than two
    configs, or fewer observations than blocks, raise an error.
    """
    n = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    short = n < n_partitions
    moments = moments.withColumn(
        "cells",
        F.when(~short, F.col("cells")).otherwise(F.raise_error(F.lit("fewer observations than partitions"))),
    )
    return (
        cscv_logits(moments, n_partitions)
        .withColumn(
            "logit",
            F.when(F.col("n_configs") >= 2, F.col("logit")).otherwise(
                F.raise_error(F.lit("overfitting needs at least two configs"))
            ),
        )
        .groupBy("sleeve_id")
        .agg(
            F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
            F.count(F.lit(1)).alias("n_combos"),
            F.percentile("logit", 0.5).alias("median_logit"),
        )
    )
