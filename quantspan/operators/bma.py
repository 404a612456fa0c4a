"""Bayesian model averaging over out-of-sample return series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspan.operators.sharpe import sharpe_of


def bma_weights(
    returns: DataFrame,
    prior: Mapping[str, float] | None = None,
    prior_mean_std: float | None = None,
    ddof: int = 1,
    var_floor: float = 1e-12,
    run_keys: Sequence[str] = (),
    run_id: str = "run",
) -> DataFrame:
    """Posterior weight and evidence of each sleeve of (``run_keys``, sleeve_id, ret).

    Evidence is one-sided: only a positive posterior mean adds to it. Without ``prior_mean_std``
    the prior variance equals the sample variance. Missing priors count 0, an all-zero prior
    becomes uniform, a negative one is an error. Returns are reduced to moments before anything
    is ordered or normalised, so the windows see one row per sleeve.
    """
    if prior is not None and any(v < 0 for v in prior.values()):
        raise ValueError("priors must not be negative")
    keys = list(run_keys)
    ok = F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") != float("inf"))
    ret = F.when(ok, F.col("ret"))
    rows = (
        returns.groupBy(*keys, "sleeve_id")
        .agg(F.count(ret).alias("n_obs"), F.avg(ret).alias("mu"), (F.var_pop(ret) * F.count(ret)).alias("m2"))
    )
    if keys:
        rows = rows.withColumn("run_id", F.sha2(F.concat_ws("|", F.lit(run_id), *keys), 256))
    else:
        rows = rows.withColumn("run_id", F.lit(run_id))
    run = Window.partitionBy("run_id")
    if prior is None:
        raw = F.lit(1.0)
    else:
        pairs = [F.lit(x) for kv in prior.items() for x in (kv[0], float(kv[1]))]
        raw = F.coalesce(F.create_map(*pairs)[F.col("sleeve_id")] if pairs else F.lit(0.0), F.lit(0.0))
    rows = rows.withColumn("raw", raw).withColumn("raw_sum", F.sum("raw").over(run))
    rows = rows.withColumn(
        "prior",
        F.when(F.col("raw_sum") > 0, F.col("raw") / F.col("raw_sum")).otherwise(1.0 / F.count(F.lit(1)).over(run)),
    )
    n = F.col("n_obs").cast("double")
    enough = F.col("n_obs") >= 2
    var = F.greatest(F.col("m2") / (n - ddof), F.lit(var_floor))
    tau2 = F.lit(prior_mean_std**2) if prior_mean_std is not None else var
    precision = n / var + 1 / tau2
    post_mean = n * F.col("mu") / var / precision
    rows = (
        rows.withColumn("post_mean", F.when(enough, post_mean).otherwise(0.0))
        .withColumn("post_z", F.when(enough, post_mean * F.sqrt(precision)).otherwise(0.0))
        .withColumn("log_evidence", 0.5 * F.pow(F.greatest("post_z", F.lit(0.0)), F.lit(2.0)))
        .withColumn(
            "sharpe",
            F.when(enough, sharpe_of(n, F.col("mu"), F.col("m2") * (n - 1) / (n - ddof))).otherwise(0.0),
        )
        .withColumn("log_w", F.when(F.col("prior") > 0, F.log("prior") + F.col("log_evidence")))
    )
    unnormalised = F.coalesce(F.exp(F.col("log_w") - F.max("log_w").over(run)), F.lit(0.0))
    rows = rows.withColumn("u", unnormalised)
    return rows.select(
        "run_id",
        *keys,
        "sleeve_id",
        (F.col("u") / F.sum("u").over(run)).alias("weight"),
        "prior",
        "log_evidence",
        "post_mean",
        "post_z",
        "sharpe",
        "n_obs",
    )


def bma_events(weights: DataFrame, actor: str = "agent:signal:bma") -> DataFrame:
    """One log event per run holding its weights to eight digits, sleeves in name order."""
    pair = F.struct("sleeve_id", F.round("weight", 8).alias("weight"))
    return weights.groupBy("run_id").agg(F.sort_array(F.collect_list(pair)).alias("w")).select(
        F.lit(actor).alias("actor"),
        F.lit("bma").alias("event_type"),
        F.col("run_id").alias("event_key"),
        F.to_json(F.struct("run_id", F.map_from_entries("w").alias("weights"))).alias("payload"),
    )
