"""Full anti-overfitting validation of many sleeves at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.functions.prices import go_verdict
from quantspan.operators.chain import append_events
from quantspan.operators.crossval import n_paths, path_sharpes
from quantspan.operators.pbo import pbo
from quantspan.operators.returns import DEFAULT_LOOKBACKS, max_drawdown, strategy_returns
from quantspan.operators.sharpe import cell_moments, config_stats, deflated_sharpe
from quantspan.plans.blocks import DAY
from quantspan.session import materialize
from quantspan.sources.logs import append_log, read_log


def best_config(stats: DataFrame) -> DataFrame:
    """Per sleeve: the config of highest Sharpe (lowest id on ties), trials and Sharpe variance."""
    return (
        stats.groupBy("sleeve_id")
        .agg(
            F.max(F.struct("sharpe", (-F.col("config_id")).alias("neg"))).alias("b"),
            F.count(F.lit(1)).alias("n_configs"),
            F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("sr_variance"),
        )
        .select("sleeve_id", (-F.col("b.neg")).cast("int").alias("candidate"), "n_configs", "sr_variance")
    )


def dsr_table(moments: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Deflated Sharpe of each sleeve's candidate config, with its ingredients."""
    stats = config_stats(moments)
    chosen = best_config(stats)
    if candidates is not None:
        chosen = chosen.drop("candidate").join(candidates.select("sleeve_id", "candidate"), "sleeve_id")
    rows = stats.join(
        chosen.withColumnRenamed("candidate", "config_id"), ["sleeve_id", "config_id"]
    )
    return deflated_sharpe(rows, F.col("n_configs"), F.col("sr_variance"))


def run_validation(
    panel: DataFrame,
    candidates: DataFrame | None = None,
    n_groups: int = 6,
    k_test: int = 2,
    n_partitions: int = 10,
    embargo_pct: float = 0.01,
    purge_pct: float = 0.02,
    stage: bool = True,
) -> DataFrame:
    """One metrics row per sleeve of a (sleeve_id, config_id, t, ret) panel.

    The panel is read for its length, its moments and the candidates' drawdown; with ``stage``
    it is written once instead of being derived three times. The candidates, one row per sleeve,
    are written too, so that selecting their returns is a broadcast while they are few.
    """
    if stage:
        panel = materialize(panel, "panel")
    moments = cell_moments(panel, n_groups, n_partitions)
    if stage:
        moments = materialize(moments, "moments")
    dsr = dsr_table(moments, candidates)
    if stage:
        dsr = materialize(dsr, "dsr")
    chosen = dsr.select("sleeve_id", "config_id")
    paths = (
        path_sharpes(moments.join(chosen, ["sleeve_id", "config_id"], "left_semi"), n_groups, k_test)
        .groupBy("sleeve_id")
        .agg(
            F.avg("path_sharpe").alias("sharpe_mean"),
            F.coalesce(F.stddev_samp("path_sharpe"), F.lit(0.0)).alias("sharpe_std"),
        )
    )
    dd = max_drawdown(panel.join(chosen, ["sleeve_id", "config_id"], "left_semi"), ["sleeve_id"])
    out = (
        dsr.select("sleeve_id", F.col("config_id").alias("candidate_col"), "n_configs", "dsr")
        .join(paths, "sleeve_id")
        .join(pbo(moments, n_partitions), "sleeve_id")
        .join(dd, "sleeve_id")
    )
    return out.select(
        "sleeve_id",
        F.lit(n_paths(n_groups, k_test)).alias("n_paths"),
        "sharpe_mean",
        "sharpe_std",
        "dsr",
        "pbo",
        "n_combos",
        "median_logit",
        F.col("max_dd").alias("max_dd_pct"),
        F.when(F.col("max_dd") > 0, F.col("sharpe_mean") / F.col("max_dd")).alias("calmar"),
        F.lit(embargo_pct).alias("embargo_pct"),
        F.lit(purge_pct).alias("purge_pct"),
        "candidate_col",
        "n_configs",
    )


def validate_sleeves(
    bars: DataFrame, lookbacks: Sequence[int] = DEFAULT_LOOKBACKS, seconds: int = DAY, **params
) -> DataFrame:
    """Bars → strategy panel → validation row with its GO / NO-GO verdict, per instrument."""
    metrics = run_validation(strategy_returns(bars, lookbacks, seconds), **params)
    return metrics.withColumn("verdict", go_verdict(F.col("dsr"), F.col("pbo")))


def record_backtests(
    metrics: DataFrame, log: str, ts: Column, commit: str = "untracked", config: Column | None = None, chain_id: str = "backtests"
) -> DataFrame:
    """Validation rows as the result table keeps them, each with the log event it was recorded by.

    An event a sleeve, in name order, goes on the end of the chain in ``log``; its number is the row's
    ``audit_id``. ``config`` (JSON) defaults to the settings of the run.
    """
    rows = materialize(metrics.withColumn("ts", ts), "metrics")
    settings = F.to_json(F.struct("candidate_col", "n_configs", "n_combos", "median_logit", "embargo_pct", "purge_pct"))
    events = backtest_events(rows, commit, "ts").withColumn("chain_id", F.lit(chain_id))
    before = read_log(rows.sparkSession, log)
    linked = materialize(append_events(events, ["event_key"], "event_key", before, canonical=True), "linked")
    append_log(linked, log)
    recorded = linked.select(F.col("event_key").alias("sleeve_id"), F.col("seq").alias("audit_id"))
    return rows.join(recorded, "sleeve_id").select(
        "sleeve_id", F.lit(commit).alias("git_commit"), "ts", "n_paths", "sharpe_mean", "sharpe_std", "dsr", "pbo", "max_dd_pct", "calmar",
        "embargo_pct", "purge_pct", (settings if config is None else config).alias("config_json"), "audit_id",
    )


def backtest_events(metrics: DataFrame, commit: str | Column = "untracked", *more: str) -> DataFrame:
    """The log events that record validation results, with ``more`` columns of theirs."""
    commit = F.lit(commit) if isinstance(commit, str) else commit
    return metrics.select(
        *more,
        F.lit("agent:research").alias("actor"),
        F.lit("backtest").alias("event_type"),
        F.col("sleeve_id").alias("event_key"),
        F.to_json(
            F.struct("dsr", commit.alias("git_commit"), "pbo", "sleeve_id")
        ).alias("payload"),
    )
