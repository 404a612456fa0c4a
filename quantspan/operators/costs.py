"""Execution cost: calibration per instrument and hour, and the cost of orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.config import DEFAULT_SPEC, INSTRUMENT_SPECS
from quantspan.functions.prices import execution_cost
from quantspan.functions.quantile import exact_percentile
from quantspan.operators.returns import bar_returns
from quantspan.plans.blocks import DAY
from quantspan.sources.tables import latest_per_key

# Share of the bar range taken as spread, and the two impact coefficients.
SPREAD_SHARE = 0.10
ETA_COEF = 0.10
GAMMA_COEF = 0.10


def spec_columns(
    instrument: Column, specs: Mapping[str, tuple[float, float]] = INSTRUMENT_SPECS
) -> tuple[Column, Column]:
    """(tick size, tick value) of an instrument, with a default for unknown ones."""
    out = []
    for i in (0, 1):
        pairs = [F.lit(x) for k, v in specs.items() for x in (k, float(v[i]))]
        out.append(F.coalesce(F.create_map(*pairs)[instrument], F.lit(DEFAULT_SPEC[i])))
    return out[0], out[1]


def spread_ticks(specs: Mapping[str, tuple[float, float]] = INSTRUMENT_SPECS) -> Column:
    """The spread that a bar's range stands for, in ticks, one at least."""
    tick, _ = spec_columns(F.col("instrument"), specs)
    return F.greatest(F.lit(1.0), SPREAD_SHARE * ((F.col("high") - F.col("low")) / tick))


def calibrate(
    bars: DataFrame,
    specs: Mapping[str, tuple[float, float]] = INSTRUMENT_SPECS,
    calibrated_at: Column | None = None,
    seconds: int = 30 * DAY,
) -> DataFrame:
    """Spread and impact parameters per (instrument, UTC hour).

    Log returns run from bar to bar within the hour group, across days. The 95th percentile of
    the spread is exact (see ``exact_percentile``).
    """
    keys = ["instrument", "hour_utc"]
    rows = bar_returns(bars.withColumn("hour_utc", F.hour("ts")), keys, seconds).withColumn("spread", spread_ticks(specs))
    stats = rows.groupBy(*keys).agg(
        F.avg("spread").alias("spread_ticks_mean"),
        F.var_pop("spread").alias("slippage_var"),
        F.coalesce(F.stddev_pop("log_ret"), F.lit(0.0)).alias("sigma"),
        F.avg("close").alias("price"),
        F.greatest(F.avg("volume"), F.lit(1.0)).alias("liquidity"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    p95 = exact_percentile(rows, keys, "spread", 0.95, "spread_ticks_p95")
    return calibration_rows(stats.join(p95, keys), specs, calibrated_at)


def calibration_rows(stats: DataFrame, specs: Mapping[str, tuple[float, float]], calibrated_at: Column | None = None) -> DataFrame:
    """Parameters from the statistics of an instrument and hour."""
    impact = F.col("sigma") * F.col("price") / F.col("liquidity")
    return stats.select(
        "instrument",
        "hour_utc",
        (calibrated_at if calibrated_at is not None else F.lit(None).cast("timestamp")).alias("ts"),
        "spread_ticks_mean",
        "spread_ticks_p95",
        (ETA_COEF * impact).alias("impact_eta"),
        (GAMMA_COEF * impact).alias("impact_gamma"),
        "slippage_var",
        "n_samples",
        spec_columns(F.col("instrument"), specs)[1].alias("tick_value"),
    )


def latest_calibration(calibrations: DataFrame) -> DataFrame:
    return latest_per_key(calibrations, ["instrument", "hour_utc"], ["ts"])


def order_cost(
    orders: DataFrame,
    calibrations: DataFrame,
    size: str = "size",
    horizon: float = 1.0,
    missing: str = "null",
) -> DataFrame:
    """Orders (instrument, hour_utc, size, …) with their expected ``cost``.

    Without a calibration the cost is NULL, 0 (``missing="zero"``) or an error
    (``missing="error"``). The join is left to the optimiser: calibrations broadcast while they
    are small, and a hot instrument is split by the adaptive skew join otherwise.
    """
    cal = latest_calibration(calibrations).select(
        "instrument", "hour_utc", "spread_ticks_mean", "tick_value", "impact_eta", "impact_gamma"
    )
    cost = execution_cost(
        F.col(size),
        F.col("spread_ticks_mean"),
        F.col("tick_value"),
        F.col("impact_eta"),
        F.col("impact_gamma"),
        horizon,
    )
    if missing == "zero":
        cost = F.coalesce(cost, F.lit(0.0))
    elif missing == "error":
        cost = F.when(F.col("impact_eta").isNotNull(), cost).otherwise(
            F.raise_error(F.concat(F.lit("no calibration for "), "instrument", F.lit(" hour "), "hour_utc")).cast("double")
        )
    return (
        orders.join(cal, ["instrument", "hour_utc"], "left")
        .withColumn("cost", cost)
        .drop("spread_ticks_mean", "tick_value", "impact_eta", "impact_gamma")
    )
