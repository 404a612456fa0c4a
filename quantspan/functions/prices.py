"""Scalar expressions on prices, signals and accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_reward(entry: Column, stop: Column, target: Column) -> Column:
    risk = F.abs((entry - stop).cast("double"))
    reward = F.abs((target - entry).cast("double"))
    return F.when(risk > 0, reward / risk).otherwise(F.lit(0.0))


def daily_pnl_pct(pnl: Column, start: Column) -> Column:
    start, pnl = start.cast("double"), pnl.cast("double")
    return F.when(start == 0, F.lit(0.0)).otherwise(pnl / start * 100)


# From which drawdown a gate level holds, and its size multiplier; below them all is normal.
GATE_LADDER = ((0.20, "halt", 0.0), (0.15, "dd15", 0.125), (0.10, "dd10", 0.25), (0.05, "dd5", 0.5))
NORMAL, NORMAL_MULT = "normal", 1.0


def drawdown_level(dd: Column) -> Column:
    """Gate level of a drawdown given as a fraction; negative drawdown counts as none."""
    steps = [F.when(dd >= floor, F.lit(level)) for floor, level, _ in GATE_LADDER]
    return F.coalesce(*steps, F.lit(NORMAL))


def drawdown_pct(dd: Column) -> Column:
    """The drawdown at six decimals, a half decided by the product in binary (as SQL engines round doubles), not by its decimal digits."""
    return F.round(dd * 1e6) / 1e6


def sizing_mult(level: Column) -> Column:
    """The size multiplier of a gate level."""
    steps = [F.when(level == name, F.lit(mult)) for _, name, mult in GATE_LADDER]
    return F.coalesce(*steps, F.lit(NORMAL_MULT))


def apply_sizing(size: Column, mult: Column) -> Column:
    """Gate a size: never enlarges, truncates, and a missing gate leaves the size alone."""
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(mult, F.lit(1.0))))
    return F.floor(size * bounded).cast("int")


def shift_posterior(d_topo: Column) -> Column:
    return F.round(F.when(d_topo > 0, 1 - F.exp(-d_topo)).otherwise(F.lit(0.0)), 6)


def regime_label(d_topo: Column, threshold: float = 0.02) -> Column:
    return F.when(d_topo > threshold, F.lit("shift")).otherwise(F.lit("stable"))


def go_verdict(dsr: Column, pbo: Column, min_dsr: float = 0.0, max_pbo: float = 0.5) -> Column:
    return (
        F.when(dsr.isNull() | pbo.isNull(), F.lit("PENDING"))
        .when((dsr > min_dsr) & (pbo < max_pbo), F.lit("GO"))
        .otherwise(F.lit("NO-GO"))
    )


def execution_cost(size: Column, spread: Column, tick_value: Column, eta: Column, gamma: Column, horizon: float = 1.0) -> Column:
    """Expected cost in USD: half the spread plus permanent and temporary impact."""
    x = F.abs(size)
    return 0.5 * spread * tick_value * x + gamma * x * x + eta * x * x / F.lit(max(horizon, 1e-9))


def ny_time(ts: Column) -> Column:
    """Time of day in New York as a sortable string."""
    return F.date_format(F.from_utc_timestamp(ts, "America/New_York"), "HH:mm:ss.SSSSSS")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
