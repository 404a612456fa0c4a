"""Rolling windows, their delay embedding and volatility label, features of diagrams, and the signal on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.operators.costs import spec_columns
from quantspan.plans.blocks import DAY
from quantspan.sources.bars import positioned


def decision_windows(bars: DataFrame, warmup: int = 100, step: int = 25, seconds: int = DAY) -> DataFrame:
    """One row per decision bar with the closes of the ``warmup`` bars before it.

    Decisions are bars ``warmup, warmup + step, …`` short of the last one. Each bar is sent to
    the few decisions that see it, so a group is one window and never a whole instrument.
    Output: instrument, pos, ts, close, n, is_last, closes.
    """
    pos = positioned(bars.select("instrument", "ts", "close"), seconds=seconds, total="n")
    p = F.col("pos")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((p - warmup) / step))
    last = F.least(F.floor(p / step), F.floor((F.col("n") - 2 - warmup) / step))
    rows = (
        pos.where(last >= first)
        .withColumn("d", F.explode(F.sequence(first, last)))
        .withColumn("at", F.col("d") * step + warmup)
        .where(F.col("pos") >= F.col("at") - warmup)
    )
    anchor = F.col("pos") == F.col("at")
    return (
        rows.groupBy("instrument", F.col("at").alias("pos"))
        .agg(
            F.max(F.when(anchor, F.col("ts"))).alias("ts"),
            F.max(F.when(anchor, F.col("close"))).alias("close"),
            F.max("n").alias("n"),
            F.array_sort(F.collect_list(F.when(~anchor, F.struct("pos", "close")))).alias("w"),
        )
        .withColumn("closes", F.transform("w", lambda x: x["close"]))
        .withColumn("is_last", F.col("pos") + step >= F.col("n") - 1)
        .drop("w")
    )


def log_returns(closes: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(closes) - 1), lambda i: F.log(F.get(closes, i)) - F.log(F.get(closes, i - 1))
    )


def takens(series: Column, dim: int = 3, delay: int = 1) -> Column:
    """Delay embedding: array of points [x_t, x_{t+delay}, …]."""
    if dim < 1 or delay < 1:
        raise ValueError("dim and delay must be at least 1")
    last = F.size(series) - 1 - (dim - 1) * delay
    return F.transform(
        F.sequence(F.lit(0), last), lambda t: F.array(*[F.get(series, t + k * delay) for k in range(dim)])
    )


def embedded_windows(windows: DataFrame, split: float = 0.5, dim: int = 3, delay: int = 1) -> DataFrame:
    """Add the reference and current clouds of each window (first and last part of its returns)."""
    rows = windows.withColumn("returns", log_returns(F.col("closes")))
    size = F.size("returns")
    cut = F.floor(size * split).cast("int")
    long_enough = F.least(cut, size - cut) >= max(dim + 1, (dim - 1) * delay + 2)
    rows = rows.withColumn(
        "returns",
        F.when(long_enough, F.col("returns")).otherwise(F.raise_error(F.lit("window too short to embed"))),
    )
    return rows.withColumn("ref", takens(F.slice("returns", F.lit(1), cut), dim, delay)).withColumn(
        "cur", takens(F.slice("returns", cut + 1, size - cut), dim, delay)
    )


def diagram_features(h0: Column, h1: Column, prefix: str = "") -> list[Column]:
    """Mean, variance and entropy of the lifetimes (loops if there are any), counts, longest loop."""
    life = lambda d: F.transform(d, lambda x: x["death"] - x["birth"])
    focus = F.when(F.size(h1) > 0, life(h1)).otherwise(life(h0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(focus)
    mean = F.when(n > 0, total(focus) / n).otherwise(0.0)
    var = F.when(n > 0, total(F.transform(focus, lambda x: (x - mean) * (x - mean))) / n).otherwise(0.0)
    alive = F.filter(focus, lambda x: x > 0)
    mass = total(alive)
    entropy = F.when(
        F.size(alive) > 0, -total(F.transform(alive, lambda x: x / mass * F.log(x / mass)))
    ).otherwise(0.0)
    return [
        mean.alias(f"{prefix}mu"),
        var.alias(f"{prefix}var"),
        entropy.alias(f"{prefix}persistence_entropy"),
        F.size(h0).alias(f"{prefix}n_h0"),
        F.size(h1).alias(f"{prefix}n_h1"),
        F.coalesce(F.array_max(life(h1)), F.lit(0.0)).alias(f"{prefix}max_lifetime_h1"),
    ]


def _steps(closes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(closes) - 1), lambda i: F.get(closes, i) - F.get(closes, i - 1))


def _spread(values: Column) -> Column:
    """Population standard deviation of an array."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(values) / F.size(values)
    return F.sqrt(total(F.transform(values, lambda x: (x - mean) * (x - mean))) / F.size(values))


def volatility_labels(windows: DataFrame, lookback: int = 20) -> DataFrame:
    """Windows with ``regime_label``: ``shift`` where the last ``lookback`` closes spread more than all."""
    recent = F.slice("closes", F.greatest(F.size("closes") - lookback, F.lit(0)) + 1, F.lit(lookback))
    wilder = _spread(_steps(recent)) > _spread(_steps(F.col("closes")))
    return windows.withColumn("regime_label", F.when(wilder, "shift").otherwise("stable"))


# reward/risk, confidence and size of the baseline signal.
SIGNAL_RR, SIGNAL_CONFIDENCE, SIGNAL_SIZE = 2.5, 0.65, 2


def regime_signals(rows: DataFrame, lookback: int = 20) -> DataFrame:
    """Signal per decision row (closes, close, regime_label): follow momentum in a stable regime,
    fade it after a shift. Rows without a usable risk are dropped.
    """
    tick, tick_value = spec_columns(F.col("instrument"))
    recent = F.slice("closes", F.size("closes") - lookback + 1, F.lit(lookback))
    steps = F.transform(F.sequence(F.lit(1), F.lit(lookback - 1)), lambda i: F.get(recent, i) - F.get(recent, i - 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("steps_", steps).withColumn("mean_", total(F.col("steps_")) / (lookback - 1))
    spread = F.sqrt(
        total(F.transform("steps_", lambda x: (x - F.col("mean_")) * (x - F.col("mean_")))) / (lookback - 1)
    )
    mom = F.col("close") - F.get(recent, F.lit(0))
    go_long = F.when(F.col("regime_label") == "shift", mom < 0).otherwise(mom >= 0)
    rows = (
        rows.withColumn("sign", F.when(go_long, 1).otherwise(-1))
        .withColumn("dist", F.greatest(tick, 2.0 * spread))
        .withColumn("tick_size", tick)
        .withColumn("point_value", tick_value / tick)
    )
    cents = lambda x: F.bround(x, 2)
    return (
        rows.withColumn("entry_price", cents(F.col("close")))
        .withColumn("stop_loss", cents(F.col("close") - F.col("sign") * F.col("dist")))
        .withColumn("take_profit_1", cents(F.col("close") + SIGNAL_RR * F.col("sign") * F.col("dist")))
        .withColumn("risk_per_contract_usd", cents(F.col("dist") * F.col("point_value")))
        .withColumn("direction", F.when(F.col("sign") == 1, "LONG").otherwise("SHORT"))
        .where((F.col("risk_per_contract_usd") > 0) & (F.size("closes") >= lookback))
        .drop("steps_", "mean_", "dist")
    )
