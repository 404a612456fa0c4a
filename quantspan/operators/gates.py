"""Drawdown gates over equity curves, kill switch state and daily counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.prices import drawdown_level, drawdown_pct, sizing_mult
from quantspan.plans.blocks import DAY, PIECE_ROWS, carry_in, match_keys, previous_in_order, time_bucket
from quantspan.session import materialize
from quantspan.sources.tables import latest_per_key

KEYS = ("sleeve_id", "track")
NONE = "\u0000"


def _drawdown(peak: Column, equity: Column) -> Column:
    return F.when(peak > 0, F.greatest(F.lit(0.0), (peak - equity) / peak)).otherwise(F.lit(0.0))


def _filled(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: F.coalesce(k, F.lit(NONE)) for k in keys}) if keys else df


def _restored(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: F.when(F.col(k) != NONE, F.col(k)) for k in keys}) if keys else df


def equity_from_pnl(
    pnl: DataFrame, start: float | Column, keys: Sequence[str] = KEYS, seconds: int | None = 30 * DAY
) -> DataFrame:
    """Equity per (keys, ts) row: ``start`` plus the running sum of ``pnl``.

    Without ``seconds`` a key stays whole in a task (see ``by_length``).
    """
    if seconds is None:
        whole = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return pnl.withColumn("equity", (start if isinstance(start, Column) else F.lit(start)) + F.sum("pnl").over(whole))
    rows = _filled(pnl, keys).withColumn("__b", time_bucket("ts", seconds))
    carried = carry_in(rows, keys, "__b", {"__s": F.sum("pnl")}, {"__s0": F.sum("__s")})
    inside = Window.partitionBy(*keys, "__b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = match_keys(rows.withColumn("__run", F.sum("pnl").over(inside)), carried, [*keys, "__b"])
    start = F.lit(start) if not isinstance(start, Column) else start
    out = out.withColumn("equity", start + F.coalesce("__s0", F.lit(0) * F.col("__run")) + F.col("__run"))
    return _restored(out.drop("__b", "__run", "__s0"), keys)


def drawdown_curve(equity: DataFrame, keys: Sequence[str] = KEYS, seconds: int | None = 30 * DAY) -> DataFrame:
    """Equity rows with running ``peak_equity``, ``dd`` and the drawdown before the row.

    Time buckets of a key are scanned in parallel; the peak so far and the last equity before a
    bucket come from the buckets' totals. ``prev_dd`` is NULL on the first row of a key.
    Without ``seconds`` a key stays whole in a task (see ``by_length``).
    """
    if seconds is None:
        whole = Window.partitionBy(*keys).orderBy("ts")
        out = equity.withColumn("peak_equity", F.max("equity").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("dd", _drawdown(F.col("peak_equity"), F.col("equity")))
        return out.withColumn("prev_dd", F.lag("dd").over(whole))
    rows = _filled(equity, keys).withColumn("__b", time_bucket("ts", seconds))
    carried = carry_in(
        rows,
        keys,
        "__b",
        {"__m": F.max("equity"), "__l": F.max_by("equity", "ts")},
        {"__peak0": F.max("__m"), "__last0": F.last("__l")},
    )
    part = Window.partitionBy(*keys, "__b").orderBy("ts")
    inside = part.rowsBetween(Window.unboundedPreceding, 0)
    out = match_keys(rows.withColumn("__peak", F.max("equity").over(inside)), carried, [*keys, "__b"])
    out = out.withColumn("peak_equity", F.greatest("__peak0", "__peak"))
    out = out.withColumn("dd", _drawdown(F.col("peak_equity"), F.col("equity")))
    before = F.when(F.col("__last0").isNotNull(), _drawdown(F.col("__peak0"), F.col("__last0")))
    out = out.withColumn("prev_dd", F.coalesce(F.lag("dd").over(part), before))
    return _restored(out.drop("__b", "__peak", "__peak0", "__last0"), keys)


def gate_history(
    equity: DataFrame, keys: Sequence[str] = KEYS, scope: str = "key", seconds: int = 30 * DAY, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """``gates_of_curve`` of the drawdown curve of ``equity``."""
    return gates_of_curve(drawdown_curve(equity, keys, seconds), keys, scope, piece_rows)


def gates_of_curve(
    curve: DataFrame, keys: Sequence[str] = KEYS, scope: str = "key", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Gate row per equity row: drawdown, level, multiplier, previous level, whether it tripped.

    The previous level is that of the same key, or with ``scope="global"`` of the row written
    last for any key. That order has no key: it is cut into pieces of ``piece_rows`` rows, whose
    last levels, one row a piece, are carried over.
    """
    level = drawdown_level(F.col("dd"))
    if scope == "key":
        rows = curve.withColumn("previous_level", F.when(F.col("prev_dd").isNotNull(), drawdown_level(F.col("prev_dd"))))
    else:
        order = ["ts", *keys]
        rows = materialize(curve.select(*order, "dd", level.alias("__level")), "curve")
        rows = previous_in_order(rows, order, "__level", "previous_level", piece_rows)
    return rows.select(
        "ts",
        *keys,
        drawdown_pct(F.col("dd")).alias("current_dd_pct"),
        level.alias("gate_level"),
        sizing_mult(level).alias("sizing_mult"),
        "previous_level",
        (F.coalesce("previous_level", F.lit("normal")) != level).alias("tripped"),
    )


def gate_trips(gates: DataFrame) -> DataFrame:
    """Only the rows where the level changed, with the level they came from."""
    return gates.where("tripped").withColumn("from_level", F.coalesce("previous_level", F.lit("normal")))


def gate_trip_events(gates: DataFrame) -> DataFrame:
    """Log events of the level changes."""
    return gate_trips(gates).select(
        "ts",
        F.lit("system:dd_gate").alias("actor"),
        F.lit("gate_trip").alias("event_type"),
        F.col("gate_level").alias("event_key"),
        F.to_json(
            F.struct(
                F.col("current_dd_pct").alias("drawdown_pct"),
                "from_level",
                "sizing_mult",
                "sleeve_id",
                F.col("gate_level").alias("to_level"),
                "track",
            ),
            {"ignoreNullFields": "false"},
        ).alias("payload"),
    )


def worst_drawdown(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The largest drawdown so far per key of an equity curve with ``dd``."""
    return curve.groupBy(*keys).agg(F.max("dd").alias("max_dd_pct"))


def current_gate(gates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return latest_per_key(gates, keys, ["ts"])


def unique_equity(equity: DataFrame) -> DataFrame:
    """One row per (ts, sleeve, track)."""
    return equity.dropDuplicates(["ts", "sleeve_id", "track"])


def kill_switch_state(commands: DataFrame) -> DataFrame:
    """Current state per switch from its command log (switch_id, ts, command, reason, actor).

    The last command decides. ``trigger`` keeps its reason, ``clear`` drops it.
    """
    last = latest_per_key(commands.where(F.col("command").isin("trigger", "clear")), ["switch_id"], ["ts"])
    on = F.col("command") == "trigger"
    return last.select("switch_id", on.alias("triggered"), F.when(on, F.col("reason")).alias("reason"), "actor", "ts")


def daily_counters(trades: DataFrame, key: str = "sleeve_id", seconds: int = 3600) -> DataFrame:
    """Trades and PnL of the same UTC day before each trade, reset at midnight.

    Counted inside short buckets of the day; earlier buckets come in as totals.
    """
    rows = trades.withColumn("day", F.to_date("ts")).withColumn("__b", time_bucket("ts", seconds))
    carried = carry_in(
        rows,
        [key, "day"],
        "__b",
        {"__n": F.count(F.lit(1)), "__s": F.sum("pnl")},
        {"__n0": F.sum("__n"), "__s0": F.sum("__s")},
    )
    inside = Window.partitionBy(key, "day", "__b").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__n1", F.count(F.lit(1)).over(inside)).withColumn("__s1", F.sum("pnl").over(inside))
    zero = F.lit(0)
    return (
        match_keys(rows, carried, [key, "day", "__b"])
        .withColumn("trades_today", F.coalesce("__n0", zero) + F.col("__n1"))
        .withColumn("daily_pnl", F.coalesce("__s0", zero) + F.coalesce("__s1", zero))
        .drop("__b", "__n0", "__s0", "__n1", "__s1")
    )
