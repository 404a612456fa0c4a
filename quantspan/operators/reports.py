"""Report views over the state tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.functions.prices import go_verdict
from quantspan.sources.tables import latest_per_key

RECENT = 50


def _latest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in ("sleeve_id", "track") if c in df.columns]).limit(1)


def equity_state(equity: DataFrame, gates: DataFrame) -> DataFrame:
    """One row: latest equity and gate, with the neutral gate where there is none yet."""
    one = lambda df, cols: _latest(df).select(F.lit(1).alias("k"), *cols)
    e = one(
        equity,
        [
            F.round("equity", 2).alias("equity"),
            F.round("peak_equity", 2).alias("peak_equity"),
            F.round("drawdown_pct", 6).alias("drawdown_pct"),
            F.round("realized_pnl", 2).alias("realized_pnl"),
            F.col("ts").alias("e_ts"),
        ],
    )
    g = one(gates, ["gate_level", "sizing_mult", F.round("current_dd_pct", 6).alias("current_dd_pct"), F.col("ts").alias("g_ts")])
    base = equity.sparkSession.range(1).select(F.lit(1).alias("k"))
    return base.join(e, "k", "left").join(g, "k", "left").select(
        "equity",
        "peak_equity",
        "drawdown_pct",
        "realized_pnl",
        F.coalesce("gate_level", F.lit("normal")).alias("gate_level"),
        F.coalesce("sizing_mult", F.lit(1.0)).alias("sizing_mult"),
        F.coalesce("current_dd_pct", F.lit(0.0)).alias("current_dd_pct"),
        F.coalesce("e_ts", "g_ts").alias("as_of"),
    )


def sleeve_cards(sleeves: DataFrame, backtests: DataFrame) -> DataFrame:
    """Every sleeve of the registry or the backtests, with its latest backtest and verdict."""
    ids = sleeves.select(F.col("id").alias("sleeve_id")).union(backtests.select("sleeve_id")).distinct()
    meta = sleeves.select(F.col("id").alias("sleeve_id"), "name", "track", "status")
    latest = latest_per_key(backtests, ["sleeve_id"], ["ts"]).select(
        "sleeve_id", "dsr", "pbo", "max_dd_pct", "sharpe_mean", "n_paths", F.col("ts").alias("as_of")
    )
    rows = ids.join(meta, "sleeve_id", "left").join(latest, "sleeve_id", "left")
    return rows.select(
        "sleeve_id",
        F.coalesce("name", "sleeve_id").alias("name"),
        "track",
        F.coalesce("status", F.lit("research")).alias("status"),
        *[F.round(c, 6).alias(c) for c in ("dsr", "pbo", "max_dd_pct", "sharpe_mean")],
        "n_paths",
        go_verdict(F.col("dsr"), F.col("pbo")).alias("verdict"),
        "as_of",
    )


def recent_regimes(regimes: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest regime rows. ``features`` is a map, or JSON text; without ``d_topo`` it counts as 0."""
    as_map = isinstance(regimes.schema["features"].dataType, T.MapType)
    d_topo = F.col("features")["d_topo"] if as_map else F.get_json_object("features", "$.d_topo").try_cast("double")
    return (
        regimes.orderBy(F.col("ts").desc(), "id")
        .limit(limit)
        .select(
            F.col("id").alias("regime_id"),
            "classifier",
            F.col("regime_label").alias("regime"),
            F.round(F.coalesce(d_topo, F.lit(0.0)), 6).alias("d_topo"),
            "ts",
        )
    )


def recent_trades(trades: DataFrame, limit: int = RECENT) -> DataFrame:
    return (
        trades.orderBy(F.col("ts").desc(), "id")
        .limit(limit)
        .select(
            F.col("id").alias("trade_id"),
            "instrument",
            "side",
            F.col("size_target").alias("size"),
            "status",
            (F.col("status") == "vetoed").alias("vetoed"),
            F.trim(F.coalesce("veto_reason", F.lit(""))).alias("reason"),
            "ts",
        )
    )


def active_rule_view(rules: DataFrame) -> DataFrame:
    return rules.where("active").select(
        F.col("id").alias("rule_id"), "rule_type", "instrument", "action", "active", "ts"
    ).orderBy(F.col("ts").desc(), "rule_id")


def decision_list(decisions: DataFrame, status: str | None = None) -> DataFrame:
    rows = decisions.where(F.col("status") == status) if status else decisions
    return rows.orderBy("id")


def dashboard(
    equity: DataFrame,
    gates: DataFrame,
    trades: DataFrame,
    sleeves: DataFrame,
    backtests: DataFrame,
    regimes: DataFrame,
    rules: DataFrame,
    decisions: DataFrame,
) -> dict[str, DataFrame]:
    """The seven dashboard sections."""
    state = equity_state(equity, gates)
    cards = sleeve_cards(sleeves, backtests)
    return {
        "gate": state.select("gate_level", "sizing_mult", "current_dd_pct"),
        "equity": state.select("equity", "peak_equity", "drawdown_pct", "realized_pnl"),
        "trades": recent_trades(trades, 20).select("instrument", "side", "status", "vetoed"),
        "sleeves": cards.orderBy("pbo", "sleeve_id").select("verdict", "dsr", "pbo", "max_dd_pct"),
        "regimes": recent_regimes(regimes, 10).select("regime", "d_topo", "ts"),
        "rules": active_rule_view(rules).select("action", "instrument", "rule_type"),
        "decisions": decisions.orderBy(F.col("id").desc()).limit(10).select("status", "title"),
    }


def summary(state: DataFrame, cards: DataFrame, counts: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of the views with the gate, equity and verdict totals, as one row."""
    k = F.lit(1).alias("k")
    out = state.select(k, "gate_level", "sizing_mult", "equity", "drawdown_pct")
    verdicts = cards.agg(
        F.count_if(F.col("verdict") == "GO").alias("sleeves_go"),
        F.count_if(F.col("verdict") == "NO-GO").alias("sleeves_nogo"),
        F.count(F.lit(1)).alias("n_sleeves"),
    )
    out = out.join(verdicts.withColumn("k", F.lit(1)), "k")
    for name, df in counts.items():
        out = out.join(df.agg(F.count(F.lit(1)).alias(f"n_{name}")).withColumn("k", F.lit(1)), "k")
    return out.drop("k")
