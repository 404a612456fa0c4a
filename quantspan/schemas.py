"""Declared schemas (DDL) of the state tables and the value domains checked on them."""

from __future__ import annotations


def columns(schema: str) -> list[str]:
    """Column names of a schema without nested types."""
    return [field.split()[0] for field in schema.split(", ")]


BARS = (
    "instrument STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
)
RETURNS = ("sleeve_id STRING, config_id INT, t BIGINT, ret DOUBLE")
SIGNALS = (
    "signal_id STRING, created_at TIMESTAMP, symbol STRING, direction STRING, setup_type STRING, "
    "timeframe STRING, entry_price DECIMAL(20,6), stop_loss DECIMAL(20,6), "
    "take_profit_1 DECIMAL(20,6), take_profit_2 DECIMAL(20,6), take_profit_3 DECIMAL(20,6), "
    "confidence DOUBLE, justification STRING, indicators_snapshot MAP<STRING,DOUBLE>, "
    "target_account STRING, suggested_size_contracts INT, risk_per_contract_usd DECIMAL(20,6), "
    "requires_news_filter BOOLEAN, valid_until TIMESTAMP"
)
ACCOUNT_STATE = (
    "account_id STRING, firm STRING, snapshot_at TIMESTAMP, equity_usd DECIMAL(20,6), "
    "starting_balance_usd DECIMAL(20,6), daily_pnl_usd DECIMAL(20,6), "
    "realized_daily_pnl_usd DECIMAL(20,6), unrealized_pnl_usd DECIMAL(20,6), open_positions INT, "
    "trades_today INT, consecutive_losses INT, max_drawdown_threshold_usd DECIMAL(20,6), "
    "current_drawdown_usd DECIMAL(20,6), consistency_pct_today DOUBLE"
)
RULES = (
    "id STRING, ts TIMESTAMP, rule_type STRING, instrument STRING, "
    "`window` STRUCT<event: STRING, event_ts: TIMESTAMP, pre_min: DOUBLE, post_min: DOUBLE>, "
    "action STRING, params MAP<STRING,STRING>, audit_id BIGINT, active BOOLEAN"
)
EVENT_LOG = (
    "chain_id STRING, line_no BIGINT, line STRING, seq BIGINT, ts_utc STRING, ts_ms BIGINT, "
    "actor STRING, event_type STRING, event_key STRING, payload STRING, payload_hash STRING, "
    "prev_hash STRING, chain_hash STRING"
)
AUDIT_LOG = (
    "id BIGINT, ts TIMESTAMP, actor STRING, event_type STRING, event_key STRING, "
    "payload_json STRING, payload_hash STRING, prev_hash STRING, chain_hash STRING"
)
DECISIONS = (
    "id STRING, title STRING, status STRING, owner STRING, created TIMESTAMP, "
    "superseded_by STRING, vault_path STRING, content_hash STRING, audit_id BIGINT"
)
SLEEVES = (
    "id STRING, name STRING, track STRING, status STRING, asset_class STRING, "
    "instruments ARRAY<STRING>, created TIMESTAMP, dsr DOUBLE, pbo DOUBLE"
)
TRADES = (
    "id STRING, sleeve_id STRING, track STRING, ts TIMESTAMP, instrument STRING, side STRING, "
    "size_target DOUBLE, entry_target DOUBLE, stop_target DOUBLE, take_target DOUBLE, "
    "regime_id STRING, score_bma DOUBLE, status STRING, veto_reason STRING, audit_id BIGINT"
)
EXECUTIONS = (
    "id STRING, trade_id STRING, ts TIMESTAMP, instrument STRING, side STRING, size_filled DOUBLE, "
    "price_fill DOUBLE, commission DOUBLE, fees DOUBLE, slippage_ticks DOUBLE, broker STRING, "
    "audit_id BIGINT"
)
EQUITY = (
    "ts TIMESTAMP, sleeve_id STRING, track STRING, equity DOUBLE, realized_pnl DOUBLE, "
    "unrealized_pnl DOUBLE, peak_equity DOUBLE, drawdown_pct DOUBLE"
)
REGIMES = (
    "id STRING, ts TIMESTAMP, instrument STRING, classifier STRING, regime_label STRING, "
    "posterior MAP<STRING,DOUBLE>, features MAP<STRING,DOUBLE>"
)
AGENT_DECISIONS = (
    "id BIGINT, ts TIMESTAMP, agent STRING, trade_id STRING, score DOUBLE, confidence DOUBLE, "
    "rationale_json STRING, weight_used DOUBLE"
)
GATES = (
    "ts TIMESTAMP, sleeve_id STRING, track STRING, current_dd_pct DOUBLE, gate_level STRING, "
    "sizing_mult DOUBLE, previous_level STRING, tripped BOOLEAN"
)
CALIBRATIONS = (
    "instrument STRING, hour_utc INT, ts TIMESTAMP, spread_ticks_mean DOUBLE, "
    "spread_ticks_p95 DOUBLE, impact_eta DOUBLE, impact_gamma DOUBLE, slippage_var DOUBLE, "
    "n_samples BIGINT, tick_value DOUBLE"
)
BACKTESTS = (
    "sleeve_id STRING, git_commit STRING, ts TIMESTAMP, n_paths INT, sharpe_mean DOUBLE, "
    "sharpe_std DOUBLE, dsr DOUBLE, pbo DOUBLE, max_dd_pct DOUBLE, calmar DOUBLE, "
    "embargo_pct DOUBLE, purge_pct DOUBLE, config_json STRING, audit_id BIGINT"
)
BMA_WEIGHTS = (
    "run_id STRING, sleeve_id STRING, weight DOUBLE, prior DOUBLE, log_evidence DOUBLE, "
    "post_mean DOUBLE, post_z DOUBLE, sharpe DOUBLE, n_obs BIGINT"
)
KILL_SWITCH = "switch_id STRING, triggered BOOLEAN, reason STRING, actor STRING, ts TIMESTAMP"
NOTES = (
    "path STRING, id_key STRING, title STRING, folder STRING, tags ARRAY<STRING>, "
    "instrument STRING, regime STRING, links ARRAY<STRING>, body STRING"
)

# The domains of the enumerated columns.
DOMAINS = {
    "decision_status": ("proposed", "accepted", "superseded", "rejected"),
    "track": ("A", "B"),
    "equity_track": ("A", "B", "agg"),
    "sleeve_status": ("research", "paper", "live", "paused", "retired"),
    "side": ("long", "short", "flat"),
    "fill_side": ("long", "short"),
    "trade_status": ("proposed", "approved", "vetoed", "filled", "partial", "cancelled", "expired"),
    "gate_level": ("normal", "dd5", "dd10", "dd15", "halt"),
    "rule_action": ("veto", "size_down"),
    "setup_type": ("SETUP_1", "SETUP_2", "SETUP_3", "SCALP_EMA", "NEWS_DRIVEN"),
    "direction": ("LONG", "SHORT"),
    "firm": ("APEX", "TOPSTEP", "LUCID", "OWN_LIVE"),
    "verdict": ("APPROVE", "REJECT", "APPROVE_PENDING_HUMAN"),
    "order_type": ("MARKET", "LIMIT", "STOP", "STOP_LIMIT"),
    "order_status": ("PENDING", "SUBMITTED", "PARTIAL", "FILLED", "CANCELED", "REJECTED"),
}
