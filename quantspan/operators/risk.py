"""Risk verdict of trade signals: kill switch, hard rules, injected rules, sizing, human check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.config import RiskLimits
from quantspan.functions.prices import apply_sizing
from quantspan.operators.ontology import signal_effects, with_rule_counts
from quantspan.operators.rules import apply_rules
from quantspan.plans.asof import asof_join
from quantspan.plans.blocks import DAY

# Share of equity risked per trade, and for scalping.
RISK_PCT = "0.013"
SCALP_RISK_PCT = "0.007"
MAIN_SWITCH = "main"

c = F.col


def approved_size() -> Column:
    """Suggested size, cut to what the equity share pays for; never larger, never negative."""
    pct = F.when(c("setup_type") == "SCALP_EMA", F.lit(SCALP_RISK_PCT).cast("decimal(4,3)")).otherwise(
        F.lit(RISK_PCT).cast("decimal(4,3)")
    )
    per = c("risk_per_contract_usd")
    affordable = F.floor(F.greatest(c("equity_usd") * pct / per, F.lit(0).cast("decimal(20,6)")))
    return F.when(per > 0, F.least(c("suggested_size_contracts").cast("decimal(38,0)"), affordable.cast("decimal(38,0)"))).otherwise(
        F.lit(0).cast("decimal(38,0)")
    ).cast("int")


def human_reason(limits: RiskLimits, size: Column) -> Column:
    """Why a human has to confirm, or NULL."""
    exposure = size.cast("decimal(10,0)") * c("risk_per_contract_usd")
    return F.when(c("firm") == "APEX", F.lit("APEX accounts need a human confirmation")).when(
        exposure >= F.lit(limits.min_trade_approval_usd).cast("decimal(20,6)"),
        F.format_string(f"exposure %s at or above {limits.min_trade_approval_usd}", exposure.cast("string")),
    )


def attach_account(signals: DataFrame, accounts: DataFrame, seconds: int = DAY) -> DataFrame:
    """The account snapshot valid when each signal was created (signals carry account_id)."""
    return asof_join(signals, accounts, ["account_id"], "created_at", "snapshot_at", seconds)


def attach_gate(signals: DataFrame, gates: DataFrame, seconds: int = DAY) -> DataFrame:
    """The gate row valid when each signal was created (signals carry sleeve_id and track)."""
    cols = gates.select("sleeve_id", "track", c("ts").alias("gate_ts"), "gate_level", "sizing_mult", "current_dd_pct")
    return asof_join(signals, cols, ["sleeve_id", "track"], "created_at", "gate_ts", seconds)


def attach_rules(signals: DataFrame, rules: DataFrame, lists: bool = True, **params) -> DataFrame:
    """Effects of the injected rules on each signal; only matches of rules limited in time are shuffled.

    The lists of ids and messages grow as signals times rules. Without ``lists`` the effects are numbers
    (``with_rule_counts``), and verdicts and sizes are the same.
    """
    if not lists:
        return with_rule_counts(signals, rules)
    return signals.join(signal_effects(signals, rules, **params).drop("n_size_down"), "signal_id", "left")


def attach_kill_switch(signals: DataFrame, kill: DataFrame, switch_id: str = MAIN_SWITCH) -> DataFrame:
    """State of the named switch on every signal; a switch without a row is off."""
    state = kill.select("switch_id", c("triggered").alias("killed"), c("reason").alias("kill_reason"))
    return signals.withColumn("switch_id", F.lit(switch_id)).join(state, "switch_id", "left").drop("switch_id")


_OPTIONAL = {
    "killed": "boolean",
    "kill_reason": "string",
    "rule_ids": "array<string>",
    "vetoes": "array<string>",
    "n_ids": "long",
    "n_vetoes": "long",
    "ontology_mult": "double",
    "gate_level": "string",
    "sizing_mult": "double",
    "current_dd_pct": "double",
}


def risk_verdict(frame: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Verdict per signal of a frame holding signal, account and the optional attached columns.

    In order: kill switch, hard rules, injected vetoes, size after the equity share, injected
    multipliers and gate (zero rejects), then human confirmation or approval. One projection;
    attached columns that are missing mean "not restricted". Where rules are attached as numbers only, their single
    checks are counted (``n_checks``) but not listed.
    """
    for name, kind in _OPTIONAL.items():
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast(kind))
    rows = apply_rules(frame, limits)
    no_text = F.array().cast("array<string>")
    ids = F.coalesce(F.array_distinct("rule_ids"), no_text)
    vetoes = F.coalesce("vetoes", no_text)
    gated = c("gate_level").isNotNull()
    # the product of the multipliers as the decimal it stands for, so that truncation sees no binary error
    cut = F.floor(approved_size() * F.coalesce(F.round("ontology_mult", 12).cast("decimal(20,12)"), F.lit(1).cast("decimal(20,12)"))).cast("int")
    rows = (
        rows.withColumn("size_", apply_sizing(cut, c("sizing_mult")))
        .withColumn("hard_failed", F.exists(F.map_values("checks"), lambda ok: ~ok))  # not of the messages, which may not be asked for
        .withColumn("vetoed", (F.size(vetoes) > 0) | (F.coalesce("n_vetoes", F.lit(0)) > 0))
    )
    killed = F.coalesce("killed", F.lit(False))
    reason = human_reason(limits, c("size_"))
    passed = ~killed & ~c("hard_failed") & ~c("vetoed")
    verdict = (
        F.when(~passed | (c("size_") == 0), F.lit("REJECT"))
        .when(reason.isNotNull(), F.lit("APPROVE_PENDING_HUMAN"))
        .otherwise(F.lit("APPROVE"))
    )
    after_rules = F.map_concat(
        c("checks"),
        F.map_from_arrays(
            F.transform(ids, lambda x: F.concat(F.lit("ontology:"), x)), F.transform(ids, lambda x: F.lit(False))
        ),
    )
    after_gate = F.when(
        gated,
        F.map_concat(after_rules, F.create_map(F.concat(F.lit("dd_gate:"), "gate_level"), c("sizing_mult") >= 1.0)),
    ).otherwise(after_rules)
    checks = (
        F.when(killed, F.create_map(F.lit("kill_switch_check"), F.lit(False)))
        .when(c("hard_failed"), c("checks"))
        .when(c("vetoed"), after_rules)
        .otherwise(after_gate)
    )
    n_after_rules = F.size(c("checks")) + F.coalesce("n_ids", F.size(ids).cast("long"))
    n_after_gate = n_after_rules + F.when(gated, 1).otherwise(0)
    n_checks = F.when(killed, 1).when(c("hard_failed"), F.size("checks")).when(c("vetoed"), n_after_rules).otherwise(n_after_gate)
    zero = F.when(
        c("gate_level") == "halt",
        F.format_string("DD-gate HALT: drawdown %.1f%%", c("current_dd_pct") * 100),
    ).otherwise(F.lit("size cut to zero: one contract risks more than the allowed share of equity"))
    approvals = F.array_compact(
        F.array(
            F.format_string("passed %d rules", n_after_gate),
            F.format_string("approved size: %d contracts", c("size_")),
            F.when(
                gated & (c("sizing_mult") < 1.0),
                F.format_string("DD-gate %s cut the size (x%s)", c("gate_level"), c("sizing_mult").cast("string")),
            ),
        )
    )
    reasons = (
        F.when(killed, F.array(F.concat(F.lit("KILL_SWITCH: "), F.coalesce("kill_reason", F.lit("active")))))
        .when(c("hard_failed"), c("failures"))
        .when(F.size(vetoes) > 0, vetoes)
        .when(c("vetoed"), F.array(F.format_string("ONTOLOGY: vetoes of %d rules", c("n_vetoes"))))
        .when(c("size_") == 0, F.array(zero))
        .otherwise(approvals)
    )
    rows = rows.withColumn("verdict", verdict)
    approved = c("verdict") != "REJECT"
    return rows.select(
        "signal_id",
        "verdict",
        reasons.alias("reasons"),
        F.when(approved, c("size_")).otherwise(0).alias("approved_size_contracts"),
        checks.alias("checks_performed"),
        n_checks.cast("long").alias("n_checks"),
        "consecutive_losses",
        (approved & reason.isNotNull()).alias("requires_human_confirm"),
        F.when(approved, reason).alias("human_confirm_reason"),
    )


def attach_state(
    signals: DataFrame, accounts: DataFrame, rules: DataFrame | None = None, gates: DataFrame | None = None, seconds: int = DAY, lists: bool = True
) -> DataFrame:
    """Signals with account, gate and rules (``attach_rules``) as they stood when each was created."""
    frame = attach_account(signals, accounts, seconds)
    if gates is not None:
        frame = attach_gate(frame, gates, seconds)
    return frame if rules is None else attach_rules(frame, rules, lists)


def evaluate_signals(
    signals: DataFrame,
    accounts: DataFrame,
    rules: DataFrame | None = None,
    gates: DataFrame | None = None,
    kill: DataFrame | None = None,
    limits: RiskLimits = RiskLimits(),
    seconds: int = DAY,
) -> DataFrame:
    """Attach account, gate, rules and kill switch to the signals, then give the verdicts."""
    frame = attach_state(signals, accounts, rules, gates, seconds)
    if kill is not None:
        frame = attach_kill_switch(frame, kill)
    return risk_verdict(frame, limits)
