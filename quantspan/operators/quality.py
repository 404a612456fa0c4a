"""Constraint checks on state tables: domains, ranges, NOT NULL, UNIQUE, foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.schemas import DOMAINS


def one_of(column: str, domain: str) -> Column:
    return F.col(column).isin(*DOMAINS[domain])


def _between(column: str, lo: float, hi: float) -> Column:
    return F.col(column).isNull() | F.col(column).between(lo, hi)


def _hash(column: str) -> Column:
    return F.length(column) == 64


def table_checks() -> dict[str, dict[str, Column]]:
    """Named predicates per state table; a row breaks a check where its predicate is false."""
    return {
        "audit_log": {f"{h}_length": _hash(h) for h in ("payload_hash", "prev_hash", "chain_hash")},
        "decisions": {"status": one_of("status", "decision_status"), "content_hash_length": _hash("content_hash")},
        "sleeves": {
            "track": one_of("track", "track"),
            "status": one_of("status", "sleeve_status"),
            "dsr": F.col("dsr").isNull() | (F.col("dsr") >= -10),
            "pbo": _between("pbo", 0, 1),
        },
        "trades": {
            "track": one_of("track", "track"),
            "side": one_of("side", "side"),
            "status": one_of("status", "trade_status"),
        },
        "executions": {"side": one_of("side", "fill_side")},
        "equity_curve": {"track": one_of("track", "equity_track")},
        "agent_decisions": {"confidence": _between("confidence", 0, 1)},
        "risk_gates_state": {"gate_level": one_of("gate_level", "gate_level")},
        "cost_model_calibrations": {"hour_utc": (F.col("hour_utc") >= 0) & (F.col("hour_utc") < 24)},
        "backtest_results": {"n_paths": F.col("n_paths") >= 10, "pbo": _between("pbo", 0, 1)},
        "ontology_rules": {"action": one_of("action", "rule_action")},
        "bma_weights": {
            "weight": _between("weight", 0, 1),
            "prior": _between("prior", 0, 1),
            "n_obs": F.col("n_obs") >= 0,
        },
    }


# Keys that must be unique; rows with a NULL in the key never collide.
UNIQUE_KEYS = {
    "audit_log": ("chain_hash",),
    "equity_curve": ("ts", "sleeve_id", "track"),
    "regime_states": ("ts", "instrument", "classifier"),
    "cost_model_calibrations": ("instrument", "hour_utc", "ts"),
    "bma_weights": ("run_id", "sleeve_id"),
    "notes": ("path",),
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = (
    ("decisions", "superseded_by", "decisions", "id"),
    ("decisions", "audit_id", "audit_log", "id"),
    ("trades", "sleeve_id", "sleeves", "id"),
    ("trades", "audit_id", "audit_log", "id"),
    ("executions", "trade_id", "trades", "id"),
    ("executions", "audit_id", "audit_log", "id"),
    ("equity_curve", "sleeve_id", "sleeves", "id"),
    ("agent_decisions", "trade_id", "trades", "id"),
    ("risk_gates_state", "trigger_audit_id", "audit_log", "id"),
    ("backtest_results", "audit_id", "audit_log", "id"),
    ("ontology_rules", "audit_id", "audit_log", "id"),
    ("bma_weights", "audit_id", "audit_log", "id"),
)


def check_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, n_bad) of all checks in one scan."""
    names = list(checks)
    row = df.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(n) for n, p in checks.items()])
    stacked = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in names])
    return row.select(F.explode(stacked).alias("c")).select("c.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return check_counts(df, {c: F.col(c).isNotNull() for c in columns})


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; counted map-side first."""
    known = df.dropna(subset=list(keys)) if keys else df
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of ``child`` whose non-NULL reference has no parent row."""
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Missing parent keys with the number of rows that refer to them.

    References are counted before the join, so a key a third of the rows refer to is one row.
    """
    refs = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    return orphans(refs, fk, parent, pk)


def registry_problems(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, check, n_bad) of every declared domain, unique key and reference of the tables that are given.

    Domains of a table are counted in one scan; a key that breaks its uniqueness counts once, a reference
    without a parent row counts each time. Columns that a table lacks are not checked.
    """
    out = []
    for name, checks in table_checks().items():
        if name in tables:
            out.append(check_counts(tables[name], checks).withColumn("table", F.lit(name)))
    count = lambda df, of, label: df.agg(of.alias("n_bad")).select(F.lit(label).alias("check"), "n_bad")
    for name, keys in UNIQUE_KEYS.items():
        if name in tables and set(keys) <= set(tables[name].columns):
            bad = unique_violations(tables[name], keys)
            out.append(count(bad, F.count(F.lit(1)), f"unique({','.join(keys)})").withColumn("table", F.lit(name)))
    for child, fk, parent, pk in FOREIGN_KEYS:
        if child in tables and parent in tables and fk in tables[child].columns:
            lost = orphan_keys(tables[child], fk, tables[parent], pk)
            total = F.coalesce(F.sum("n_rows"), F.lit(0))
            out.append(count(lost, total, f"{fk} in {parent}").withColumn("table", F.lit(child)))
    return reduce(DataFrame.unionByName, out).select("table", "check", "n_bad")


def unfilled_executions(executions: DataFrame, trades: DataFrame) -> DataFrame:
    """Executions whose trade is missing or was not filled."""
    filled = trades.where("status = 'filled'").select(F.col("id").alias("trade_id"))
    return executions.join(filled, "trade_id", "left_anti")


def weight_sums(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Runs whose weights do not sum to one."""
    return (
        weights.groupBy("run_id")
        .agg(F.sum("weight").alias("total"))
        .where(F.abs(F.col("total") - 1) > tolerance)
    )
