"""Limits of the risk operators, passed in by the caller and turned into literals."""

from __future__ import annotations

from dataclasses import dataclass


# Names and defaults of the limits, by rule.
@dataclass(frozen=True)
class RiskLimits:
    system_mode: str = "A"
    max_daily_loss_pct: float = 5.0
    max_daily_trades: int = 3
    max_consecutive_losses: int = 3
    min_trade_approval_usd: float = 1000.0
    topstep_ai_allowed: bool = True


# Contract specs per instrument as (tick size, tick value in USD).
INSTRUMENT_SPECS = {
    "NQ": (0.25, 5.0),
    "MNQ": (0.25, 0.5),
    "ES": (0.25, 12.5),
    "MES": (0.25, 1.25),
    "GC": (0.10, 10.0),
}
DEFAULT_SPEC = (0.25, 1.0)

# Exchange-traded proxies and the instrument each one stands for.
PROXY_TO_INSTRUMENT = {"GLD": "GC", "QQQ": "NQ"}
