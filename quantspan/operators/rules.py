"""Signal validity and the hard risk rules, each one predicate column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.config import RiskLimits
from quantspan.functions.prices import daily_pnl_pct, ny_time, risk_reward
from quantspan.schemas import DOMAINS

# A rule gives (passed, message when it fails) for a row of signal and account columns.
Rule = Callable[[RiskLimits], tuple[Column, Column]]

# Lowest reward/risk per setup, confidence floor, consistency ceiling,
# share of the drawdown threshold that must stay free, and scalping hours in New York.
RR_FLOORS = {"SCALP_EMA": 1.5, "SETUP_1": 2.0, "SETUP_2": 2.0, "SETUP_3": 2.0, "NEWS_DRIVEN": 2.5}
RR_DEFAULT = 2.0
MIN_CONFIDENCE = 0.55
MAX_CONSISTENCY_PCT = 28.0
DD_BUFFER = 0.5
SCALP_HOURS = (("08:30:00.000000", "11:30:00.000000"), ("14:00:00.000000", "15:45:00.000000"))

c = F.col


def signal_rr() -> Column:
    return risk_reward(c("entry_price"), c("stop_loss"), c("take_profit_1"))


def rr_floor() -> Column:
    pairs = [F.lit(x) for kv in RR_FLOORS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c("setup_type")], F.lit(RR_DEFAULT))


def _or_none(count: str) -> Column:
    """A count of the account that nothing was recorded for is none, if there is an account at all."""
    return F.when(c("firm").isNotNull(), F.coalesce(c(count), F.lit(0)))


def _max_daily_trades(lim: RiskLimits):
    done = _or_none("trades_today")
    return done < lim.max_daily_trades, F.format_string(f"daily trade limit (%d/{lim.max_daily_trades})", done)


def _max_consecutive_losses(lim: RiskLimits):
    lost = _or_none("consecutive_losses")
    return lost < lim.max_consecutive_losses, F.format_string("%d losses in a row", lost)


def _max_daily_loss(lim: RiskLimits):
    pct = daily_pnl_pct(c("daily_pnl_usd"), c("starting_balance_usd"))
    return pct > -lim.max_daily_loss_pct, F.format_string(
        f"daily loss %.2f%% beyond -{lim.max_daily_loss_pct}%%", pct
    )


def _trailing_dd_buffer(lim: RiskLimits):
    room = c("max_drawdown_threshold_usd").cast("double") * DD_BUFFER
    drawdown = _or_none("current_drawdown_usd").cast("double")
    return drawdown < room, F.format_string("drawdown %.2f within the buffer of %.2f", drawdown, room)


def _risk_reward_minimum(lim: RiskLimits):
    return signal_rr() >= rr_floor(), F.format_string(
        "reward/risk %.2f below %.1f for %s", signal_rr(), rr_floor(), c("setup_type")
    )


def _confidence_threshold(lim: RiskLimits):
    return c("confidence") >= MIN_CONFIDENCE, F.format_string(
        f"confidence %.2f below {MIN_CONFIDENCE}", c("confidence")
    )


def _topstep_no_vps(lim: RiskLimits):
    return (c("firm") != "TOPSTEP") | F.lit(lim.system_mode == "C"), F.lit("TOPSTEP trades only in mode C")


def _apex_consistency(lim: RiskLimits):
    pct = c("consistency_pct_today")
    return (c("firm") != "APEX") | pct.isNull() | (pct <= MAX_CONSISTENCY_PCT), F.format_string(
        "today is %.1f%% of the total profit", pct
    )


def _apex_no_ai(lim: RiskLimits):
    return F.lit(True), F.lit("APEX needs a human confirmation")


def _scalp_allowed(lim: RiskLimits):
    banned = (c("firm") == "APEX") | ((c("firm") == "TOPSTEP") & F.lit(not lim.topstep_ai_allowed))
    return (c("setup_type") != "SCALP_EMA") | ~banned, F.format_string("scalping is not allowed on %s", c("firm"))


def _scalp_window(lim: RiskLimits):
    now = ny_time(c("evaluated_at"))
    inside = now.between(*SCALP_HOURS[0]) | now.between(*SCALP_HOURS[1])
    return (c("setup_type") != "SCALP_EMA") | inside, F.format_string("outside scalping hours (New York %s)", now)


HARD_RULES: dict[str, Rule] = {
    "max_daily_trades": _max_daily_trades,
    "max_consecutive_losses": _max_consecutive_losses,
    "max_daily_loss": _max_daily_loss,
    "trailing_dd_buffer": _trailing_dd_buffer,
    "risk_reward_minimum": _risk_reward_minimum,
    "confidence_threshold": _confidence_threshold,
    "topstep_no_vps": _topstep_no_vps,
    "apex_consistency_30_pct": _apex_consistency,
    "apex_no_ai_in_pa_live": _apex_no_ai,
    "scalp_only_in_allowed_mode": _scalp_allowed,
    "scalp_window": _scalp_window,
}


def apply_rules(
    frame: DataFrame, limits: RiskLimits = RiskLimits(), rules: Mapping[str, Rule] = HARD_RULES
) -> DataFrame:
    """Add ``failures`` (messages in rule order) and ``checks`` (rule → passed).

    Every rule is evaluated on every row, in one projection. ``rules`` can hold further rules. A rule
    that cannot be decided, for want of a value, has failed.
    The time-of-day rule looks at ``evaluated_at``, which defaults to ``created_at``.
    """
    if "evaluated_at" not in frame.columns:
        frame = frame.withColumn("evaluated_at", c("created_at"))
    built = {}
    for name, rule in rules.items():
        passed, message = rule(limits)
        built[name] = F.coalesce(passed, F.lit(False)), message
    messages = [
        F.when(~passed, F.concat(F.lit(f"[{name}] "), F.coalesce(msg, F.lit("failed"))))
        for name, (passed, msg) in built.items()
    ]
    names = F.array(*[F.lit(n) for n in built])
    return frame.withColumn("failures", F.array_compact(F.array(*messages))).withColumn(
        "checks", F.map_from_arrays(names, F.array(*[passed for passed, _ in built.values()]))
    )


def signal_problems(signals: DataFrame) -> DataFrame:
    """Signals with the array of contract violations; an empty array means valid."""
    long_side = c("direction") == "LONG"
    problems = {
        "direction": ~c("direction").isin(*DOMAINS["direction"]),
        "setup_type": ~c("setup_type").isin(*DOMAINS["setup_type"]),
        "target_account": ~c("target_account").isin(*DOMAINS["firm"]),
        "confidence": ~c("confidence").between(0.0, 1.0),
        "size": c("suggested_size_contracts") < 1,
        "justification": F.length("justification") < 10,
        "stop_side": F.when(long_side, c("stop_loss") >= c("entry_price")).otherwise(
            c("stop_loss") <= c("entry_price")
        ),
        "target_side": F.when(long_side, c("take_profit_1") <= c("entry_price")).otherwise(
            c("take_profit_1") >= c("entry_price")
        ),
    }
    broken = F.array(*[F.when(F.coalesce(p, F.lit(True)), F.lit(n)) for n, p in problems.items()])
    return signals.withColumn("problems", F.array_compact(broken))
