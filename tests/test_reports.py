"""Report views, empty and filled."""

import datetime as dt

from quantspan.operators import reports
from quantspan.schemas import BACKTESTS, DECISIONS, EQUITY, GATES, REGIMES, RULES, SLEEVES, TRADES

NOW = dt.datetime(2026, 1, 1)


def _tables(spark, full):
    one = lambda schema, *rows: spark.createDataFrame(list(rows) if full else [], schema)
    bt = lambda d, dsr, pbo: ("s1", "c", NOW + dt.timedelta(d), 15, 0.1, 0.1, dsr, pbo, 0.2, 0.5, 0.01, 0.02, "{}", 1)
    tr = lambda i, st, why: (i, "s1", "B", NOW, "NQ", "long", 2.0, 1.0, 1.0, 1.0, None, None, st, why, 1)
    return {
        "equity": one(EQUITY, (NOW, "s1", "B", 50000.0, 0.0, 0.0, 50000.0, 0.0), (NOW + dt.timedelta(1), "s1", "B", 47000.0, 1.0, 0.0, 50000.0, 0.06)),
        "gates": one(GATES, (NOW, "s1", "B", 0.06, "dd5", 0.5, "normal", True)),
        "trades": one(TRADES, tr("t1", "filled", None), tr("t2", "vetoed", " too big ")),
        "sleeves": one(SLEEVES, ("s1", "One", "B", "paper", "futures", ["NQ"], NOW, None, None), ("s2", "Two", "A", "live", "futures", [], NOW, None, None)),
        "backtests": one(BACKTESTS, bt(0, 0.9, 0.1), bt(1, 0.67, 0.95), ("s3", "c", NOW, 15, 0.1, 0.1, 0.5, 0.2, 0.2, 0.5, 0.01, 0.02, "{}", 1)),
        "regimes": one(REGIMES, ("r1", NOW, "NQ", "tda_v1", "shift", {}, {"d_topo": 0.0312345678}), ("r2", NOW, "ES", "tda_v1", "stable", {}, {})),
        "rules": one(RULES, ("a", NOW, "w", "NQ", None, "veto", {}, 1, True), ("b", NOW, "w", None, None, "veto", {}, 1, False)),
        "decisions": one(DECISIONS, ("DEC-001", "t", "accepted", "o", NOW, None, "p", "h", 1), ("DEC-002", "u", "proposed", "o", NOW, None, "p", "h", 1)),
    }


def test_filled_views(spark):
    t = _tables(spark, True)
    state = reports.equity_state(t["equity"], t["gates"]).first()
    assert (state.equity, state.peak_equity, state.drawdown_pct, state.gate_level, state.sizing_mult) == (47000.0, 50000.0, 0.06, "dd5", 0.5)
    cards = {r.sleeve_id: r for r in reports.sleeve_cards(t["sleeves"], t["backtests"]).collect()}
    assert (cards["s1"].verdict, cards["s1"].dsr, cards["s1"].name) == ("NO-GO", 0.67, "One")
    assert (cards["s2"].verdict, cards["s2"].status) == ("PENDING", "live")
    assert (cards["s3"].verdict, cards["s3"].name, cards["s3"].status) == ("GO", "s3", "research")
    trades = {r.trade_id: r for r in reports.recent_trades(t["trades"]).collect()}
    assert trades["t2"].vetoed and trades["t2"].reason == "too big" and not trades["t1"].vetoed
    assert {(r.regime_id, r.d_topo) for r in reports.recent_regimes(t["regimes"]).collect()} == {("r1", 0.031235), ("r2", 0.0)}
    assert [r.rule_id for r in reports.active_rule_view(t["rules"]).collect()] == ["a"]
    assert [r.id for r in reports.decision_list(t["decisions"], "accepted").collect()] == ["DEC-001"]


def test_dashboard_and_summary(spark):
    t = _tables(spark, True)
    sections = reports.dashboard(**t)
    assert {k: v.count() for k, v in sections.items()} == {
        "gate": 1, "equity": 1, "trades": 2, "sleeves": 3, "regimes": 2, "rules": 1, "decisions": 2,
    }
    assert [r.title for r in sections["decisions"].collect()] == ["u", "t"]
    cards = reports.sleeve_cards(t["sleeves"], t["backtests"])
    row = reports.summary(reports.equity_state(t["equity"], t["gates"]), cards, {"trades": t["trades"], "regimes": t["regimes"]}).first()
    assert (row.sleeves_go, row.sleeves_nogo, row.n_sleeves, row.n_trades, row.n_regimes, row.gate_level) == (1, 1, 3, 2, 2, "dd5")


def test_empty_state_is_coherent(spark):
    t = _tables(spark, False)
    state = reports.equity_state(t["equity"], t["gates"]).first()
    assert (state.equity, state.gate_level, state.sizing_mult, state.current_dd_pct) == (None, "normal", 1.0, 0.0)
    sections = reports.dashboard(**t)
    assert {k for k, v in sections.items() if v.count()} == {"gate", "equity"}
