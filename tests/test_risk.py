"""Cost model, gates, rules, injected rules and verdicts."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspan.config import RiskLimits
from quantspan.functions.prices import apply_sizing, drawdown_level, drawdown_pct, go_verdict, shift_posterior, sizing_mult
from quantspan.operators import gates, ontology, quality, risk, rules
from quantspan.operators.costs import calibrate, order_cost
from quantspan.schemas import ACCOUNT_STATE, CALIBRATIONS, RULES
from quantspan.sources.bars import synthetic_bars
from quantspan.sources.tables import append, insert_absent, read_table, upsert

NOW = dt.datetime(2026, 6, 18, 18, 0)
D = Decimal

SIGNAL = {
    "signal_id": "s", "created_at": NOW, "symbol": "NQ", "direction": "LONG", "setup_type": "SETUP_1",
    "entry_price": D("100"), "stop_loss": D("96"), "take_profit_1": D("110"), "confidence": 0.7,
    "justification": "long enough text", "target_account": "OWN_LIVE", "suggested_size_contracts": 2,
    "risk_per_contract_usd": D("100"),
}
ACCOUNT = {
    "firm": "OWN_LIVE", "equity_usd": D("50000"), "starting_balance_usd": D("50000"), "daily_pnl_usd": D("0"),
    "trades_today": 0, "consecutive_losses": 0, "max_drawdown_threshold_usd": D("2500"), "current_drawdown_usd": D("0"),
    "consistency_pct_today": None,
}
FRAME = (
    "signal_id string, created_at timestamp, symbol string, direction string, setup_type string, "
    "entry_price decimal(20,6), stop_loss decimal(20,6), take_profit_1 decimal(20,6), confidence double, "
    "justification string, target_account string, suggested_size_contracts int, risk_per_contract_usd decimal(20,6), "
    "firm string, equity_usd decimal(20,6), starting_balance_usd decimal(20,6), daily_pnl_usd decimal(20,6), "
    "trades_today int, consecutive_losses int, max_drawdown_threshold_usd decimal(20,6), "
    "current_drawdown_usd decimal(20,6), consistency_pct_today double"
)


def frame(spark, *changes):
    rows = [{**SIGNAL, **ACCOUNT, "signal_id": f"s{i}", **c} for i, c in enumerate(changes or [{}])]
    return spark.createDataFrame(rows, FRAME)


def verdicts(df, **kw):
    return {r.signal_id: r for r in risk.risk_verdict(df, **kw).collect()}


def test_eleven_rules_always_run(spark):
    row = rules.apply_rules(frame(spark)).first()
    assert len(row.checks) == 11 and all(row.checks.values()) and row.failures == []


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"trades_today": 3}, "max_daily_trades"),
        ({"consecutive_losses": 3}, "max_consecutive_losses"),
        ({"daily_pnl_usd": D("-2500")}, "max_daily_loss"),
        ({"current_drawdown_usd": D("1250")}, "trailing_dd_buffer"),
        ({"take_profit_1": D("107")}, "risk_reward_minimum"),
        ({"confidence": 0.54}, "confidence_threshold"),
        ({"firm": "TOPSTEP"}, "topstep_no_vps"),
        ({"firm": "APEX", "consistency_pct_today": 28.1}, "apex_consistency_30_pct"),
        ({"firm": "APEX", "setup_type": "SCALP_EMA", "created_at": dt.datetime(2026, 6, 18, 14, 0)}, "scalp_only_in_allowed_mode"),
        ({"setup_type": "SCALP_EMA", "created_at": dt.datetime(2026, 6, 18, 16, 0)}, "scalp_window"),
        ({"setup_type": "NEWS_DRIVEN", "take_profit_1": D("109.9")}, "risk_reward_minimum"),
    ],
)
def test_each_rule_can_fail(spark, change, rule):
    row = rules.apply_rules(frame(spark, change)).first()
    assert [k for k, v in row.checks.items() if not v] == [rule]
    assert row.failures[0].startswith(f"[{rule}]")


def test_rules_pass_at_their_bounds(spark):
    ok = [
        {"daily_pnl_usd": D("-2499.99")}, {"confidence": 0.55}, {"take_profit_1": D("108")},
        {"firm": "APEX", "consistency_pct_today": 28.0},
        {"setup_type": "SCALP_EMA", "created_at": dt.datetime(2026, 6, 18, 12, 30)},  # 08:30 in New York
        {"setup_type": "SCALP_EMA", "created_at": dt.datetime(2026, 1, 15, 13, 30)},  # the same in winter
    ]
    assert all(not r.failures for r in rules.apply_rules(frame(spark, *ok)).collect())
    modes = rules.apply_rules(frame(spark, {"firm": "TOPSTEP"}), RiskLimits(system_mode="C")).first()
    assert modes.failures == []


def test_user_rules(spark):
    mine = {**rules.HARD_RULES, "no_mnq": lambda lim: (F.col("symbol") != "MNQ", F.lit("not traded"))}
    assert rules.apply_rules(frame(spark, {"symbol": "MNQ"}), rules=mine).first().failures == ["[no_mnq] not traded"]


def test_sizes(spark):
    v = verdicts(
        frame(
            spark,
            {"suggested_size_contracts": 10, "risk_per_contract_usd": D("200")},
            {"suggested_size_contracts": 10, "risk_per_contract_usd": D("200"), "setup_type": "SCALP_EMA",
             "created_at": dt.datetime(2026, 6, 18, 14, 0)},
            {"risk_per_contract_usd": D("100000")},
            {"risk_per_contract_usd": D("1100"), "equity_usd": D("200000")},
            {"firm": "APEX"},
            {"equity_usd": D("-5")},
            {"risk_per_contract_usd": D("0")},
        )
    )
    assert v["s0"].approved_size_contracts == 3
    assert v["s1"].approved_size_contracts == 1
    assert v["s2"].verdict == "REJECT" and v["s2"].approved_size_contracts == 0
    assert v["s3"].verdict == "APPROVE_PENDING_HUMAN" and v["s3"].requires_human_confirm
    assert v["s4"].verdict == "APPROVE_PENDING_HUMAN" and "APEX" in v["s4"].human_confirm_reason
    assert v["s5"].verdict == v["s6"].verdict == "REJECT"


def test_gate_cuts_and_halts(spark):
    df = frame(spark, {}, {}, {}).withColumn("gate_level", F.element_at(F.array(F.lit("dd5"), F.lit("dd10"), F.lit("halt")), F.substring("signal_id", 2, 1).cast("int") + 1))
    df = df.withColumn("sizing_mult", sizing_mult(F.col("gate_level"))).withColumn("current_dd_pct", F.lit(0.2))
    v = verdicts(df)
    assert v["s0"].verdict == "APPROVE" and v["s0"].approved_size_contracts == 1 and v["s0"].checks_performed["dd_gate:dd5"] is False
    assert v["s1"].verdict == "REJECT"
    assert v["s2"].reasons == ["DD-gate HALT: drawdown 20.0%"]


def test_kill_switch_overrides(spark):
    commands = spark.createDataFrame(
        [("main", NOW, "trigger", "storm", "me"), ("other", NOW, "trigger", "x", "me"),
         ("other", NOW + dt.timedelta(1), "clear", None, "you")],
        "switch_id string, ts timestamp, command string, reason string, actor string",
    )
    state = gates.kill_switch_state(commands)
    assert {r.switch_id: (r.triggered, r.reason) for r in state.collect()} == {"main": (True, "storm"), "other": (False, None)}
    v = verdicts(risk.attach_kill_switch(frame(spark), state))["s0"]
    assert v.verdict == "REJECT" and v.reasons == ["KILL_SWITCH: storm"] and v.checks_performed == {"kill_switch_check": False}
    assert verdicts(risk.attach_kill_switch(frame(spark), state, "other"))["s0"].verdict == "APPROVE"


def _rules(spark, *rows):
    base = {"id": "r", "ts": NOW, "rule_type": "event_window", "instrument": "NQ", "window": None, "action": "veto",
            "params": {}, "audit_id": 1, "active": True}
    return spark.createDataFrame([{**base, "id": f"r{i}", **r} for i, r in enumerate(rows)], RULES)


WINDOW = {"event": "FOMC", "event_ts": NOW, "pre_min": 30.0, "post_min": 30.0}


def test_event_window_veto(spark):
    m = lambda n: {"created_at": NOW + dt.timedelta(minutes=n)}
    df = frame(spark, m(10), m(180), m(30), m(-30), {**m(10), "symbol": "ES"})
    v = verdicts(risk.attach_rules(df, _rules(spark, {"window": WINDOW})))
    assert [v[f"s{i}"].verdict for i in range(5)] == ["REJECT", "APPROVE", "REJECT", "REJECT", "APPROVE"]
    assert v["s0"].reasons == ["ONTOLOGY[r0]: event_window vetoes NQ (FOMC)"]
    assert v["s0"].checks_performed["ontology:r0"] is False


def test_rules_without_window_and_inactive(spark):
    df = frame(spark, {}, {"symbol": "ES"})
    got = ontology.matching_rules(
        df,
        _rules(spark, {"rule_type": "instrument_block", "window": {**WINDOW, "event_ts": NOW + dt.timedelta(99)}},
               {"instrument": None}, {"active": False}),
    )
    assert {(r.signal_id, r.id) for r in got.collect()} == {("s0", "r0"), ("s0", "r1"), ("s1", "r1")}


def test_size_down_multiplies_and_clamps(spark):
    df = frame(spark, {"suggested_size_contracts": 10, "risk_per_contract_usd": D("10")})
    down = lambda x: {"action": "size_down", "params": x}
    r = _rules(spark, down({"size_mult": "0.7"}), down({"size_mult": "5"}), down({}))
    v = verdicts(risk.attach_rules(df, r))["s0"]
    assert v.approved_size_contracts == 3 and v.verdict == "APPROVE"
    m = ontology.size_multipliers(ontology.matching_rules(df, r)).first()
    assert abs(m.ontology_mult - 0.35) < 1e-12 and m.n_size_down == 3
    assert verdicts(risk.attach_rules(df, _rules(spark, down({"size_mult": "-1"}))))["s0"].verdict == "REJECT"


def test_drawdowns_are_rounded_as_the_statement_rounds_them(spark):
    """Seven decimals that end in 5: the halves go by the product in binary."""
    cases = [(1.0418275, 1.041827), (1.0437115, 1.043711), (1.0418275, 1.041827)]
    got = spark.createDataFrame([(x,) for x, _ in cases], "dd double").select("dd", drawdown_pct(F.col("dd")).alias("r")).collect()
    assert [(x.dd, x.r) for x in got] == cases and len(cases) == 3


def test_global_gates_where_all_rows_are_of_one_month(spark):
    rng = np.random.default_rng(2)
    steps = rng.normal(0, 4000, (3, 60)).cumsum(axis=1) + 100_000
    rows = [(NOW + dt.timedelta(minutes=7 * int(i)), f"s{k}", "B", float(steps[k, i])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, sleeve_id string, track string, equity double")
    levels = {(r.ts, r.sleeve_id): r.gate_level for r in gates.gate_history(df).collect()}
    got = gates.gate_history(df, scope="global", piece_rows=11)
    before = None
    for r in got.orderBy("ts", "sleeve_id").collect():
        assert (r.previous_level, r.gate_level) == (before, levels[r.ts, r.sleeve_id])
        before = r.gate_level
    assert got.count() == 180 and got.where("tripped").count() > 20


def test_effects_of_rules_with_and_without_limits(spark):
    """Folding rules that hold at any time gives what all pairs give."""
    m = lambda n, s: {"created_at": NOW + dt.timedelta(minutes=n), "symbol": s}
    df = frame(spark, *[m(n, s) for n in (-40, 0, 29, 400) for s in ("NQ", "ES", "GC")])
    far = {**WINDOW, "event_ts": NOW + dt.timedelta(days=9)}
    half = {"action": "size_down", "params": {"size_mult": "0.5"}}
    r = _rules(
        spark, {"window": WINDOW}, {"instrument": None, **half}, {**half, "instrument": "ES"}, {"window": far, **half},
        {"rule_type": "instrument_block", "instrument": "GC", "ts": NOW - dt.timedelta(1)}, {"instrument": None, "window": WINDOW, **half},
        {"instrument": None, "active": False},
    )
    each = lambda x: (x.signal_id, sorted(x.rule_ids), x.vetoes, round(x.ontology_mult, 12))
    want = ontology.rule_effects(ontology.matching_rules(df, r))
    got = ontology.signal_effects(df, r)
    assert sorted(map(each, got.collect())) == sorted(map(each, want.collect())) and got.count() == 12
    down = {x.signal_id: (x.n_size_down, x.ontology_mult) for x in ontology.size_multipliers(ontology.matching_rules(df, r)).collect()}
    assert {x.signal_id: (x.n_size_down, x.ontology_mult) for x in got.where("n_size_down > 0").collect()} == down


def test_rule_counts_are_those_of_the_lists(spark):
    """Steps of time give the numbers of the lists: touching and overlapping windows, repeated ids, any instrument, any time."""
    m = lambda n, s: {"created_at": NOW + dt.timedelta(minutes=n), "symbol": s, "suggested_size_contracts": 10, "risk_per_contract_usd": D("10")}
    df = frame(spark, *[m(n, s) for n in (-90_000, -41, -30, 0, 29, 30, 31, 400, 90_000) for s in ("NQ", "ES", "GC", "XX", None)])
    at = lambda n, pre, post: {"window": {"event": "E", "event_ts": NOW + dt.timedelta(minutes=n), "pre_min": pre, "post_min": post}}
    down = lambda x: {"action": "size_down", "params": {"size_mult": x}}
    r = _rules(
        spark, at(0, 30.0, 30.0), {**at(0, 30.0, 30.0), **down("0.7"), "id": "twice"}, {**at(20, 40.0, 90.0), **down("0.5"), "id": "twice"},
        {**at(200, 0.0, 300.0), **down("0"), "id": "twice"}, {"instrument": None, **down("0.5")}, {"instrument": None, **at(0, 30.0, 0.0), **down("0.7")},
        {"instrument": "ES", **down("0.9")}, {"instrument": "ES", **at(0, -5.0, -5.0)}, {"instrument": "GC", "rule_type": "instrument_block"},
        {"instrument": None, "active": False},
    )
    lists = {x.signal_id: (len(set(x.rule_ids)), len(x.vetoes), x.n_size_down, round(x.ontology_mult, 12)) for x in ontology.signal_effects(df, r).collect()}
    got = ontology.with_rule_counts(df, r).where("n_rules > 0")
    assert {x.signal_id: (x.n_ids, x.n_vetoes, x.n_size_down, round(x.ontology_mult, 12)) for x in got.collect()} == lists
    assert len(lists) == 45 and {x[0] for x in lists.values()} == {1, 2, 3, 4}
    long, short = (verdicts(risk.attach_rules(df, r, lists=x)) for x in (True, False))
    told = lambda v: (v.verdict, v.approved_size_contracts, v.n_checks, v.requires_human_confirm)
    assert {k: told(v) for k, v in long.items()} == {k: told(v) for k, v in short.items()}
    assert all(v.n_checks == len(v.checks_performed) for v in long.values())


def test_rule_counts_without_pairs(spark):
    """Rows of the steps follow the rules, not signals times rules."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("signal_id"), F.lit(NOW).alias("created_at"), F.lit("NQ").alias("symbol"))
    r = _rules(spark, *[{"window": WINDOW, "action": "size_down", "params": {"size_mult": "0.999"}} for _ in range(300)])
    assert ontology.rule_steps(r).count() == 2
    got = ontology.with_rule_counts(df, r).select("n_ids", F.round("ontology_mult", 12).alias("m")).distinct().collect()
    assert [(x.n_ids, x.m) for x in got] == [(300, round(0.999**300, 12))]
    assert ontology.with_rule_counts(df, r.limit(0)).where("n_rules is null").count() == 2000


def test_slug_and_requests(spark):
    req = spark.createDataFrame(
        [("No NQ at FOMC!", "veto", None), ("¿¡!?", "size_down", None), ("x", "approve", None), ("y", "veto", "mine")],
        "description string, action string, rule_id string",
    )
    ok, bad = ontology.split_requests(req)
    assert sorted(r.id for r in ok.collect()) == ["mine", "rule_no_nq_at_fomc", "rule_unnamed"]
    assert bad.first().error == "action must restrict: approve"


def test_signal_geometry(spark):
    df = frame(spark, {}, {"stop_loss": D("101")}, {"direction": "SHORT"}, {"confidence": 1.1}, {"justification": "short"})
    got = {r.signal_id: r.problems for r in rules.signal_problems(df).collect()}
    assert got == {"s0": [], "s1": ["stop_side"], "s2": ["stop_side", "target_side"], "s3": ["confidence"], "s4": ["justification"]}


def test_as_of_account(spark):
    snaps = spark.createDataFrame(
        [{"account_id": "a", "snapshot_at": NOW + dt.timedelta(days=d), **ACCOUNT, "equity_usd": D(e)} for d, e in ((-40, "1"), (-1, "50000"), (1, "2"))],
        ACCOUNT_STATE,
    )
    sig = frame(spark).drop("firm", *[k for k in ACCOUNT]).withColumn("account_id", F.lit("a"))
    out = risk.evaluate_signals(sig, snaps).first()
    assert out.verdict == "APPROVE" and out.approved_size_contracts == 2


EQ = "sleeve_id string, track string, ts timestamp, equity double"


def _equity(spark, values, sleeve="s"):
    return spark.createDataFrame([(sleeve, "B", NOW + dt.timedelta(days=20 * i), float(v)) for i, v in enumerate(values)], EQ)


def test_gate_ladder(spark):
    rows = gates.gate_history(_equity(spark, [100000, 94000, 89000, 84000, 79000])).orderBy("ts").collect()
    assert [r.gate_level for r in rows] == ["normal", "dd5", "dd10", "dd15", "halt"]
    assert [r.tripped for r in rows] == [False, True, True, True, True]
    assert [r.previous_level for r in rows] == [None, "normal", "dd5", "dd10", "dd15"]
    assert [r.sizing_mult for r in rows] == [1.0, 0.5, 0.25, 0.125, 0.0]
    trips = gates.gate_trip_events(gates.gate_history(_equity(spark, [100000, 94000, 100001])))
    assert [r.event_key for r in trips.orderBy("ts").collect()] == ["dd5", "normal"]


def test_gate_edges(spark):
    rows = gates.gate_history(_equity(spark, [-5, -10, 0], None)).collect()
    assert {(r.gate_level, r.current_dd_pct, r.sleeve_id) for r in rows} == {("normal", 0.0, None)}
    both = _equity(spark, [100, 94], "a").unionByName(_equity(spark, [100, 100], "b"))
    glob = gates.gate_history(both, scope="global").orderBy("ts", "sleeve_id").collect()
    assert [r.previous_level for r in glob] == [None, "normal", "normal", "dd5"]
    assert glob[3].tripped and glob[3].sleeve_id == "b"
    assert gates.unique_equity(both.union(both)).count() == 4


@pytest.mark.parametrize("dd,level", [(-0.1, "normal"), (0.0499, "normal"), (0.06, "dd5"), (0.10, "dd10"), (0.15, "dd15"), (0.25, "halt")])
def test_level_for_drawdown(spark, dd, level):
    assert spark.range(1).select(drawdown_level(F.lit(dd)).alias("x")).first().x == level


def test_sizing_only_reduces(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(apply_sizing(F.lit(2), F.lit(0.25))) == 0
    assert one(apply_sizing(F.lit(8), F.lit(0.25))) == 2
    assert one(apply_sizing(F.lit(3), F.lit(7.0))) == 3
    assert one(apply_sizing(F.lit(3), F.lit(None).cast("double"))) == 3
    assert one(go_verdict(F.lit(None).cast("double"), F.lit(0.1))) == "PENDING"
    assert one(go_verdict(F.lit(0.1), F.lit(0.5))) == "NO-GO"
    assert one(shift_posterior(F.lit(-1.0))) == 0.0


def test_cost_is_monotone_and_convex(spark):
    bars = synthetic_bars(spark, ["NQ"], n=600, seed=5)
    cal = calibrate(bars)
    rows = {r.hour_utc: r for r in cal.collect()}
    assert sum(r.n_samples for r in rows.values()) == 600 and rows[3].tick_value == 5.0
    pdf = bars.toPandas()
    h = pdf[pdf.ts.dt.hour == 3].sort_values("ts")
    spread = np.maximum(1.0, 0.1 * (h.high - h.low) / 0.25)
    assert abs(rows[3].spread_ticks_p95 - np.percentile(spread, 95)) < 1e-9
    sigma = np.std(np.diff(np.log(h.close)))
    assert abs(rows[3].impact_eta - 0.1 * sigma * h.close.mean() / max(h.volume.mean(), 1)) < 1e-12
    sizes = spark.createDataFrame([("NQ", 3, s) for s in (1, 3, 5, 10, -10, 20)] + [("NQ", 23, 1)], "instrument string, hour_utc int, size int")
    cost = {r["size"]: r.cost for r in order_cost(sizes, cal).where("hour_utc = 3").collect()}
    assert cost[1] < cost[5] < cost[20] and cost[20] > 2 * cost[10] and cost[10] == cost[-10]
    assert order_cost(sizes, cal).where("hour_utc = 23").first().cost is None
    assert order_cost(sizes, cal, missing="zero").where("hour_utc = 23").first().cost == 0.0
    with pytest.raises(Exception, match="no calibration"):
        order_cost(sizes, cal, missing="error").collect()


def test_latest_calibration_wins(spark):
    row = lambda d, s: ("NQ", 1, NOW + dt.timedelta(d), s, s, 0.0, 0.0, 0.0, 9, 5.0)
    cal = spark.createDataFrame([row(0, 2.0), row(1, 4.0)], CALIBRATIONS)
    orders = spark.createDataFrame([("NQ", 1, 1)], "instrument string, hour_utc int, size int")
    assert order_cost(orders, cal).first().cost == 10.0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_table(spark, path, "k int, v string").count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    append(old, path)
    have = read_table(spark, path, "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "k int, v string, o int")
    up = upsert(have.withColumn("o", F.lit(0)), new, ["k"], ["o"])
    assert {(r.k, r.v) for r in up.collect()} == {(1, "a"), (2, "c"), (3, "e")}
    ins = insert_absent(have, new, ["k"], ["o"])
    assert {(r.k, r.v) for r in ins.collect()} == {(3, "d")}


def test_constraints(spark):
    t = spark.createDataFrame([(1, "A", "long", "filled"), (2, "X", "long", "lost"), (3, None, "flat", "vetoed")], "id int, track string, side string, status string")
    bad = {r.check: r.n_bad for r in quality.check_counts(t, quality.table_checks()["trades"]).collect()}
    assert bad == {"track": 2, "side": 0, "status": 1}
    assert {r.check: r.n_bad for r in quality.null_counts(t, ["track", "id"]).collect()} == {"track": 1, "id": 0}
    dup = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "a int, b int")
    assert [(r.a, r.n) for r in quality.unique_violations(dup, ["a", "b"]).collect()] == [(2, 2)]
    ex = spark.createDataFrame([(1,), (2,), (9,)], "trade_id int")
    assert {r.trade_id for r in quality.unfilled_executions(ex, t).collect()} == {2, 9}
    assert [r.trade_id for r in quality.orphans(ex, "trade_id", t, "id").collect()] == [9]
