"""Rolling windows, features, labels and signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspan.operators import regime
from quantspan.sources.bars import synthetic_bars


def test_wilder_end_is_a_shift(spark):
    rows = [(k, [100.0 + (i % 2) * a for i, a in enumerate(steps)]) for k, steps in enumerate(([1.0] * 80 + [5.0] * 20, [5.0] * 80 + [1.0] * 20, [1.0] * 5))]
    df = spark.createDataFrame(rows, "k int, closes array<double>")
    assert [r.regime_label for r in regime.volatility_labels(df).orderBy("k").collect()] == ["shift", "stable", "stable"]


def test_features(spark):
    d = "array<struct<birth:double,death:double>>"
    df = spark.createDataFrame([([(0.0, 1.0), (0.0, 3.0)], [], [(1.0, 2.0)])], f"h0 {d}, none {d}, h1 {d}")
    a = df.select(*regime.diagram_features(F.col("h0"), F.col("none"))).first()
    assert (a.mu, a["var"], a.n_h0, a.n_h1, a.max_lifetime_h1) == (2.0, 1.0, 2, 0, 0.0)
    assert abs(a.persistence_entropy + 0.25 * np.log(0.25) + 0.75 * np.log(0.75)) < 1e-12
    assert df.select(*regime.diagram_features(F.col("h0"), F.col("h1"))).first().mu == 1.0


def test_windows(spark):
    bars = synthetic_bars(spark, ["A", "B"], n=205, seed=1)
    close = bars.where("instrument = 'A'").orderBy("ts").toPandas()["close"].to_numpy()
    rows = regime.decision_windows(bars, warmup=30, step=7, seconds=600).where("instrument = 'A'").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(30, 204, 7))
    for r in rows:
        assert np.allclose(r.closes, close[r.pos - 30 : r.pos]) and r.close == close[r.pos]
    assert [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True]
    with pytest.raises(Exception, match="too short"):
        regime.embedded_windows(regime.decision_windows(bars, warmup=6, step=50)).collect()


def test_signal_follows_or_fades(spark):
    closes = [100.0 + i for i in range(40)]
    df = spark.createDataFrame([("NQ", 1, closes, 141.0, "stable"), ("NQ", 2, closes, 141.0, "shift"), ("NQ", 3, [5.0] * 40, 5.0, "stable")],
                               "instrument string, pos long, closes array<double>, close double, regime_label string")
    got = {r.pos: r for r in regime.regime_signals(df).collect()}
    assert (got[1].direction, got[2].direction, got[3].direction) == ("LONG", "SHORT", "LONG")
    assert got[1].stop_loss == 140.75 and got[1].take_profit_1 == 141.62  # one tick of risk; ties to even
    assert got[1].risk_per_contract_usd == 5.0
