"""Loading, normalising and validating bars; synthetic bars; bars from ticks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspan.operators.bars import bar_quality, require_valid, split_valid
from quantspan.operators.returns import bar_returns, max_drawdown, strategy_returns
from quantspan.sources.bars import (
    BarError,
    bars_from_events,
    bar_names,
    first_source,
    map_proxies,
    read_bars,
    read_cached_bars,
    synthetic_bars,
    write_bars,
)

HEAD = "Date,Open,High,Low,Close,Volume\n"


def _csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_alias_and_unsorted_csv(spark, tmp_path):
    path = _csv(tmp_path, "X.csv", HEAD + "2024-01-03,3,4,2,3.5,30\n2024-01-01,9,11,8,10.0,10\n2024-01-02,2,3,1,2.5,20\n")
    rows = read_bars(spark, path).orderBy("ts").collect()
    assert [r.close for r in rows] == [10.0, 2.5, 3.5]
    assert {r.instrument for r in rows} == {"X"}
    assert list(bar_names([" Adj Close "])) == ["close"]


def test_last_duplicate_wins(spark, tmp_path):
    path = _csv(tmp_path, "D.csv", HEAD + "2024-01-01,1,2,1,1.5,1\n2024-01-01,1,3,1,2.5,2\n")
    assert [r.close for r in read_bars(spark, path).collect()] == [2.5]


@pytest.mark.parametrize(
    "row,check",
    [("1,8,9,8.5,1", "high_below_low"), ("abc,9,8,8.5,1", "not_numeric"), ("8.5,9,8,8.5,-1", "negative_volume")],
)
def test_bad_rows_are_named(spark, tmp_path, row, check):
    bars = read_bars(spark, _csv(tmp_path, "B.csv", HEAD + f"2024-01-01,{row}\n2024-01-02,8.5,9,8,8.5,1\n"))
    assert bar_quality(bars).first()[check] == 1
    good, bad = split_valid(bars)
    assert good.count() == 1 and check in bad.first().violations
    with pytest.raises(BarError, match=check):
        require_valid(bars)


def test_layout_errors(spark, tmp_path):
    with pytest.raises(BarError, match="missing"):
        read_bars(spark, _csv(tmp_path, "M.csv", "Date,Open,High,Low,Close\n2024-01-01,1,2,1,1\n"))
    with pytest.raises(BarError, match="several"):
        read_bars(spark, _csv(tmp_path, "A.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,1,2,1,1,1,1\n"))
    with pytest.raises(BarError, match="unsupported"):
        read_bars(spark, _csv(tmp_path, "a.xls", ""))
    with pytest.raises(BarError, match="no such file"):
        read_bars(spark, str(tmp_path / "none.csv"))
    with pytest.raises(BarError, match="no time column"):
        read_bars(spark, _csv(tmp_path, "T.csv", "Open,High,Low,Close,Volume\n1,2,1,1,1\n"))


def test_vendor_frame_drops_adjusted(spark, tmp_path):
    path = _csv(tmp_path, "V.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,1,2,1,1.5,1.4,1\n")
    assert read_bars(spark, path, drop_adjusted=True).first().close == 1.5


def test_cache_fallback_and_proxies(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    row = "2024-01-01,1,2,1,{},1\n"
    _csv(one, "GLD_1d.csv", HEAD + row.format(1.1))
    _csv(two, "GLD_1d.csv", HEAD + row.format(1.9))
    _csv(two, "QQQ_1d.csv", HEAD + row.format(1.2))
    _csv(two, "ZZZ_1d.csv", HEAD + row.format(1.3))
    bars = first_source([read_cached_bars(spark, str(one)), read_cached_bars(spark, str(two))])
    assert {(r.instrument, r.close) for r in map_proxies(bars).collect()} == {("GC", 1.1), ("NQ", 1.2)}


def test_write_and_read_back(spark, tmp_path):
    bars = synthetic_bars(spark, ["A", "B"], n=50)
    write_bars(bars, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and set(back.columns) == set(bars.columns)


def test_synthetic_bars(spark):
    bars = synthetic_bars(spark, ["A"], n=3000, seed=7, shift_at=1500, block=512)
    require_valid(bars)
    again = synthetic_bars(spark.newSession(), ["A"], n=3000, seed=7, shift_at=1500, block=512).repartition(7)
    a, b = (x.orderBy("ts").toPandas() for x in (bars, again))
    assert np.allclose(a["close"], b["close"], rtol=1e-12)
    assert np.allclose(a["open"].iloc[1:], a["close"].iloc[:-1], rtol=1e-9) and a["open"].iloc[0] == 100.0
    r = np.diff(np.log(a["close"]))
    assert 3.4 < r[1500:].std() / r[:1499].std() < 4.6
    assert a["volume"].between(100, 9999).all()
    with pytest.raises(BarError):
        synthetic_bars(spark, ["A"], n=0)


def test_bars_from_ticks(spark):
    ticks = spark.createDataFrame(
        [(1, "a", "2024-01-01 00:00:01", 5.0), (0, "a", "2024-01-01 00:00:01", 3.0), (2, "a", "2024-01-01 00:59:59", 4.0),
         (3, "a", "2024-01-01 01:00:00", 7.0), (4, "b", "2024-01-01 00:30:00", 1.0)],
        "event_id long, event_type string, ts string, value double",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = {(r.instrument, str(r.ts)): r for r in bars_from_events(ticks).collect()}
    first = rows[("a", "2024-01-01 00:00:00")]
    assert (first.open, first.high, first.low, first.close, first.volume) == (3.0, 5.0, 3.0, 4.0, 3.0)
    assert len(rows) == 3


def _close(bars):
    return bars.orderBy("ts").toPandas()["close"].to_numpy()


def _panel_numpy(close, lookbacks):
    ret = np.concatenate([[0.0], close[1:] / close[:-1] - 1])
    cols = []
    for lb in lookbacks:
        vol = np.full(len(close), np.nan)
        for i in range(lb - 1, len(close)):
            vol[i] = ret[i - lb + 1 : i + 1].std(ddof=1)
        mom = np.zeros(len(close))
        mom[lb:] = np.sign(close[lb:] - close[:-lb])
        with np.errstate(invalid="ignore"):
            side = np.where(vol > np.nanmedian(vol), -mom, mom)
        cols.append(np.concatenate([[0.0], side[:-1]])[max(lookbacks) + 1 :] * ret[max(lookbacks) + 1 :])
    return np.column_stack(cols)


@pytest.mark.parametrize("block", [64, 8192])
def test_strategy_panel_matches_numpy(spark, block):
    bars = synthetic_bars(spark, ["A"], n=400, seed=2)
    want = _panel_numpy(_close(bars), (5, 12))
    got = strategy_returns(bars, (5, 12), seconds=3600, block=block).toPandas()
    got = got.pivot(index="t", columns="config_id", values="ret").to_numpy()
    assert got.shape == want.shape
    assert np.allclose(got, want, atol=1e-10)


def test_returns_and_drawdown_across_blocks(spark):
    bars = synthetic_bars(spark, ["A"], n=300, seed=4, vol=0.05)
    close = _close(bars)
    rows = bar_returns(bars, seconds=1800).orderBy("ts").toPandas()
    assert np.isnan(rows["log_ret"].iloc[0]) and rows["simple_ret"].iloc[0] == 0.0
    assert np.allclose(rows["log_ret"].iloc[1:], np.diff(np.log(close)))
    ret = rows["simple_ret"].to_numpy()
    panel = spark.createDataFrame([("s", 0, i, float(x)) for i, x in enumerate(ret)], "sleeve_id string, config_id int, t long, ret double")
    eq = np.cumprod(1 + ret)
    peak = np.maximum.accumulate(eq)
    assert abs(max_drawdown(panel, block=37).first()["max_dd"] - ((peak - eq) / peak).max()) < 1e-12


def test_zero_price_and_total_loss_do_not_stop_the_job(spark):
    bars = spark.createDataFrame([("A", i, float(c)) for i, c in enumerate((1, 0, 2))], "instrument string, s long, close double")
    rows = bar_returns(bars.select("instrument", F.timestamp_seconds("s").alias("ts"), "close")).orderBy("ts").collect()
    assert [r.simple_ret for r in rows] == [0.0, -1.0, 0.0]
    panel = spark.createDataFrame([("s", 0, 0, -1.0), ("s", 0, 1, 0.1)], "sleeve_id string, config_id int, t long, ret double")
    assert max_drawdown(panel).first()["max_dd"] is None


def test_first_bar_loss_is_no_drawdown(spark):
    panel = spark.createDataFrame([("s", 0, 0, -0.5), ("s", 0, 1, 0.1)], "sleeve_id string, config_id int, t long, ret double")
    assert max_drawdown(panel).first()["max_dd"] == 0.0
