"""Overfitting statistics against numpy restatements of the published formulas."""

from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from quantspan.operators.bma import bma_weights
from quantspan.operators.crossval import cpcv_splits, n_paths, path_sharpes
from quantspan.operators.pbo import cscv_logits, pbo
from quantspan.operators.quality import weight_sums
from quantspan.operators.sharpe import cell_moments, config_stats, sharpe_moments
from quantspan.operators.validation import run_validation, validate_sleeves
from quantspan.sources.bars import synthetic_bars

T, C = 1000, 20


def robust():
    m = np.random.default_rng(0).normal(0, 0.01, (T, C))
    m[:, 0] += 0.004
    return m


def overfit():
    m = np.random.default_rng(1).normal(0, 0.01, (T, C))
    drift = np.linspace(-0.004, 0.004, C)
    m[: T // 2] += drift
    m[T // 2 :] -= drift
    return m


def long(spark, **series):
    parts = [
        pd.DataFrame({"sleeve_id": k, "config_id": np.tile(np.arange(m.shape[1]), len(m)).astype("int32"),
                      "t": np.repeat(np.arange(len(m)), m.shape[1]), "ret": m.ravel()})
        for k, m in series.items()
    ]
    return spark.createDataFrame(pd.concat(parts))


def sharpe(x):
    return x.mean() / x.std(ddof=1)


def numpy_pbo(m, s=10):
    parts = np.array_split(np.arange(len(m)), s)
    logits = []
    for inside in combinations(range(s), s // 2):
        a = np.concatenate([parts[i] for i in inside])
        b = np.concatenate([parts[i] for i in range(s) if i not in inside])
        best = int(np.argmax([sharpe(m[a, j]) for j in range(m.shape[1])]))
        oos = np.array([sharpe(m[b, j]) for j in range(m.shape[1])])
        w = (1 + (oos < oos[best]).sum()) / (m.shape[1] + 1)
        logits.append(np.log(w / (1 - w)))
    return float(np.mean(np.array(logits) <= 0)), float(np.median(logits))


@pytest.fixture(scope="module")
def panels(spark):
    return {"robust": robust(), "overfit": overfit(), "short": robust()[:403, :5]}


@pytest.fixture(scope="module")
def moments(spark, panels):
    return cell_moments(long(spark, **panels), 6, 10).cache()


def test_pbo_matches_numpy(moments, panels):
    got = {r.sleeve_id: r for r in pbo(moments).collect()}
    for name, m in panels.items():
        p, med = numpy_pbo(m)
        assert got[name].n_combos == 252
        assert abs(got[name].pbo - p) < 1e-12 and abs(got[name].median_logit - med) < 1e-9
    assert got["overfit"].pbo > 0.5 and got["robust"].pbo < 0.1


def test_average_rank_on_ties(spark):
    m = np.tile(np.random.default_rng(2).normal(size=(40, 1)), (1, 3))
    rows = cscv_logits(cell_moments(long(spark, tie=m), 6, 4), 4).collect()
    assert {r.oos_rank for r in rows} == {2.0} and {r.best_config for r in rows} == {0}


def test_bad_parameters(spark, moments):
    with pytest.raises(ValueError):
        pbo(moments, 5)
    with pytest.raises(ValueError):
        path_sharpes(moments, 6, 6)
    with pytest.raises(Exception, match="two configs"):
        pbo(cell_moments(long(spark, one=robust()[:, :1]), 6, 10)).collect()
    with pytest.raises(Exception, match="fewer observations"):
        pbo(cell_moments(long(spark, tiny=robust()[:6]), 6, 10)).collect()


def test_config_stats_merge_exactly(spark, moments, panels):
    a = config_stats(moments).toPandas().sort_values(["sleeve_id", "config_id"]).reset_index(drop=True)
    b = sharpe_moments(long(spark, **panels)).toPandas().sort_values(["sleeve_id", "config_id"]).reset_index(drop=True)
    for c in ("mean", "std", "sharpe", "skew", "kurt"):
        assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-12)
    x = panels["robust"][:, 3]
    row = a[(a.sleeve_id == "robust") & (a.config_id == 3)].iloc[0]
    z = x - x.mean()
    assert abs(row["skew"] - (z**3).mean() / (z**2).mean() ** 1.5) < 1e-9
    assert abs(row["kurt"] - (z**4).mean() / (z**2).mean() ** 2) < 1e-9


def test_constant_and_single_series(spark):
    m = np.full((30, 2), 0.1)
    assert {r.sharpe for r in sharpe_moments(long(spark, flat=m)).collect()} == {0.0}
    one = sharpe_moments(long(spark, one=m[:1])).first()
    assert (one["sharpe"], one["skew"], one["kurt"]) == (0.0, 0.0, 3.0)


@pytest.mark.parametrize("n", [61, 240])
def test_cpcv_roles(spark, n):
    idx = long(spark, s=np.zeros((n, 1))).select("sleeve_id", "t")
    got = cpcv_splits(idx, embargo_pct=0.03, purge_pct=0.05).toPandas()
    groups = np.array_split(np.arange(n), 6)
    assert n_paths(6, 2) == got["combo_id"].nunique() == 15
    for i, combo in enumerate(combinations(range(6), 2)):
        role = got[got.combo_id == i].set_index("t")["role"]
        test = np.concatenate([groups[g] for g in combo])
        near = set()
        for t in test:
            near |= set(range(t - round(0.05 * n), t + round(0.03 * n) + 1))
        for t in range(n):
            want = "test" if t in set(test) else "dropped" if t in near else "train"
            assert role[t] == want


def test_run_validation_matches_numpy(spark, panels):
    got = {r.sleeve_id: r for r in run_validation(long(spark, **panels)).collect()}
    norm = NormalDist()
    for name, m in panels.items():
        srs = np.array([sharpe(m[:, j]) for j in range(m.shape[1])])
        best = int(np.argmax(srs))
        x, n, trials = m[:, best], len(m), m.shape[1]
        groups = np.array_split(np.arange(n), 6)
        paths = [sharpe(x[np.concatenate([groups[g] for g in c])]) for c in combinations(range(6), 2)]
        z = x - x.mean()
        g3, g4 = (z**3).mean() / (z**2).mean() ** 1.5, (z**4).mean() / (z**2).mean() ** 2
        e = 0.5772156649015329
        sr0 = np.sqrt(srs.var(ddof=1)) * ((1 - e) * norm.inv_cdf(1 - 1 / trials) + e * norm.inv_cdf(1 - 1 / (trials * np.e)))
        dsr = norm.cdf((srs[best] - sr0) * np.sqrt(n - 1) / np.sqrt(1 - g3 * srs[best] + (g4 - 1) / 4 * srs[best] ** 2))
        eq = np.cumprod(1 + x)
        dd = ((np.maximum.accumulate(eq) - eq) / np.maximum.accumulate(eq)).max()
        r = got[name]
        assert r.candidate_col == best and r.n_paths == 15
        assert np.allclose(
            [r.sharpe_mean, r.sharpe_std, r.dsr, r.max_dd_pct, r.calmar],
            [np.mean(paths), np.std(paths, ddof=1), dsr, dd, np.mean(paths) / dd],
        )


def test_validate_sleeves_gives_a_verdict(spark):
    row = validate_sleeves(synthetic_bars(spark, ["A"], n=400, seed=1), (10, 20, 30), seconds=3600).first()
    assert row.verdict in ("GO", "NO-GO") and 0 <= row.dsr <= 1 and 0 <= row.pbo <= 1 and row.n_configs == 3


def _three(spark):
    rng = np.random.default_rng(7)
    s = {"good": 0.0045, "medium": 0.0012, "bad": -0.0005}
    rows = [(k, float(x)) for k, mu in s.items() for x in rng.normal(mu, 0.01, 800)]
    return spark.createDataFrame(rows, "sleeve_id string, ret double")


def test_bma_orders_by_skill(spark):
    w = bma_weights(_three(spark))
    by = {r.sleeve_id: r for r in w.collect()}
    assert by["good"].weight > by["medium"].weight > by["bad"].weight
    assert abs(sum(r.weight for r in by.values()) - 1) < 1e-12
    assert by["bad"].log_evidence == 0.0 or by["bad"].post_z > 0
    assert weight_sums(w).count() == 0


def test_bma_priors(spark):
    df = _three(spark)
    zero = {r.sleeve_id: r.weight for r in bma_weights(df, prior={"good": 0.0, "bad": 1.0}).collect()}
    assert zero == {"good": 0.0, "medium": 0.0, "bad": 1.0}
    assert {round(r.prior, 9) for r in bma_weights(df, prior={}).collect()} == {round(1 / 3, 9)}
    with pytest.raises(ValueError):
        bma_weights(df, prior={"good": -1.0})


def test_bma_ignores_non_finite_and_short(spark):
    df = spark.createDataFrame(
        [("a", 0.1), ("a", float("nan")), ("a", 0.2), ("a", float("inf")), ("b", 0.5), ("c", None)],
        "sleeve_id string, ret double",
    )
    by = {r.sleeve_id: r for r in bma_weights(df).collect()}
    assert (by["a"].n_obs, by["b"].n_obs, by["c"].n_obs) == (2, 1, 0)
    assert by["b"].log_evidence == 0.0 and by["b"].weight < by["a"].weight
