"""Blocked windows, as-of and interval joins, exact percentiles against plain pandas/numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspan.functions.quantile import exact_percentile
from quantspan.plans.asof import asof_join
from quantspan.plans.blocks import array_split_block, array_split_start, with_halo, with_positions
from quantspan.plans.combinations import mask_at, with_masks
from quantspan.plans.fold import ordered_fold
from quantspan.plans.intervals import dyadic_pieces, interval_join


def _series(n=500, seed=1):
    rng = np.random.default_rng(seed)
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.choice(60 * 24 * 40, n, replace=False), unit="min")
    return pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", "cold"), "ts": ts, "v": rng.normal(size=n)})


def test_positions_are_dense_over_buckets(spark):
    pdf = _series()
    got = with_positions(spark.createDataFrame(pdf), ["k"], "ts", total="n").toPandas().sort_values(["k", "ts"])
    want = pdf.sort_values(["k", "ts"])
    assert list(got["pos"]) == list(want.groupby("k").cumcount())
    assert (got["n"] == got["k"].map(pdf["k"].value_counts())).all()


def test_halo_copies_the_tail_of_each_block(spark):
    df = spark.range(25).select(F.col("id").alias("pos"))
    out = with_halo(df, "pos", back=3, size=10).toPandas()
    assert sorted(out[(out.blk == 1) & out.halo].pos) == [7, 8, 9]
    assert sorted(out[(out.blk == 1) & ~out.halo].pos) == list(range(10, 20))
    assert (~out.halo).sum() == 25


@pytest.mark.parametrize("n,parts", [(10, 3), (11, 3), (12, 3), (7, 7), (100, 6)])
def test_array_split(spark, n, parts):
    df = spark.range(n).select(array_split_block(F.col("id"), F.lit(n), parts).alias("b"))
    got = [r.b for r in df.collect()]
    split = np.array_split(np.arange(n), parts)
    assert got == [i for i, s in enumerate(split) for _ in s]
    starts = spark.range(parts + 1).select(array_split_start(F.col("id"), F.lit(n), parts).alias("s"))
    assert [r.s for r in starts.collect()] == [int(s[0]) for s in split] + [n]


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, p):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 4000, p=[0.8, 0.19, 0.01]), "v": rng.normal(size=4000).round(2)})
    df = spark.createDataFrame(pdf).repartition(4)
    got = exact_percentile(df, ["k"], "v", p, "q").toPandas().set_index("k")["q"]
    want = pdf.groupby("k")["v"].quantile(p)
    assert np.allclose(got.loc[want.index], want, atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 41])
def test_exact_percentile_of_few(spark, n):
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    for p in (0.05, 0.5, 0.95):
        assert np.isclose(exact_percentile(df, ["k"], "v", p, "q").first()["q"], np.percentile(np.arange(n) ** 2.0, 100 * p))


def test_percentile_brackets_large_groups(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    want = df.agg(F.percentile("v", 0.5)).first()[0]
    assert exact_percentile(df, ["k"], "v", 0.5, "q").first()["q"] == want


def test_asof_matches_pandas(spark):
    left, right = _series(400, 2), _series(150, 4).rename(columns={"ts": "rts", "v": "rv"})
    got = asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "ts", "rts", seconds=86_400
    ).toPandas()
    want = pd.merge_asof(
        left.sort_values("ts"), right.sort_values("rts"), left_on="ts", right_on="rts", by="k", direction="backward"
    )
    a = got.sort_values(["k", "ts"]).reset_index(drop=True)
    b = want.sort_values(["k", "ts"]).reset_index(drop=True)
    assert a["rv"].isna().equals(b["rv"].isna())
    assert np.allclose(a["rv"].dropna(), b["rv"].dropna())


@pytest.mark.parametrize(("n", "k"), [(1, 1), (4, 0), (5, 2), (6, 3), (8, 8), (10, 4)])
def test_combinations_by_rank(spark, n, k):
    got = [r.m for r in spark.range(math.comb(n, k)).select("id", mask_at(F.col("id"), n, k).alias("m")).orderBy("id").collect()]
    assert got == [m for m in range(2**n) if m.bit_count() == k]


def test_many_combinations_are_spread(spark):
    """Half of 24 items: each once, by no task alone."""
    rows = with_masks(spark.createDataFrame([("a",)], "x string"), 24, 12)
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.bit_count("mask") != 12).alias("bad"))
    found = parts.collect()
    assert sum(r.n for r in found) == math.comb(24, 12) and not any(r.bad for r in found) and len(found) > 1
    assert rows.agg(F.count_distinct("mask")).first()[0] == math.comb(24, 12)


def test_dyadic_pieces_cover_once(spark):
    """Few pieces, which do not overlap, hold the range and little more."""
    rng = np.random.default_rng(4)
    ends = [(0, 0), (-1, 0), (-8, 7), (5, 4), (7, 8), (-(2**50), 2**50), (1, 2**40)]
    ends += [(int(a), int(a + w)) for a, w in zip(rng.integers(-(10**6), 10**6, 300), rng.integers(0, 10 ** rng.integers(1, 7, 300)))]
    df = spark.createDataFrame(ends, "lo long, hi long")
    for r in df.select("lo", "hi", dyadic_pieces(F.col("lo"), F.col("hi")).alias("p")).collect():
        spans = sorted((x.bucket << x.level, (x.bucket + 1) << x.level) for x in r.p)
        if r.hi < r.lo:
            assert not spans
            continue
        assert len(spans) <= 8 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[0][0] <= r.lo and r.hi < spans[-1][1]
        assert spans[-1][1] - spans[0][0] <= 1.25 * (r.hi - r.lo + 1)


def test_interval_join_without_ranges(spark):
    pts = spark.createDataFrame(_series(5).assign(id=range(5)))
    none = spark.createDataFrame([], "rid long, rk string, lo timestamp, hi timestamp")
    got = interval_join(pts, none, point_id="id", point_key="k", point_ts="ts", range_key="rk", lo="lo", hi="hi")
    assert got.columns == ["id", "rid", "rk", "lo", "hi"] and got.count() == 0


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_interval_join_matches_brute_force(spark, broadcast_rows):
    pts = _series(200, 5).assign(id=lambda d: range(len(d)))
    rng = np.random.default_rng(6)
    lo = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 60 * 24 * 40, 40), unit="min")
    hi = lo + pd.to_timedelta(rng.integers(0, 4000, 40), unit="min")
    rng_df = pd.DataFrame({"rid": range(40), "rk": rng.choice(["hot", "cold", None], 40), "lo": lo, "hi": hi})
    rng_df.loc[::7, ["lo", "hi"]] = pd.NaT
    rng_df["rk"] = rng_df["rk"].astype(object).where(rng_df["rk"].notna(), None)
    ranges = spark.createDataFrame(
        [
            tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r)
            for r in rng_df.itertuples(index=False)
        ],
        "rid long, rk string, lo timestamp, hi timestamp",
    )
    got = interval_join(
        spark.createDataFrame(pts), ranges, point_id="id", point_key="k", point_ts="ts", range_key="rk",
        lo="lo", hi="hi", broadcast_rows=broadcast_rows,
    )
    pairs = {(r.id, r.rid) for r in got.collect()}
    assert got.count() == len(pairs)
    want = {
        (p.id, r.rid)
        for p in pts.itertuples()
        for r in rng_df.itertuples()
        if (r.rk is None or r.rk == p.k) and (pd.isna(r.lo) or r.lo <= p.ts <= r.hi)
    }
    assert pairs == want


def test_ordered_fold_keeps_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), (100 - F.col("id")).alias("o"))

        def step(state, rows):
            total = []
            for o in rows["o"]:
                state[0] += o
                total.append(state[0])
            return rows.assign(run=total)[["k", "o", "run"]]

        out = ordered_fold(df, ["k"], ["o"], lambda _: [0], step, "k long, o long, run long").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, g in out.groupby("k"):
        g = g.sort_values("o")
        assert list(g["run"]) == list(g["o"].cumsum())


def test_ordered_fold_after_a_join_keeps_each_key_in_one_task(spark):
    """A join on the key that turns out small is broadcast, and what it has not shuffled must not count as shuffled."""
    small = spark.range(3_000_000).groupBy((F.col("id") % 7).alias("k")).agg(F.lit(1).alias("one"))
    df = spark.range(0, 20_000, 1, 8).select((F.col("id") % 5).alias("k"), F.col("id").alias("o")).join(small, "k", "left")

    def step(state, rows):
        runs = range(state[0], state[0] + len(rows))
        state[0] += len(rows)
        return rows[["k", "o"]].assign(run=runs)

    out = ordered_fold(df, ["k"], ["o"], lambda _: [0], step, "k long, o long, run long")
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.o, r.run) for r in out.collect()) == [(k, 5 * n + k, n) for k in range(5) for n in range(4000)]


def test_ranges_without_limits_are_broadcast_by_a_count_of_their_own(spark):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    points = [(i, "ab"[i % 2], at(i % 50)) for i in range(200)]
    timed = [(100 + i, (None, "a", "b")[i % 3], at(i), at(i + 5)) for i in range(40)]
    always = [(1, "a", None, None), (2, None, None, None), (3, "b", None, None)]
    p = spark.createDataFrame(points, "id int, k string, t timestamp")
    r = spark.createDataFrame([*timed, *always], "rid int, rk string, lo timestamp, hi timestamp")
    want = sorted((i, rid) for i, k, t in points for rid, rk, lo, hi in [*timed, *always] if rk in (None, k) and (lo is None or lo <= t <= hi))
    for limit, broadcasts in ((100_000, 1), (10, 1), (0, 0)):
        got = interval_join(p, r, point_id="id", point_key="k", point_ts="t", range_key="rk", lo="lo", hi="hi", broadcast_rows=limit)
        assert sorted((x.id, x.rid) for x in got.collect()) == want
        assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == broadcasts
