"""Quality of price bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.sources.bars import PRICE_COLUMNS, BarError


def _checks() -> dict[str, Column]:
    c = F.col
    return {
        "bad_timestamp": c("ts").isNull(),
        "not_numeric": F.greatest(*[(c(x).isNull() | F.isnan(c(x))).cast("int") for x in PRICE_COLUMNS]) == 1,
        "high_below_low": c("high") < c("low"),
        "high_below_open_close": (c("high") < c("open")) | (c("high") < c("close")),
        "low_above_open_close": (c("low") > c("open")) | (c("low") > c("close")),
        "negative_volume": c("volume") < 0,
    }


def bar_violations(bars: DataFrame) -> DataFrame:
    """Bars with the array of checks each one breaks."""
    broken = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in _checks().items()]))
    return bars.withColumn("violations", broken)


def bar_quality(bars: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """One row per group: number of bars and of violations of each check, in one scan."""
    return bars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bars"),
        *[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in _checks().items()],
    )


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good bars, quarantined bars with their violations)."""
    checked = bar_violations(bars)
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)


def require_valid(bars: DataFrame) -> DataFrame:
    """The bars, or an error naming every broken check. Runs one aggregation."""
    row = bar_quality(bars, by=()).first()
    if row["n_bars"] == 0:
        raise BarError("no bars")
    broken = {n: row[n] for n in _checks() if row[n]}
    if broken:
        raise BarError(f"incoherent bars: {broken}")
    return bars
