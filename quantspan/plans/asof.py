"""As-of join: the latest right row at or before each left row, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspan.plans.blocks import DAY, match_keys, time_bucket


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    seconds: int = DAY,
    right_tie: Sequence[str] = (),
) -> DataFrame:
    """Left rows with the columns of the latest right row where ``right_ts <= left_ts``.

    Both sides are interleaved inside (key, time bucket), so a hot key is spread over its
    buckets. The state valid at the start of a bucket comes from the per-bucket last values.
    Among right rows of one instant the highest ``right_tie`` wins.
    """
    cols = [c for c in right.columns if c not in keys]
    state = F.struct(*[F.col(c) for c in cols])
    probes = left.select(
        *keys,
        F.col(left_ts).alias("__ts"),
        F.lit(1).alias("__side"),
        F.lit(None).cast(right.select(state.alias("s")).schema["s"].dataType).alias("__state"),
        F.struct(*[F.col(c) for c in left.columns if c not in keys]).alias("__row"),
    )
    row_type = probes.schema["__row"].dataType
    tie = [F.col(c).alias(f"__t{i}") for i, c in enumerate(right_tie)]
    tie_names = [f"__t{i}" for i in range(len(right_tie))]
    states = right.select(
        *keys,
        F.col(right_ts).alias("__ts"),
        F.lit(0).alias("__side"),
        state.alias("__state"),
        F.lit(None).cast(row_type).alias("__row"),
        *tie,
    )
    both = probes.unionByName(states, allowMissingColumns=True).withColumn("__b", time_bucket("__ts", seconds))
    order = ["__ts", "__side", *tie_names]
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    last_of_bucket = (
        both.groupBy(*keys, "__b")
        .agg(F.max_by("__state", F.when(F.col("__side") == 0, F.struct(*order))).alias("__m"))
        .select(*keys, "__b", F.last("__m", ignorenulls=True).over(before).alias("__carried"))
    )
    joined = match_keys(
        both.withColumn("__now", F.last("__state", ignorenulls=True).over(inside)).where("__side = 1"),
        last_of_bucket,
        [*keys, "__b"],
    )
    hit = F.coalesce("__now", "__carried")
    return joined.select(
        *keys,
        *[F.col("__row").getField(c).alias(c) for c in left.columns if c not in keys],
        *[hit.getField(c).alias(c) for c in cols],
    )
