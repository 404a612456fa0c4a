"""Ordered work on long series, cut into blocks.

A window over ``partitionBy(key)`` sends a whole key to one task. Keys are skewed here (one
instrument or sleeve may own a third of all rows), so every ordered operator of the package is
written over blocks of a key instead:

* ``with_positions`` numbers rows per key from per-bucket counts;
* ``with_halo`` gives each block the last rows of the block before it, which is all a ``lag``
  or a rolling frame of bounded length needs;
* ``carry_in`` reduces each block to totals and prefixes them, which is all a running
  aggregate (sum, product, maximum, last value) needs;
* ``by_length`` keeps keys of few rows whole, which needs no blocks, and cuts the others only;
* ``ordered_pieces`` cuts an order without any key into pieces of about as many rows.

Only the per-block totals are ever windowed per key: one row per block, not per input row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.session import materialize

DAY = 86_400


def time_bucket(ts: str | Column, seconds: int = DAY) -> Column:
    """Integer index of the ``seconds``-wide bucket a timestamp falls into."""
    micros = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.floor(micros / F.lit(float(seconds * 1_000_000))).cast("long")


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys``, keys kept once.

    Plain equality keeps the hash partitioning the windows already produced, so the larger side
    is not shuffled again. Callers fill NULL keys first where NULL is a key of its own.
    """
    return left.join(right, list(keys), how)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
    seconds: int = DAY,
    pos: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based dense row number per key in (``ts``, ``tie``) order.

    Rows are numbered inside (key, time bucket); the buckets' counts, one row each, are
    prefix-summed per key and joined back.
    """
    bucketed = df.withColumn("__b", time_bucket(ts, seconds))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *keys,
            "__b",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        )
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(ts, *tie)
    numbered = match_keys(
        bucketed.withColumn("__rn", F.row_number().over(inside)), offsets, [*keys, "__b"]
    ).withColumn(pos, F.col("__off") + F.col("__rn") - 1)
    if total:
        numbered = numbered.withColumn(total, F.col("__total"))
    return numbered.drop("__b", "__rn", "__off", "__total")


def with_halo(df: DataFrame, pos: str, back: int, size: int = 8192, block: str = "blk") -> DataFrame:
    """Assign rows to blocks of ``size`` positions and copy the last ``back`` rows forward.

    Copies carry ``halo = true``; drop them after the window has been evaluated. The copies
    are ``back / size`` of the input.
    """
    if back > size:
        size = back
    own = F.floor(F.col(pos) / F.lit(size)).cast("long")
    spill = (F.col(pos) % F.lit(size)) >= F.lit(size - back)
    return (
        df.withColumn("__own", own)
        .withColumn(block, F.explode(F.when(spill, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
        .withColumn("halo", F.col(block) != F.col("__own"))
        .drop("__own")
    )


def carry_in(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    totals: Mapping[str, Column],
    prefix: Mapping[str, Column],
) -> DataFrame:
    """Per (key, block): ``prefix`` expressions evaluated over the totals of earlier blocks.

    ``totals`` are aggregates of one block, ``prefix`` aggregates over those totals; the result
    has one row per block and is NULL in the first block of a key.
    """
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, block)
        .agg(*[c.alias(n) for n, c in totals.items()])
        .select(*keys, block, *[c.over(before).alias(n) for n, c in prefix.items()])
    )


#: Rows of a piece of a global order, and of a key that one task may hold whole.
PIECE_ROWS = 1_000_000


def by_length(df: DataFrame, keys: Sequence[str], run: Callable[[DataFrame, bool], DataFrame], rows: int = PIECE_ROWS) -> DataFrame:
    """``run(part, whole)`` over the rows of keys with at most ``rows`` rows (``whole``) and over those of longer keys.

    There is at most one longer key per ``rows`` rows of ``df``, so these are broadcast. ``df`` is read up to three times.
    """
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    long = materialize(long.select(*[F.col(k).alias(f"__{k}") for k in keys]), "long-keys")
    if long.isEmpty():
        return run(df, True)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    few = F.broadcast(long)
    return run(df.join(few, same, "left_anti"), True).unionByName(run(df.join(few, same, "left_semi"), False))


def ordered_pieces(df: DataFrame, order: Sequence[str], rows: int = PIECE_ROWS, piece: str = "__piece") -> DataFrame:
    """``df`` sorted in pieces of the global ``order``, with the number of the piece that a row falls into.

    Ranges of the order hold about ``rows`` rows each, however these spread over time; rows that are equal in ``order``
    stay together. ``df`` is read three times (count, sample, shuffle), so pass a written table.
    """
    n = max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(piece, F.spark_partition_id())


def previous_in_order(df: DataFrame, order: Sequence[str], value: str, name: str, rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with the string ``value``, never null, of the row before in the global ``order`` as ``name``; pass a written table.

    A piece is read once, in its order, where the range shuffle has put it; the last values, one row a piece, are carried over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = pa.array([None], pa.string()), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            own = batch.column(value).cast(pa.string())
            lag = pa.concat_arrays([before, own[:-1]])
            before = own[-1:]
            none = pa.nulls(batch.num_rows, pa.bool_())
            held = pa.RecordBatch.from_arrays([*batch.columns, lag, none], [*batch.schema.names, name, "__last"])
        if held is not None:  # the batch with the piece's last row, which is marked
            last = pa.array([None] * (held.num_rows - 1) + [True], pa.bool_())
            yield held.set_column(held.num_columns - 1, "__last", last)

    pieces = ordered_pieces(df, order, rows)
    schema = T.StructType([*pieces.schema, T.StructField(name, T.StringType()), T.StructField("__last", T.BooleanType())])
    found = materialize(pieces.mapInArrow(run, schema), "pieces")
    ends = found.where("__last").select("__piece", F.col(value).alias("__value"))
    before = ends.select("__piece", F.lag("__value").over(Window.orderBy("__piece")).alias("__before"))
    firsts = found.join(F.broadcast(before), "__piece", "left")
    return firsts.withColumn(name, F.coalesce(name, "__before")).drop("__piece", "__last", "__before")


def array_split_block(pos: Column, n: Column, parts: int) -> Column:
    """Index of the near-equal contiguous part a position falls into.

    The first ``n % parts`` parts hold one row more than the others, so the part follows from
    the position alone and no ranking over the series is needed.
    """
    q, r = F.floor(n / F.lit(parts)), n % F.lit(parts)
    head = r * (q + 1)
    return (
        F.when(pos < head, F.floor(pos / (q + 1)))
        .otherwise(r + F.floor((pos - head) / F.greatest(q, F.lit(1))))
        .cast("int")
    )


def array_split_start(part: Column, n: Column, parts: int) -> Column:
    """First position of a near-equal contiguous part (inverse of ``array_split_block``)."""
    q, r = F.floor(n / F.lit(parts)), n % F.lit(parts)
    return (part * q + F.least(part.cast("long"), r)).cast("long")
