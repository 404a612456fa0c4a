"""Digests of ranges of a log, and the ranges in which two logs differ.

Positions are cut into ranges of ``leaf``; ``fanout`` neighbouring ranges make one of the next level, up to
a level with one range a chain. A range's digest is its number of events and the sums of their hashes in
``LANES`` lanes of 60 bits. Sums do not depend on order and are combined before the shuffle, so a position
that many rows claim is no group in memory, and digests of parts add up: levels follow from the leaves, and
a growing log adds the leaves of its new events (``merge_leaves``).

Two trees are compared from the top. Only children of ranges that differ are looked at further down, so what
two sites exchange follows the number of differences, not the length of the log.

Edge cases: events of one position all count in its range, events without a position share the range -1,
nulls are told from empty strings, and an empty log has no ranges, so all of the other log's differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.session import materialize

LEAF = 1024
FANOUT = 16
LANES, DIGITS = 4, 15
#: What an event's hash is taken over, beside its position.
PARTS = ("seq", "computed_hash", "payload_hash", "prev_hash", "chain_hash")

_SUMS = ["n_events", *[f"lane{k}" for k in range(LANES)]]


def _totals(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(x).cast("long" if x == "n_events" else "decimal(38,0)").alias(x) for x in _SUMS])


def leaf_digests(events: DataFrame, position: str, parts: Sequence[str] = PARTS, leaf: int = LEAF) -> DataFrame:
    """``chain_id, node``, the number of events and the lanes, for each range of ``leaf`` positions."""
    said = [F.col(x).cast("string") for x in dict.fromkeys([position, *parts])]
    whole = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("n")) for x in said]), 256)
    lanes = [F.conv(F.substring("__h", 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(38,0)").alias(f"lane{k}") for k in range(LANES)]
    node = F.coalesce(F.floor(F.col(position) / leaf), F.lit(-1)).cast("long").alias("node")
    rows = events.select("chain_id", node, whole.alias("__h")).select("chain_id", "node", F.lit(1).alias("n_events"), *lanes)
    return _totals(rows, "chain_id", "node")


def merge_leaves(*leaves: DataFrame) -> DataFrame:
    """Leaves of all the events, from those of disjoint sets of them."""
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return _totals(out, "chain_id", "node")


def digest_tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The digests of all levels; level 0 has the leaves. One aggregation, over one row a leaf and level."""
    leaves = materialize(leaves, "leaves")
    top, height = leaves.agg(F.max("node")).first()[0] or 0, 0
    while top > 0:
        top, height = top // fanout, height + 1
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(height))))
    node = F.floor(F.col("node") / F.pow(F.lit(fanout), "level").cast("long")).cast("long").alias("node")
    return _totals(levels.select("chain_id", "level", node, *_SUMS), "chain_id", "level", "node")


def write_tree(tree: DataFrame, path: str) -> None:
    """Store a tree by level, so that a comparison reads the levels it has come to."""
    tree.write.partitionBy("level").mode("errorifexists").parquet(path)


def differing_ranges(left: DataFrame, right: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """``chain_id, first, last, n_left, n_right`` of the leaves that are not the same in both trees.

    Both must have been built with ``leaf`` and ``fanout``. The comparison starts at the highest level that both have,
    where every chain is present, and takes one join a level.
    """
    heights = [x for x in (side.agg(F.max("level")).first()[0] for side in (left, right)) if x is not None]
    wanted = found = None
    for level in range(min(heights, default=0), -1, -1):
        sides = [side.where(F.col("level") == level).select("chain_id", "node", F.struct(*_SUMS).alias("d")) for side in (left, right)]
        if wanted is not None:
            sides = [side.join(wanted, ["chain_id", "node"], "left_semi") for side in sides]
        a, b = (side.withColumnRenamed("d", name) for side, name in zip(sides, "ab", strict=True))
        both = a.join(b, ["chain_id", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        found = both.select("chain_id", "node", F.col("a.n_events").alias("n_left"), F.col("b.n_events").alias("n_right"))
        if level:
            found = materialize(found, "differing")
            first = F.col("node") * fanout
            wanted = found.select("chain_id", F.explode(F.sequence(first, first + fanout - 1)).alias("node"))
    first = F.col("node") * leaf
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_left", "n_right")]
    return found.select("chain_id", first.alias("first"), (first + leaf - 1).alias("last"), *counts)
