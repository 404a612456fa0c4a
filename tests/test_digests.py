"""Digests of ranges of a log: merging, trees, and the ranges that differ."""

import random

from pyspark.sql import functions as F

from quantspan.operators import digests
from quantspan.queries import _edited_line

SCHEMA = "chain_id string, seq long, computed_hash string"
PARTS = ("computed_hash",)


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _tree(spark, rows, leaf=4, fanout=3):
    return digests.digest_tree(digests.leaf_digests(_log(spark, rows), "seq", PARTS, leaf), fanout)


def _found(spark, left, right, leaf=4, fanout=3):
    df = digests.differing_ranges(_tree(spark, left, leaf, fanout), _tree(spark, right, leaf, fanout), leaf, fanout)
    return sorted(map(tuple, df.collect()))


def test_differences_are_those_of_a_plain_comparison(spark):
    rng = random.Random(5)
    left = [(c, k, f"h{c}{k}") for c, n in (("a", 150), ("b", 7), ("only-left", 9)) for k in range(1, n + 1)]
    right = [r if rng.random() > 0.03 else (r[0], r[1], "edited") for r in left if r[0] != "only-left" and r[1] != 50]
    right += [("a", k, "longer") for k in range(151, 420)] + [("only-right", 3, "x")]
    want = set()
    for chain, node in {(r[0], r[1] // 4) for r in left + right}:
        of = [sorted(r for r in rows if (r[0], r[1] // 4) == (chain, node)) for rows in (left, right)]
        if of[0] != of[1]:
            want.add((chain, node * 4, node * 4 + 3, len(of[0]), len(of[1])))
    assert _found(spark, left, right) == sorted(want)
    assert _found(spark, right, left) == sorted((c, a, b, m, n) for c, a, b, n, m in want)


def test_same_logs_and_empty_logs(spark):
    rows = [("a", k, "h") for k in range(40)]
    shuffled = rows[::-1]
    assert _found(spark, rows, shuffled) == [] and _found(spark, [], []) == []
    assert _found(spark, rows[:6], []) == [("a", 0, 3, 4, 0), ("a", 4, 7, 2, 0)]


def test_nulls_and_repeated_positions(spark):
    assert _found(spark, [("a", None, "x")], [("a", None, "x")]) == []
    assert _found(spark, [("a", None, "x"), ("a", 9, "k")], [("a", 9, "k")]) == [("a", -4, -1, 1, 0)]
    assert _found(spark, [("a", 1, None)], [("a", 1, "")]) == [("a", 0, 3, 1, 1)]
    twice = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y")]
    assert _found(spark, twice, twice[::-1]) == [] and _found(spark, twice, [twice[0], twice[2], twice[2]]) == [("a", 0, 3, 3, 3)]


def test_leaves_of_increments_add_up(spark, tmp_path):
    rows = [("a", k, f"h{k}") for k in range(1, 60)]
    leaves = [digests.leaf_digests(_log(spark, x), "seq", PARTS, 4) for x in (rows[:22], rows[22:])]
    digests.write_tree(digests.digest_tree(digests.merge_leaves(*leaves), 3), str(tmp_path / "tree"))
    stored = spark.read.parquet(str(tmp_path / "tree"))
    whole = _tree(spark, rows)
    names = whole.columns
    assert sorted(map(tuple, stored.select(names).collect())) == sorted(map(tuple, whole.collect()))
    assert whole.where("level = 3").count() == 1 and digests.differing_ranges(stored, whole, 4, 3).count() == 0


def test_an_edited_line_differs_whatever_it_held(spark):
    """Links and hashes that begin like what an edit puts in are edited too."""
    docs = [(n, f'{{"payload":{{"doc_id":{n},"sha":"{x}00"}},"prev_hash":"{x}00","seq":{n}}}') for n in (9, 5, 11, 6) for x in ("ffff", "0000", "9999")]
    got = spark.createDataFrame(docs, "n long, line string").select("n", (_edited_line() != F.col("line")).alias("other")).collect()
    assert all(r.other == (r.n != 6) for r in got) and len(got) == 12
