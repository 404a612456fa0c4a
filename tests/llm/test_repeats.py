"""Line dedup and substring dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quantspan.llm import line_dedup, substring_dedup


def _brute_lines(rows, k, min_words=None):
    first, long = {}, {}
    texts = {i: t.split("\n") for i, t in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - k + 1):
            first.setdefault(tuple(texts[i][p : p + k]), (i, p))
        for p, x in enumerate(texts[i]):
            if min_words and len(x.split()) >= min_words:
                long.setdefault(x, (i, p))
    out = {}
    for i, own in texts.items():
        gone = {p + j for p in range(len(own) - k + 1) if first[tuple(own[p : p + k])] < (i, p) for j in range(k)}
        gone |= {p for p, x in enumerate(own) if long.get(x, (i, p)) < (i, p)}
        out[i] = "\n".join(x for p, x in enumerate(own) if p not in gone), len(own), len(gone)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_lines(docs, k):
    r = random.Random(k)
    pool = [[r.choice("abcdef") for _ in range(r.randint(1, 9))] for _ in range(12)]
    rows = [(i * 3, "\n".join(x for _ in range(r.randint(1, 4)) for x in r.choice(pool))) for i in range(80)]
    got = {x["doc_id"]: (x["kept"], x["n_lines"], x["n_removed"]) for x in line_dedup.remove_repeated_lines(docs(rows), k).collect()}
    assert got == _brute_lines(rows, k)


def test_line_edges(docs, odd):
    rows = [*odd, (9, "a\nb\nc"), (10, "x\na\nb\nc\ny"), (11, "a\nb"), (12, "z\n" * 50)]
    out = line_dedup.remove_repeated_lines(docs(rows))
    assert out.columns[:6] == docs([]).columns and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["kept"] is None and got[1]["n_lines"] == 0
    assert got[2]["kept"] == "" and got[2]["n_lines"] == 1
    assert got[10]["kept"] == "x\ny" and got[10]["n_removed"] == 3
    assert got[11]["kept"] == "" and got[12]["kept"] == "z\n"
    assert got[None]["n_removed"] == 0 and got[7]["kept"] == "x" * 100_000
    left = line_dedup.drop_repeated_lines(docs(rows))
    assert left.columns == docs([]).columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {11}
    assert line_dedup.drop_repeated_lines(docs([])).count() == 0


def test_long_lines(docs):
    """A passage of one line is a repeat wherever it stands, a line of fewer words only within a run."""
    passage, short, han = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49)), "漢字" * 25
    rows = [(1, f"a\n{passage}\nb"), (2, passage), (3, f"c\n{passage}\nd\n{passage}"), (4, short), (5, short), (6, han), (7, f"e\n{han}")]
    out = line_dedup.remove_repeated_lines(docs(rows), min_words=line_dedup.MIN_WORDS)
    got = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in out.collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 1), 3: ("c\nd", 2), 4: (short, 0), 5: (short, 0), 6: (han, 0), 7: ("e", 1)}
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("k", [2, 3])
def test_long_lines_and_runs(docs, k):
    r = random.Random(k)
    pool = [" ".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(40)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 4)))) for i in range(80)]
    first, want = {}, {}
    for i, t in rows:
        for p, x in enumerate(t.split("\n")):
            first.setdefault(x, (i, p))
    runs = _brute_lines(rows, k)
    got = {x["doc_id"]: x["n_removed"] for x in line_dedup.remove_repeated_lines(docs(rows), k, 4).collect()}
    for i, t in rows:
        own, places = t.split("\n"), {}
        for j, u in rows[: i + 1]:
            for p in range(len(u.split("\n")) - k + 1):
                places.setdefault(tuple(u.split("\n")[p : p + k]), (j, p))
        gone = {p + q for p in range(len(own) - k + 1) if places[tuple(own[p : p + k])] < (i, p) for q in range(k)}
        assert len(gone) == runs[i][2]
        want[i] = len(gone | {p for p, x in enumerate(own) if len(x.split()) >= 4 and first[x] < (i, p)})
    assert got == want and sum(want.values()) > sum(x[2] for x in runs.values())


def test_lines_are_native(docs, odd):
    plan = line_dedup.remove_repeated_lines(docs(odd))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def _brute_words(rows, k):
    first, texts = {}, {i: (t or "").split(" ") for i, t in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - k + 1):
            first.setdefault(tuple(texts[i][p : p + k]), i)
    out = {}
    for i, own in texts.items():
        gone = {p + j for p in range(len(own) - k + 1) if first[tuple(own[p : p + k])] < i for j in range(k)}
        out[i] = " ".join(x for p, x in enumerate(own) if p not in gone), len(own), len(gone)
    return out


@pytest.mark.parametrize("k", [2, 4, 13])
def test_substrings(docs, k):
    r = random.Random(k)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(k, 3 * k))) for _ in range(8)]
    rows = [(i - 40, " ".join(r.choice([*pool, r.choice("abcdefgh")]) for _ in range(r.randint(1, 6)))) for i in range(120)]
    got = substring_dedup.remove_repeats(docs(rows).repartition(5), k).withColumn("gone", substring_dedup.n_removed())
    assert {x["doc_id"]: (x["text"], x["n_words"], x["gone"]) for x in got.collect()} == _brute_words(rows, k)


def test_substring_edges(docs, odd):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [*odd, (20, text), (21, f"before {text} after"), (22, text), (22, text), (None, text), (23, " ".join(text.split()[:12]))]
    out = substring_dedup.remove_repeats(docs(rows)).withColumn("gone", substring_dedup.n_removed())
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["gone"] for r in got[20]] == [0] and [r["gone"] for r in got[21]] == [19] and [r["gone"] for r in got[22]] == [20, 20]
    assert got[21][0]["text"] == "before w19 after" and [(s["start"], s["end"]) for s in got[21][0]["removed"]] == [(1, 20)]
    assert {r["gone"] for r in got[None]} == {0} and got[23][0]["gone"] == 0 and got[6][0]["gone"] == 0
    assert [got[i][0]["n_words"] for i in (1, 2, 3, 4, 6, 7)] == [0, 0, 0, 1, 30_000, 1]
    assert len(out.collect()) == len(rows) and substring_dedup.remove_repeats(docs([])).count() == 0


def test_document_part_is_what_spark_says(spark):
    import numpy as np

    ids = np.array([-5, 0, 3, 2**62], np.int64)
    rows = spark.createDataFrame([(int(i),) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(7))).collect()
    assert substring_dedup._document_part(ids, 7).tolist() == [r[0] for r in rows]


def test_long_lines_are_told_without_listing_their_words(spark):
    rng = random.Random(3)
    letters = "ab é漢ひカไກខမ\t\x0b\x00\x7f 　Жع😀𠀀 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(2000)] + ["ع" * 50_000, "漢" * 50_000]
    docs = spark.createDataFrame([(2 * i + k, x) for i, x in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    found = line_dedup.repeated_long_lines(docs, 12)
    seen, want = set(), set()
    for i, x in docs.orderBy("doc_id").collect():
        want |= {(i, 0)} if x in seen else set()
        seen |= {x}
    long = docs.where(F.regexp_count("text", F.lit(line_dedup.WORD)) >= 12)
    assert {tuple(r) for r in found.collect()} == want & {(r.doc_id, 0) for r in long.collect()}


def test_long_lines_are_searched_up_to_the_number_of_words(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    line_dedup.repeated_long_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 12)
    assert not any("regexp_extract_all" in x for x in plans)
