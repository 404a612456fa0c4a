"""Notes and retrieval."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantspan.functions.text import doc_tokens, query_tokens
from quantspan.operators import retrieval
from quantspan.operators.retrieval import bm25, build_index, link_counts, link_keys, retrieve
from quantspan.sources.index import add_segment, open_index
from quantspan.sources.notes import content_hash, frontmatter_problems, parse_notes, read_notes

SCHEMA = (
    "path string, id_key string, title string, tags array<string>, instrument string, regime string, "
    "links array<string>, body string"
)


def notes(spark, *rows):
    base = {"id_key": None, "title": "t", "tags": [], "instrument": None, "regime": None, "links": [], "body": ""}
    return spark.createDataFrame([{**base, **r} for r in rows], SCHEMA)


def ask(spark, index, text, limit=10, **k):
    q = spark.createDataFrame([(1, text, k.get("instrument"), k.get("regime"))], "query_id int, text string, instrument string, regime string")
    return [(r.path, r.score, r.reasons) for r in retrieve(index, q, limit).orderBy("rank").collect()]


def test_matching_note_first_others_absent(spark):
    ix = build_index(notes(spark, {"path": "gold.md", "body": "gold volatility regimes"}, {"path": "cook.md", "body": "bread and butter"}))
    assert [p for p, _, _ in ask(spark, ix, "Gold volatility")] == ["gold.md"]
    assert ask(spark, ix, "¿¡ !?") == [] and ask(spark, ix, "absent") == []


def test_instrument_regime_and_tag_break_ties(spark):
    same = {"body": "trend following"}
    ix = build_index(
        notes(spark, {"path": "a.md", "instrument": "ES", **same}, {"path": "b.md", "instrument": "NQ", "regime": "shift", **same},
              {"path": "z.md", "body": "other"}, {"path": "y.md", "body": "words"}, {"path": "x.md", "body": "here"})
    )
    hits = ask(spark, ix, "trend", instrument="NQ", regime="shift")
    assert [h[0] for h in hits] == ["b.md", "a.md"] and hits[0][2] == ["bm25", "instrument", "regime"]
    assert abs(hits[1][1] - hits[0][1] - 0.9) < 1e-9
    tagged = build_index(notes(spark, {"path": "a.md", "body": "momentum"}, {"path": "b.md", "body": "momentum", "tags": ["Risk"]}))
    assert ask(spark, tagged, "momentum risk")[0][0] == "b.md"


def test_links_between_hits(spark):
    ix = build_index(
        notes(spark, {"path": "10/DEC-100.md", "id_key": "DEC-100", "body": "alpha", "links": ["DEC-100", "none"]},
              {"path": "b.md", "body": "alpha", "links": ["DEC-100"]}, {"path": "c.md", "body": "alpha", "links": ["DEC-100", "b"]},
              {"path": "d.md", "body": "unrelated", "links": ["b"]})
    )
    hits = {p: (s, r) for p, s, r in ask(spark, ix, "alpha")}
    assert hits["10/DEC-100.md"][1] == ["bm25", "graph"] and hits["c.md"][1] == ["bm25"]
    assert abs((hits["c.md"][0] - hits["10/DEC-100.md"][0]) - 0.4) < 1e-6
    assert abs((hits["c.md"][0] - hits["b.md"][0]) - 0.2) < 1e-6


def _many(spark, n=150, seed=1):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [
        {
            "path": f"p{i}.md", "id_key": f"K{i}", "instrument": r.choice(["NQ", "ES", None]), "regime": r.choice(["a", "b"]), "tags": [r.choice(words)],
            "links": [f"K{int(r.paretovariate(0.5)) % n}" for _ in range(r.randint(0, 4))], "body": " ".join(r.choices(words, k=r.randint(3, 60))),
        }
        for i in range(n)
    ]
    asked = [(q, " ".join(r.choices(words, k=k)), "NQ", "a") for q, k in enumerate((1, 2, 3, 8, 30, 1, 2))]
    return notes(spark, *rows), spark.createDataFrame(asked, "query_id int, text string, instrument string, regime string")


def _all_scored(ix, queries, limit):
    """The best by the scores of all notes."""
    scores = {(r.query_id, r.path): r.score for r in bm25(ix, queries).collect()}
    about = {r.path: r for r in ix.notes.collect()}
    edges = [(r.source, r.target, r.n) for r in ix.edges.collect()]
    out = []
    for q in queries.collect():
        own = {p: s for (i, p), s in scores.items() if i == q.query_id}
        for path in list(own):
            n = about[path]
            own[path] -= 0.5 * (n.instrument == q.instrument) + 0.4 * (n.regime == q.regime) + 0.3 * any(t.lower() in q.text.lower() for t in n.tags)
            own[path] -= 0.2 * sum(k for s, t, k in edges if t == path and (q.query_id, s) in scores)
        best = sorted((round(s, 9), p) for p, s in own.items())[:limit]
        out += [(q.query_id, k + 1, p, round(s, 6)) for k, (s, p) in enumerate(best)]
    return out


@pytest.mark.parametrize(("block", "first", "limit"), [(4, 1, 3), (2, 6, 2), (32, 4, 10), (1, 1, 200)])
def test_blocks_that_are_not_read_hold_nothing(spark, monkeypatch, block, first, limit):
    monkeypatch.setattr(retrieval, "BLOCK_NOTES", block)
    monkeypatch.setattr(retrieval, "FIRST_BLOCKS", first)
    rows, queries = _many(spark, seed=block)
    ix = build_index(rows)
    got = sorted((r.query_id, r["rank"], r.path, r.score) for r in retrieve(ix, queries, limit).collect())
    assert got == _all_scored(ix, queries, limit)
    if limit < 5:  # a floor leaves most pairs out
        terms = retrieval._weighted_terms(ix, queries)
        assert retrieval.candidates(ix, queries, terms, limit).count() < bm25(ix, queries).count() / 2


def test_stored_index(spark, tmp_path):
    """Segments reopened give what one build gives; later notes replace earlier ones; unfinished segments and missing indexes hold nothing."""
    root = str(tmp_path / "ix")
    rows, queries = _many(spark)
    assert retrieve(open_index(spark, root), queries).count() == 0
    old = rows.where("path < 'p5'").withColumn("body", F.concat("body", F.lit(" older words")))
    add_segment(rows.where("path < 'p2'"), root)
    add_segment(old.where("path >= 'p2'"), root)
    add_segment(rows.where("path >= 'p2'"), root)
    (tmp_path / "ix" / "notes" / "segment=00000009-x").mkdir()
    rows.write.mode("append").parquet(f"{root}/notes/segment=00000009-x")
    want, got = build_index(rows), open_index(spark, root)
    assert (got.n_docs, got.avg_len) == (want.n_docs, want.avg_len)
    each = lambda df: sorted(tuple(r) for r in df.select("term", "path", "tf", "len").collect())
    assert each(got.postings) == each(want.postings)
    ranked = lambda ix: sorted((r.query_id, r["rank"], r.path, r.score, r.reasons) for r in retrieve(ix, queries, 5).collect())
    assert ranked(got) == ranked(want)


def test_last_path_wins_a_link_key(spark):
    df = notes(spark, {"path": "a/x.md", "id_key": "K"}, {"path": "b/x.md", "id_key": "K"})
    assert {(r.key, r.target) for r in link_keys(df).collect()} == {("K", "b/x.md"), ("x", "b/x.md")}
    own = df.withColumn("own_keys", F.lit(None).cast("array<string>")).withColumn("query_id", F.lit(1)).withColumn("links", F.array(F.lit("K")))
    assert link_counts(own, link_keys(df)).first().n_links == 2


def test_bm25_formula(spark):
    bodies = ["a a b", "a c", "b b b b", "d"]
    ix = build_index(notes(spark, *[{"path": f"{i}.md", "title": "", "body": b} for i, b in enumerate(bodies)]))
    q = spark.createDataFrame([(1, "a a d")], "query_id int, text string")
    got = {r.path: r.score for r in bm25(ix, q).collect()}
    docs = [b.split() for b in bodies]
    avg = sum(map(len, docs)) / 4
    for i, d in enumerate(docs):
        want = 0.0
        for t, qtf in (("a", 2), ("d", 1)):
            n = sum(t in x for x in docs)
            idf = max(math.log((4 - n + 0.5) / (n + 0.5)), 1e-6)
            tf = d.count(t)
            want -= qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        assert abs(got.get(f"{i}.md", 0.0) - want) < 1e-9


def test_tokens(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(doc_tokens(F.lit("Año ÉLITE x2, naïve é"))) == ["ano", "elite", "x2", "naive", "e"]
    assert one(query_tokens(F.lit("Año élite X2"))) == ["a", "o", "lite", "x2"]


def test_read_and_parse_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one two.md").write_text(
        "---\nid: DEC-001\ntitle: 'A title: yes'\n# note: x\ntags: [gold, 'risk', ]\nempty:\n---\n\nBody [[B|shown]] [[A]] [[A]]\n"
    )
    (tmp_path / "plain.md").write_text("no frontmatter [[DEC-001]]")
    (tmp_path / "skip.txt").write_text("x")
    got = {r.path: r for r in read_notes(spark, str(tmp_path)).collect()}
    a, b = got["sub/one two.md"], got["plain.md"]
    assert (a.id_key, a.title, a.folder, a.tags, a.links) == ("DEC-001", "A title: yes", "sub", ["gold", "risk"], ["A", "B"])
    assert a.body.strip().startswith("Body") and b.body.startswith("no frontmatter")
    assert (b.id_key, b.title, b.folder, b.tags, b.links) == ("plain", "plain", "", [], ["DEC-001"])


def test_scalar_tag_and_duplicate_key(spark):
    df = spark.createDataFrame([("a.md", "---\ntags: gold\nid: one\nid: two\n---\nx")], "path string, text string")
    row = parse_notes(df).first()
    assert row.tags == ["gold"] and row.id_key == "two"


GOOD = "---\nid: DEC-001\ntitle: t\ntype: d\nstatus: accepted\nowner: o\ncreated: 2024\n---\nbody"


@pytest.mark.parametrize(
    "name,text,problem",
    [
        ("DEC-001-x.md", GOOD, None),
        ("DEC-001-x.md", "no", "no frontmatter"),
        ("DEC-001-x.md", GOOD.replace("owner: o\n", ""), "missing keys: owner"),
        ("DEC-1.md", GOOD.replace("DEC-001", "DEC-1"), "invalid id: DEC-1"),
        ("DEC-001-x.md", GOOD.replace("accepted", "done"), "invalid status: done"),
        ("DEC-002-x.md", GOOD, "id is not the file name prefix"),
    ],
)
def test_frontmatter_problems(spark, name, text, problem):
    row = frontmatter_problems(spark.createDataFrame([("d/" + name, text)], "path string, text string")).first()
    assert row.problems == ([problem] if problem else [])


def test_content_hash_ignores_frontmatter(spark):
    df = spark.createDataFrame([(GOOD,), ("---\nid: x\n---\n\n\nbody",)], "t string")
    assert df.select(content_hash(F.col("t")).alias("h")).distinct().count() == 1
