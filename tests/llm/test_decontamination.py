import random

import pytest

from quantspan.llm import decontamination as d


def _brute(rows, items, k):
    norm = lambda t: [w.decode() for w in d.words_of(t.encode() if t else None)]
    sought = {}
    for name, text in items:
        w = norm(text)
        for p in range(len(w) - k + 1):
            sought.setdefault(tuple(w[p : p + k]), set()).add(str(name))
        if 0 < len(w) < k:
            sought.setdefault(tuple(w), set()).add(str(name))
    out = {}
    for i, text in rows:
        w, hit, names = norm(text), set(), set()
        for p in range(len(w)):
            for n in range(1, k + 1):
                found = sought.get(tuple(w[p : p + n])) if p + n <= len(w) else None
                if found:
                    hit |= set(range(p, p + n))
                    names |= found
        out[i] = len(w), hit, sorted(names)
    return out


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize(("k", "block"), [(3, 1 << 20), (5, 1 << 20), (4, 60)])
def test_hits(spark, docs, monkeypatch, k, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    r = random.Random(k)
    say = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    items = [(i, say(r.randint(0, 12)) if i % 5 else None) for i in range(25)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    rows = [(i, say(r.randint(0, 40)).upper() if i % 2 else say(r.randint(0, 40)).replace(" ", ",\n")) for i in range(80)]
    got = d.find_hits(docs(rows), _items(spark, items), k).collect()
    found = {x["doc_id"]: (x["n_words"], {p for s in x["hit_spans"] for p in range(s["start"], s["end"])}, x["hit_items"]) for x in got}
    assert found == _brute(rows, items, k)


def test_edges_and_cuts(spark, docs, odd):
    item = "The quick brown fox jumps over the lazy dog and then sleeps."
    rows = [*odd, (20, f"Well: {item} And more, été — so it was, with many words behind what was cut, so that more of them stay than go: eight or nine."), (21, item), (22, "a clean one")]
    items = _items(spark, [(1, item), (2, item), (3, None), (4, ""), (None, "so it was")])
    got = {r["doc_id"]: r for r in d.find_hits(docs(rows), items).collect()}
    assert got[20]["hit_items"] == ["", "1", "2"] and [(s["start"], s["end"]) for s in got[20]["hit_spans"]] == [(1, 13), (17, 20)]  # a dash is a word
    assert not got[22]["hit_spans"] and got[1]["n_words"] == 0
    out = d.decontaminate(docs(rows), items)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs([]).columns and 21 not in left and left[22] == "a clean one" and left[1] is None
    assert left[20] == "Well: . And more, été — , with many words behind what was cut, so that more of them stay than go: eight or nine."
    assert d.decontaminate(docs(rows), _items(spark, [])).count() == len(rows) and d.find_hits(docs([]), items).count() == 0
    with pytest.raises(ValueError):
        d.find_hits(docs(rows).withColumnRenamed("n", "n_words"), items)
