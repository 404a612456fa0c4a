"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quantspan.llm import variants
from quantspan.llm.queries import QUERIES


def _one_edit(word, letters):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + x + b[1:] for a, b in cuts if b for x in letters} | {a + x + b for a, b in cuts for x in letters}
    return out - {word}


def _groups(counts, times=10):
    letters = sorted({x for w in counts for x in w})
    form, near = {}, {}
    for w, n in counts.items():
        around = [v for v in _one_edit(w, letters) if v in counts]
        near[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return out


def _words(rows, one_in=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("piece", [3, variants.PIECE])
def test_neighbourhood_is_whole(monkeypatch, piece):
    """Each string within one edit comes once, by its hash."""
    monkeypatch.setattr(variants, "SYMBOLS", 3)
    r = random.Random(piece)
    for n in (1, 2, 5, 9):
        symbols = np.array([[r.randint(1, 3) for _ in range(n)] for _ in range(4)], np.uint64)
        got = [[int(x)] for x in variants.own_codes(symbols)]
        for first in range(0, n + 1, piece):
            for rows, codes in variants.neighbour_codes(symbols, first, min(first + piece, n + 1)):
                for k, code in zip(rows.tolist(), codes.tolist(), strict=True):
                    got[k].append(code)
        for row, codes in zip(symbols, got, strict=True):
            word = "".join(map(str, row.tolist()))
            strings = [s for s in {word, *_one_edit(word, "123")} if s]
            want = [int(variants.own_codes(np.array([[int(x) for x in s]], np.uint64))[0]) for s in strings]
            empty = [] if n > 1 else [0]  # the empty string
            assert sorted(codes) == sorted(want + empty)


@pytest.mark.parametrize(("symbols", "bits"), [(1, 1 << 27), (2, 1 << 15), (8, 1 << 27)])
def test_groups(spark, monkeypatch, symbols, bits):
    """Also with few symbols and with a bitmap so small that it is full."""
    monkeypatch.setattr(variants, "SYMBOLS", symbols)
    monkeypatch.setattr(variants, "FILTER_BITS", bits)
    r = random.Random(symbols)
    counts = {}
    for _ in range(40):
        word = "".join(r.choices("abcéÿz", k=r.randint(7, 14)))
        n = 10 ** r.randint(1, 6)
        for _ in range(8):
            counts.setdefault(word, n)
            word = r.choice(sorted(_one_edit(word, "abcéÿz")))
            n = max(2, n // r.choice([1, 5, 10, 20]))
    counts["x" * 2000], counts["x" * 2001], counts["x" * 1000 + "y" + "x" * 1000] = 500, 50, 3
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(x) for x in variants.group_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == _groups(counts) and any(root != form for _, form, root, *_ in got if form)


def test_words(docs, odd):
    r = random.Random(5)
    rows = [(k, " ".join("".join(r.choices("abÀÉß×Zz", k=r.randint(5, 9))) for _ in range(60)) + ".Ünder_Lines-Lines'Lines") for k in range(50)]
    rows += [*odd, *rows[:9], (None, rows[0][1])]
    got = {x["word"]: x["n"] for x in variants.count_words(docs(rows), one_in=31).collect()}
    assert got == _words(rows) and got
    plain = {x["word"]: x["n"] for x in variants.count_words(docs(rows)).collect()}
    assert plain == _words(rows, 10**12)


def test_without_words(docs):
    assert variants.group_variants(variants.count_words(docs([(1, None), (2, "short words")]))).count() == 0
    with pytest.raises(ValueError, match="times"):
        variants.group_variants(variants.count_words(docs([(1, None)])), times=1)


def test_query(spark, data):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = [tuple(x) for x in QUERIES["op13_spelling_variants"](spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == _groups(_words(rows))
