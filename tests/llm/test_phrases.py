"""Phrase fingerprints against a plain parse and a plain walk."""

import hashlib
import random

import numpy as np
import pytest

from quantspan.llm import phrases
from quantspan.llm.queries import QUERIES


def _hash(phrase):
    x = sum((ord(y) + 1) * phrases._BASE**k for k, y in enumerate(phrase)) % 2**64
    return int(phrases.mix(np.array([x], np.uint64))[0]) >> 32


def _plain(text):
    known, now = set(), ""
    for x in text or "":
        now += x
        if now not in known:
            known.add(now)
            now = ""
    return sorted({_hash(p) for p in known})[: phrases.SIZE]


def _like(a, b):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})[: phrases.SIZE]
    return sum(x in a and x in b for x in both) / len(both)


def _hex(hashes):
    return b"".join(h.to_bytes(4, "big") for h in hashes)


def _brute(rows):
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    out = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other = _plain(text), _plain(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).digest(), _hex(own), _hex(other), _like(own, other), _like(own, _plain(after))))
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abé漢 ", "abcdefghijklmnopqrstuvwxyz ."])
def test_parse(letters, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 100)
    r = random.Random(letters)
    for n in (0, 1, 2, 3, 10, 100, 3000):
        text, tail = ("".join(r.choices(letters, k=n)) for _ in range(2))
        own = phrases.Parsed(text)
        assert own.fingerprint.tolist() == _plain(text)
        keep = n - n // 3
        edited, sketch = own.edited(keep, tail[: n // 3])
        assert edited == text[:keep] + tail[: n // 3] and sketch.tolist() == _plain(edited)


def test_walk(docs, odd):
    r = random.Random(3)
    rows = [(r.randrange(10**6) * 10 + 9, "".join(r.choices("abc é", k=r.randint(0, 400)))) for _ in range(120)]
    rows += [x for x in odd if x != odd[-1]]  # ids are distinct, so that there is one order
    got = [tuple(x) for x in phrases.compare_in_order(docs(rows).repartition(7)).collect()]
    assert sorted(got, key=str) == sorted(_brute(rows), key=str)


def test_repeated_rows_and_small_tables(docs):
    assert phrases.compare_in_order(docs([(1, "x")]).where("doc_id = 2")).count() == 0
    one = phrases.compare_in_order(docs([(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").digest() and one["near_next"] == 1.0
    rows = [(5, "the same text")] * 4 + [(5, "another text here")] * 3 + [(None, None), (None, "")]
    got = phrases.compare_in_order(docs(rows).repartition(3)).collect()
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(i) for i, _ in rows)
    assert len({bytes(x["fingerprint"]) for x in got}) == 3
    again = phrases.compare_in_order(docs(rows).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_add_fingerprints(docs, odd):
    got = phrases.add_fingerprints(docs(odd)).collect()
    assert all(list(x["fingerprint"]) == list(_hex(_plain(x["text"]))) for x in got) and len(got) == len(odd)
    with pytest.raises(ValueError, match="already"):
        phrases.add_fingerprints(docs(odd), out="label")


def test_query(spark, data):
    got = QUERIES["op12_phrase_fingerprint"](spark, data).toPandas()
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {r[0]: r[1:] for r in _brute(rows)}
    for x in got.itertuples():
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, x.near_edited, x.near_next) == (
            *(y.hex() if isinstance(y, bytes) else y for y in want[x.doc_id]),
        )
    assert len(got) == len(rows) and (got["near_edited"] > got["near_next"]).mean() > 0.97
