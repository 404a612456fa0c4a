"""Cross-tokenizer alignment against a plain version of it."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quantspan.llm import alignment
from quantspan.llm.bpe import byte_letters
from quantspan.llm.queries import QUERIES


def _tokens(text):
    """Ids and byte ends of both sides, by the libraries over the whole text."""
    a_lib = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    a_lib.encode_special_tokens = True
    b_lib = SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    letters = byte_letters()
    a = a_lib.encode(" " + text, add_special_tokens=False).ids
    b = b_lib.encode(text)
    a_bytes = [bytes(letters[x] for x in a_lib.id_to_token(i)) for i in a]
    b_bytes = [
        bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b
    ]
    whole = (" " + text).encode()
    return (a, b, a_bytes, b_bytes) if b"".join(a_bytes) == b"".join(b_bytes) == whole else ([], [], [], [])


def _ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def _brute(rows):
    each, counts = [], Counter()
    for doc_id, text in rows:
        a, b, a_bytes, b_bytes = _tokens(text) if text else ([], [], [], [])
        ends_a, ends_b = _ends(a_bytes), _ends(b_bytes)
        links = []
        for i, end_a in enumerate(ends_a):
            for j, end_b in enumerate(ends_b):
                if max(end_a - len(a_bytes[i]), end_b - len(b_bytes[j])) < min(end_a, end_b):
                    links.append((a[i], b[j]))
        counts.update(links)
        groups, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            own = [x for x, e in zip(a, ends_a, strict=True) if last < e <= end], [x for x, e in zip(b, ends_b, strict=True) if last < e <= end]
            groups.append("|".join(",".join(map(str, x)) for x in own))
            last = end
        each.append((doc_id, len(a), len(b), links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = [
        (i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups))
        for i, n_a, n_b, links, groups in each
    ]
    return out, counts


def _key(row):
    return tuple((x is not None, x) for x in row)


ODD_TEXTS = [
    None,
    "",
    " ",
    "  two  spaces ",
    "▁mark",
    "a ▁ b",
    "<|endoftext|> is text <s> </s> <unk>",
    "tab\tand\nlines\n\n  x",
    "\x1c sep \x1c sep",
    "é漢字 👍 ́ İ ß  end",
    "no break",
    "x" * 500,
    "don't they're we'll 'S 12345 3.14",
    "\x00 zero ​",
]


@pytest.mark.parametrize("hot", [0, 8, alignment.HOT_PAIRS])
def test_against_all_pairs(docs, monkeypatch, hot):
    """Also where few or no counts go to the workers, and windows are forgotten all the time."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    r = random.Random(hot)
    word = lambda: "".join(r.choices("abcdeéz一 '-\n0", k=r.randint(1, 9)))
    texts = [*ODD_TEXTS, *(" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(25))]
    rows = [*((k % 30, t) for k, t in enumerate(texts)), (None, "an id that is missing"), (7, texts[6])]
    found = alignment.align_corpus(docs(rows))
    want, counts = _brute(rows)
    got = [tuple(x) for x in found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert {(x["a"], x["b"]): x["n"] for x in found.pairs.collect()} == dict(counts)


def test_parts_give_the_ids_of_the_whole(monkeypatch):
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcé一\n\t'  ", k=r.randint(1, 6))) for _ in range(60)) for _ in range(30)]
    for vocab in map(alignment.vocabulary, map(public_tokenizers.path, (alignment.FIRST, alignment.SECOND))):
        whole = [x.tolist() for x in alignment.tokenise(texts, vocab)]
        with monkeypatch.context() as m:
            m.setattr(alignment.parts, "__defaults__", (20,))
            assert [x.tolist() for x in alignment.tokenise(texts, vocab)] == whole
        assert sum(map(bool, whole)) > 10


def test_forgetting_counts_once(docs, monkeypatch):
    rows = [(k, "the same words again and again " * 3 + str(k % 5)) for k in range(40)]
    want = {(x["a"], x["b"]): x["n"] for x in alignment.align_corpus(docs(rows)).pairs.collect()}
    windows = alignment.Windows(*(alignment.vocabulary(public_tokenizers.path(x)) for x in (alignment.FIRST, alignment.SECOND)))
    total = Counter()
    for _, text in rows:
        alignment._batch([text], windows)
        for key, n in zip(*windows.counts(), strict=True):
            total[divmod(int(key), len(windows.vocabularies[1]))] += int(n)
        windows.forget()
    assert dict(total) == want


def test_empty_table(docs):
    found = alignment.align_corpus(docs([(1, "x")]).where("doc_id = 2"))
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_query(spark, data):
    got = QUERIES["op11_token_alignment"](spark, data).toPandas().set_index("doc_id")
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(got.index) == sorted(i for i, _ in rows)
    for doc_id, text in rows[:40]:
        a, b, a_bytes, b_bytes = _tokens(text)
        ends_a, ends_b = _ends(a_bytes), _ends(b_bytes)
        row = got.loc[doc_id]
        assert (row["n_a"], row["n_b"], row["n_groups"]) == (len(a), len(b), len(set(ends_a) & set(ends_b)))
        assert row["n_links"] == len(set(ends_a) | set(ends_b)) and row["n_best"] <= row["n_links"] <= row["count_sum"]
        assert len(row["groups_sha256"]) == 64
    text = dict(rows)[got.index[0]]
    whole = alignment.align_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string")).documents.first()["groups"]
    assert got.iloc[0]["groups_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
