import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantspan.llm import bpe, token_output

PARTS = ["a", "the", " the", "  ", " ", "\n", "\n ", "\t", "é", "ß", "1", "²", "'s", "'ll", "!", "?..", "<|endoftext|>", "<|end", "\xa0"]
PARTS += ["\x1c", "\x85", "漢字", "👍", "aaaa", "\r\n", "_", "́", "​", "　", "\x00", "thereupon", "Wort"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    made = ["".join(r.choices(PARTS, k=r.randint(0, 25))) for _ in range(3000)]
    return [*made, "", None, "a" * 3000, "ab" * 2000, "".join(r.choices("abcdefghij", k=8000)), " " * 500, "x\n" * 500]


def _ids(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("coder", [bpe.coder, token_output.library_coder])
def test_coders_agree_with_the_library(library, texts, coder):
    own = coder(bpe.default_path())
    own.clear()
    for some in (texts, texts[::-1]):  # the second time from pieces known
        flat, lengths = own.texts(some)
        got = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
        assert got == _ids(library, some)


def test_rounds_over_few_symbols(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "ROUND_SYMBOLS", 50)
    words = [t.encode() for t in {w for t in texts[:500] if t for w in bpe.PATTERN.findall(t)}]
    flat, lengths = bpe.merge_table(bpe.default_path()).words(words)
    want = [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == want


def test_decode_agrees_with_the_library(library):
    r = np.random.default_rng(1)
    rows = [r.integers(0, 50257, r.integers(0, 30)).tolist() for _ in range(500)]
    lists = bpe.to_lists(np.concatenate(rows).astype(np.int32), np.array([len(x) for x in rows]))
    got = bpe.merge_table(bpe.default_path()).decode(*bpe.list_parts(lists))
    assert got == [library.decode(x, skip_special_tokens=False) for x in rows]


def test_unknown_ids_decode_to_nothing():
    table = bpe.merge_table(bpe.default_path())
    assert table.decode(np.array([-5, 64, 10**6]), np.array([3])) == ["a"]


def test_encode_and_decode(spark, docs, odd, library):
    rows = bpe.decode(bpe.encode(docs(odd))).collect()
    assert [r["ids"] for r in rows] == _ids(library, [t for _, t in odd])
    assert [r["decoded"] for r in rows] == [t or "" for _, t in odd]
    assert bpe.encode(docs([])).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs(odd), ids="part")


def test_files(spark, docs, odd, library, tmp_path):
    token_output.write_tokens(docs(odd).repartition(3), str(tmp_path / "t"))
    files = token_output.read_tokens(spark, str(tmp_path / "t"))
    rows = files.join(token_output.starts(files), "part").withColumn("start", F.col("before") + F.col("first")).collect()
    want = sorted((-1 if i is None else i, [*ids, 0]) for (i, _), ids in zip(odd, _ids(library, [t for _, t in odd]), strict=True))
    rows = sorted(rows, key=lambda r: r["start"])
    assert [(-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    assert [r["n_tokens"] for r in rows] == [len(x) for _, x in want]
    some = token_output.read_tokens(spark, str(tmp_path / "t"), low=4, high=6)
    assert sorted(r["doc_id"] for r in some.collect()) == [4, 5, 6]
    assert [r["doc_id"] for r in token_output.read_tokens(spark, str(tmp_path / "t"), ids=[7]).collect()] == [7]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,4)" in some._jdf.queryExecution().toString()


def test_files_of_no_rows(spark, docs, tmp_path):
    token_output.write_tokens(docs([]), str(tmp_path / "t"))
    assert token_output.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_queries(spark, data, library):
    from quantspan.llm.queries import QUERIES

    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    ids = _ids(library, [r["text"] for r in rows])
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe_round_trip"](spark, data).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r, own in zip(rows, ids, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(own), sha(",".join(map(str, own))), sha(r["text"] or ""))
    got, start = {r["doc_id"]: r for r in QUERIES["op3_orc_tokens"](spark, data).collect()}, 0
    for r, own in zip(rows, ids, strict=True):
        whole = np.array([*own, 0], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_list_parts_of_a_slice():
    lists = pa.array([[1, 2], [], None, [3]])
    values, lengths = bpe.list_parts(lists.slice(1))
    assert values.tolist() == [3] and lengths.tolist() == [0, 0, 1]
