"""Substring dedup: word windows that an earlier document holds too are removed.

Every window of ``size`` consecutive words has a Rabin-Karp hash (64 bits, so two texts share one by
chance about once in 2**64 pairs). What decides about a window is the smallest ``doc_id`` that holds it:

1. Each Arrow batch groups its windows by hash. Of the documents of a batch that share a window, all but
   the smallest are decided at once; one entry (hash, smallest document) goes on. A window that a third
   of all documents hold therefore leaves a batch once, and no key is hot.
2. Entries are dealt by hash into parts of bounded size, packed as arrays so that a part is a few rows
   per batch rather than one row per window. A part finds the smallest document of each hash; every
   other document has a repeat there.
3. Repeats are dealt by document into groups of bounded size, packed too, and meet the texts there. A
   document hashes its windows again, and the repeated ones merge into maximal intervals of words.

Windows are judged on the input. Repeats within one document alone are kept.

Edge cases: null and empty texts have no words; texts shorter than a window keep all of them; rows
that share a ``doc_id`` count as one document in comparisons; rows with a null ``doc_id`` are neither
compared nor cut; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.text import WORDS, parts_for, rolling, spans, text_bytes, text_session

SIZE = 13
#: Text whose windows one part holds, some 10 bytes per window in shuffle and memory.
PART_BYTES = 16 << 20

_PACKED = "part int, decided boolean, docs binary, counts binary, hashes binary"
_REPEATS = "part int, docs binary, counts binary, hashes binary"
_RESULT = "doc_id long, n_words long, text string, removed array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _by_document(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in order, how many hashes each has, and these."""
    order = np.argsort(docs, kind="stable")
    ids, counts = np.unique(docs, return_counts=True)
    return ids, counts, hashes[order]


def _smallest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes and their smallest document; and the entries of all other documents."""
    order = np.argsort(hashes)
    h, d = hashes[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    least = np.minimum.reduceat(d, starts) if len(h) else d
    later = d > np.repeat(least, np.diff(np.concatenate([starts, [len(h)]])))
    return h[starts], least, h[later], d[later]


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PACKED_ARROW = pa.schema(
    [("part", pa.int32()), ("decided", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())]
)


def _deal(hashes: np.ndarray, docs: np.ndarray, by: np.ndarray, parts: int, decided: bool) -> Iterator[tuple]:
    part = (by % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    hashes, docs = hashes[order], docs[order]
    ends = np.cumsum(np.bincount(part, minlength=parts))
    for k in np.flatnonzero(np.diff(np.concatenate([[0], ends]))):
        a, b = ends[k - 1] if k else 0, ends[k]
        ids, counts, own = _by_document(docs[a:b], hashes[a:b])
        yield int(k), decided, ids.tobytes(), counts.astype(np.int32).tobytes(), own.tobytes()


def _windows(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """One packed row per batch and part, of entries to compare and of entries decided within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, rolling(WORDS.of(t.split()), size)) for i, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True)]
            own = [(i, h) for i, h in own if len(h)]
            if own:
                ids = np.repeat(np.array([i for i, _ in own], np.int64), [len(h) for _, h in own])
                first, least, later, docs_ = _smallest(np.concatenate([h for _, h in own]), ids)
                rows = [*_deal(first, least, first, parts, False), *_deal(later, docs_, docs_.astype(np.uint64), parts, True)]
                yield _packed(rows, _PACKED_ARROW)

    known = docs.where("doc_id is not null and text is not null")
    return known.mapInArrow(run, _PACKED)


def _compare(group: pa.Table, parts: int) -> pa.Table:
    """Repeats among the entries of one part, by the part of their documents."""
    pieces = []
    for decided in (False, True):
        rows = group.filter(pa.compute.equal(group["decided"], decided))
        docs, hashes = _unpack(rows)
        pieces.append((hashes, docs) if decided else _smallest(hashes, docs)[2:])
    hashes, docs = (np.concatenate(x) for x in zip(*pieces, strict=True))
    rows = [(part, *arrays) for part, _, *arrays in _deal(hashes, docs, _document_part(docs, parts), parts, True)]
    schema = pa.schema([f for f in _PACKED_ARROW if f.name != "decided"])
    return pa.Table.from_batches([_packed(rows, schema)] if rows else [], schema=schema)


def _document_part(docs: np.ndarray, parts: int) -> np.ndarray:
    """What ``pmod(xxhash64(doc_id), parts)`` gives."""
    ids, place = np.unique(docs, return_inverse=True)
    hashed = [xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) for i in ids]
    return (np.array(hashed, np.uint64).view(np.int64) % parts).astype(np.uint64)[place]


def _unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of packed rows, one entry each."""
    read = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)
    return np.repeat(read("docs", np.int64), read("counts", np.int32)), read("hashes", np.uint64)


def _cut(rows: pa.Table, repeats: pa.Table, size: int) -> pa.Table:
    """The result for the documents of one group, by their repeated hashes."""
    ids, counts_, hashes = _by_document(*_unpack(repeats))
    ends = dict(zip(ids.tolist(), zip((np.cumsum(counts_) - counts_).tolist(), np.cumsum(counts_).tolist(), strict=True), strict=True))
    counts, texts, runs = [], [], []
    for doc, text in zip(rows["doc_id"].to_pylist(), text_bytes(rows["text"].combine_chunks()), strict=True):
        words = (text or b"").split()
        covered = np.zeros(len(words), bool)
        if doc in ends and len(words) >= size:
            again = np.isin(rolling(WORDS.of(words), size), hashes[slice(*ends[doc])])
            change = np.zeros(len(words) + 1, np.int64)
            change[: len(again)] += again
            change[size : size + len(again)] -= again
            covered = np.cumsum(change[:-1]) > 0
            words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
        counts.append(len(covered))
        texts.append(b" ".join(words).decode())
        runs.append([{"start": a, "end": b} for a, b in spans(covered).tolist()])
    columns = [rows["doc_id"], pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(runs, _SPANS)]
    return pa.table(columns, ["doc_id", "n_words", "text", "removed"])


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: its words, the kept ones joined by one space, and the removed runs of words as [start, end)."""
    text_session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = parts_for(rows, PART_BYTES)
    packed = _windows(rows, size, parts)
    repeats = packed.groupBy("part").applyInArrow(lambda group: _compare(group, parts), _REPEATS)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(lambda texts, found: _cut(texts, found, size), _RESULT)


def n_removed(column: str = "removed"):
    """How many words the spans cover."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
