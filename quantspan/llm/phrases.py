"""Lempel-Ziv phrase fingerprints: texts that compress alike have like sets of phrases.

A text is parsed from left to right into phrases: each is the longest phrase met before, and one more
character, which makes it a new phrase. A text's fingerprint is the ``SIZE`` smallest hashes of its set
of phrases. The likeness of two fingerprints is the share of the smallest hashes of both together that
both have, which estimates the Jaccard similarity of the sets of phrases.

All beginnings of a phrase are phrases, so they are kept as a tree, in which a character is one step, however
long the phrases get. Phrases that end within the part that an edited text shares with its original are
the same, so the edited text is parsed from there on.

``compare_in_order`` walks through a table in descending order of ids. Rows are dealt by ranges and
sorted by Spark; a task streams through its rows and holds two of them at a time. The first row of a
range ends the comparison of the last one of the range before: these, one row a range each, are joined.

Edge cases: a null text counts as empty; an empty text has an empty fingerprint, which is like another
empty one (1.0) and unlike all else (0.0). Rows that share an id stay apart, ordered by hashes of their texts and then by their
places in the table; rows without an id come last; the row after the last one is the first, which in a
table of one row is the row itself. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.llm.text import mix, text_session
from quantspan.session import materialize

#: Hashes in a fingerprint, of 32 bits each.
SIZE = 64

#: Points of a text whose phrases are hashed at a time, and bits of a code point.
SEGMENT, POINT_BITS = 1 << 16, 21
_BASE = 0x9E3779B97F4A7C15

c = F.col


def parse(points: list[int], start: int, steps: dict[int, int], ends: list[int]) -> None:
    """Where the phrases of a text (code points) from ``start`` on end; ``ends`` has those before, and is added to.

    A phrase is a node of a tree, its number the place in ``ends``, from 1 on; ``steps`` leads from a node (its number
    shifted by ``POINT_BITS``) and a point to a node. It has one step a phrase, in their order. What is left at the end
    is a phrase met before.
    """
    node, new = 0, (len(ends) + 1) << POINT_BITS
    step = steps.get
    for at, point in enumerate(points[start:] if start else points, start + 1):
        key = node | point
        node = step(key)
        if node is None:
            steps[key] = new
            new += 1 << POINT_BITS
            node = 0
            ends.append(at)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``2 ** bits`` of them."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, x, np.uint64)])) for x in (_BASE, inverse))


def phrase_hashes(points: np.ndarray, first: int, ends: np.ndarray) -> np.ndarray:
    """32-bit hashes of the phrases that lie end to end from ``first`` on."""
    starts = np.concatenate([[first], ends[:-1]])[: len(ends)]
    out = [np.empty(0, np.uint32)]
    for group in np.split(np.arange(len(ends)), np.flatnonzero(np.diff((starts - first) // SEGMENT)) + 1):
        if not len(group):
            continue
        low, high = starts[group[0]], ends[group[-1]]
        up, down = _powers(max(12, int(high - low).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((points[low:high] + np.uint64(1)) * up[: high - low], dtype=np.uint64)])
        own = (sums[ends[group] - low] - sums[starts[group] - low]) * down[starts[group] - low]
        out.append((mix(own) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the hashes, in order."""
    if len(hashes) > 4 * SIZE:
        hashes = hashes[hashes <= np.partition(hashes, 2 * SIZE)[2 * SIZE]]
    return np.unique(hashes)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smallest hashes of both fingerprints that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    least = both[np.concatenate([[True], ~again])][:SIZE]
    return float((both[1:][again] <= least[-1]).sum()) / len(least)


class Parsed:
    """A text and its phrases, from which those of an edited text are found."""

    def __init__(self, text: str | None):
        self.text = text or ""
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.steps: dict[int, int] = {}
        self.ends: list[int] = []
        parse(points.tolist(), 0, self.steps, self.ends)
        self.hashes = phrase_hashes(points, 0, np.array(self.ends, np.int64))
        self.fingerprint = sketch(self.hashes)

    def edited(self, keep: int, tail: str) -> tuple[str, np.ndarray]:
        """The first ``keep`` characters and then ``tail``, and the fingerprint of that. Uses up the phrases."""
        new = self.text[:keep] + tail
        if new == self.text:
            return new, self.fingerprint
        same = bisect_right(self.ends, keep)
        for _ in range(len(self.ends) - same):
            self.steps.popitem()
        del self.ends[same:]
        first = self.ends[-1] if same else 0
        points = np.frombuffer(new.encode("utf-32-le"), np.uint32)
        parse(points.tolist(), first, self.steps, self.ends)
        added = phrase_hashes(points, first, np.array(self.ends[same:], np.int64))
        return new, sketch(np.concatenate([self.hashes[:same], added]))


def fingerprint(text: str | None) -> np.ndarray:
    return Parsed(text).fingerprint


def packed(sketch_: np.ndarray) -> bytes:
    return sketch_.astype(">u4").tobytes()


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text, as bytes (32-bit hashes, ascending, high byte first)."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    text_session(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([packed(fingerprint(t)) for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], schema.names)

    return docs.mapInArrow(run, schema)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(doc_id: int | None, own: Parsed, after: Parsed) -> tuple:
    """A row of ``_SCHEMA``: the text whose last third the beginning of the next one replaces, and the likenesses."""
    n = len(own.text)
    edited, sketch_ = own.edited(n - n // 3, after.text[: n // 3])
    sha = hashlib.sha256(edited.encode()).digest()
    near = likeness(own.fingerprint, sketch_), likeness(own.fingerprint, after.fingerprint)
    return (doc_id, n, sha, packed(own.fingerprint), packed(sketch_), *near)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the next; the first row and the last, which lacks its next one, also come as they are."""
    part, names = TaskContext.get().partitionId(), [*_NAMES, "part", "border", "text"]
    held = None

    def borders(name: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        none = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, kind) for kind in _KINDS[1:])]
        return pa.RecordBatch.from_arrays([*none, pa.array([part], pa.int32()), pa.array([name]), pa.array([text], pa.string())], names)

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = Parsed(text)
            if held is None:
                yield borders("first", doc_id, own.text)
            else:
                rows.append(_compared(*held, own))
            held = doc_id, own
        if rows:
            n = len(rows)
            yield pa.RecordBatch.from_arrays([*_columns(rows), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
    if held is not None:
        yield borders("last", held[0], held[1].text)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(x).to_pylist() for x in ("doc_id", "text", "after"))
        rows = [_compared(doc_id, Parsed(text), Parsed(after)) for doc_id, text, after in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(_columns(rows), _NAMES)


def compare_in_order(docs: DataFrame) -> DataFrame:
    """Each text, in descending order of ``doc_id``, beside an edited form of it and beside the next text.

    Gives ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (bytes), ``near_edited, near_next``.
    In the edited text the last third of the characters (rounded down) is replaced by as many from
    the beginning of the next text, or by all of that if it has fewer.
    """
    text_session(docs.sparkSession)
    rows = docs.select(c("doc_id").cast("long"), c("text").cast("string"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("place")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = materialize(ordered.mapInArrow(_walk, f"{_SCHEMA}, part int, border string, text string"), "walked")

    firsts = walked.where("border = 'first'").select(c("part").alias("at"), c("text").alias("after"))
    parts = walked.where("border = 'first'").select("part")  # one number a range
    following = F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy(F.lit(0))))
    lasts = walked.where("border = 'last'").select("part", "doc_id", "text").join(parts.select("part", following.alias("at")), "part")
    ends = lasts.join(firsts, "at").select("doc_id", "text", "after").mapInArrow(_finish, _SCHEMA)
    return walked.where("border is null").select(*_NAMES).unionByName(ends)
