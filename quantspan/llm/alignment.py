"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

A text, with a space before it, is tokenised whole by both tokenizers. Byte offsets at which a token of
each ends are shared ends; they cut the tokens into groups. A shared end after which both tokenizers go
on with a token that begins with a space is an anchor. Anchors cut a text into windows, mostly of one
word, and how a window's tokens align depends on their ids alone. So each worker keeps the alignment of
a window under the ids of both sides, and a text's alignment is put together from those of its windows.

1. Texts are tokenised and aligned once. Each has its distinct links (pairs of ids whose byte ranges
   overlap) with how often it has them; each task adds up the pairs of its windows. Both are written.
2. Spark adds up the pairs of all tasks. The most frequent pairs, ``HOT_PAIRS`` at most, and the
   highest count of each id of the second vocabulary (bounded by its size) go to every worker; links of
   all other pairs are joined with the table of counts.

Memory: texts are tokenised in parts of about ``PART_CHARS`` characters or less, cut where one space stands between
two other characters (no token of either vocabulary holds what is before and after such a place); kept windows are
given up once they hold ``CACHE_LINKS`` links. A batch and its tokens are held at once.

Edge cases: null and empty texts have no tokens, nor have texts whose tokens of either side do not make up
the text with a space before it (which holds for texts with the second tokenizer's space mark in them).
Rows that repeat stay apart and count each time, also rows without a ``doc_id``; a table without rows
gives none. Strings of special tokens are plain text. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.bpe import Coded, byte_letters, gather, list_parts
from quantspan.llm.text import text_session
from quantspan.llm.token_output import library_coder
from quantspan.session import materialize

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters that are tokenised at a time.
PART_CHARS = 1 << 16
#: Windows and links of windows that a worker keeps before it starts anew.
CACHE_WINDOWS, CACHE_LINKS = 300_000, 2_000_000
#: Pairs of ids whose counts go to every worker.
HOT_PAIRS = 1 << 18
#: Pairs in one row of a task's counts.
CHUNK = 1 << 15

c = F.col

#: One space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Vocabulary:
    """Ids of texts (each end to end, and how many it has), and the bytes of each id."""

    encode: Callable[[list[str]], Coded]
    flat: np.ndarray
    counts: np.ndarray
    starts: np.ndarray = field(init=False)
    spaced: np.ndarray = field(init=False)

    def __post_init__(self):
        self.starts = np.cumsum(self.counts) - self.counts
        self.spaced = np.zeros(len(self.counts), bool)
        full = np.flatnonzero(self.counts)
        self.spaced[full] = self.flat[self.starts[full]] == ord(" ")

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, encode: Callable[[list[str]], Coded], tokens: list[bytes]) -> Vocabulary:
        return cls(encode, np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64))

    def text(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.starts[ids], self.counts[ids]).tobytes()


@cache
def byte_level(path: str) -> Vocabulary:
    """A vocabulary file of byte-level BPE; a text is encoded with a space before it."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    letters = byte_letters()
    tokens = {i: bytes(letters[x] for x in t) for t, i in read["model"]["vocab"].items()}
    tokens = {t["id"]: t["content"].encode() for t in read["added_tokens"]} | tokens
    coder = library_coder(path, plain_specials=True)
    return Vocabulary.of(lambda texts: coder.texts([" " + t for t in texts]), [tokens.get(i, b"") for i in range(max(tokens) + 1)])


@cache
def pieces(path: str) -> Vocabulary:
    """A sentencepiece model, which puts the space before a text itself."""
    from sentencepiece import SentencePieceProcessor

    coder = SentencePieceProcessor(model_file=path)

    def token(i: int) -> bytes:
        piece = coder.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(texts: list[str]) -> Coded:
        rows = [np.concatenate([np.array(coder.encode(part), np.int32) for part in parts(t)]) for t in texts]
        return np.concatenate([np.empty(0, np.int32), *rows]), np.array([len(r) for r in rows], np.int64)

    return Vocabulary.of(encode, [token(i) for i in range(coder.get_piece_size())])


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, by its suffix."""
    return byte_level(path) if path.endswith(".json") else pieces(path)


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """``text`` cut at spaces between words, each of which is left out, into parts of ``size`` characters or little more."""
    out, first = [], 0
    while len(text) - first > size:
        cut = _CUT.search(text, first + size)
        if not cut:
            break
        out.append(text[first : cut.start()])
        first = cut.end()
    return [*out, text[first:]]


def tokenise(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of a space and each text; none where they do not make it up."""
    ids, lengths = vocab.encode(texts)
    data = vocab.text(ids)
    sizes = _sums(vocab.counts[ids], lengths)
    rows, at = [], 0
    for row, text, n in zip(np.split(ids, np.cumsum(lengths)[:-1]), texts, sizes.tolist(), strict=True):
        rows.append(row if data[at : at + n] == b" " + text.encode() else row[:0])
        at += n
    return rows


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs."""
    ends = np.concatenate([[0], np.cumsum(values)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(lengths)])])


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, first: Vocabulary, second: Vocabulary):
    """Alignments of windows whose tokens lie end to end, ``n_a`` and ``n_b`` in each.

    Returns the links as pairs of places in ``a`` and ``b``, how many links and groups each window has, and its groups as text.
    A link ends where a token of either side ends.
    """
    ends_a, ends_b = np.cumsum(first.counts[a]), np.cumsum(second.counts[b])
    ends = np.union1d(ends_a, ends_b)
    i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    stops = ends_a[np.cumsum(n_a) - 1]
    n_links = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
    shared = (ends_a[i] == ends) & (ends_b[j] == ends)
    groups_upto = np.cumsum(shared)
    n_groups = np.diff(groups_upto[np.cumsum(n_links) - 1], prepend=0)

    # tokens group by group, those of the first side before those of the second, each behind its mark
    upto_a, upto_b = i[shared] + 1, j[shared] + 1
    k_a, k_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    at_a = np.arange(len(a)) + np.repeat(upto_b - k_b, k_a)
    at_b = np.arange(len(b)) + np.repeat(upto_a, k_b)
    opens_a = np.zeros(len(a), np.int64)
    opens_a[upto_a - k_a] = 1  # a group behind another
    opens_a[np.cumsum(n_a) - n_a] = 2  # the first group of a window
    opens_b = np.zeros(len(b), np.int64)
    opens_b[upto_b - k_b] = 3
    words = np.empty(len(a) + len(b), object)
    marks = np.array([",", ";", "", "|"], object)
    words[at_a] = marks[opens_a] + np.array(list(map(str, a.tolist())), object)
    words[at_b] = marks[opens_b] + np.array(list(map(str, b.tolist())), object)
    cuts = [0, *np.cumsum(n_a + n_b).tolist()]
    flat = words.tolist()
    return i, j, n_links, n_groups, ["".join(flat[x:y]) for x, y in pairwise(cuts)]


class Windows(dict):
    """From the ids of a window, as bytes, to its number; how many groups and which links each has, and how often it came."""

    def __init__(self, first: Vocabulary, second: Vocabulary):
        super().__init__()
        self.vocabularies = first, second
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.texts: list[str] = []
        self.flat, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.groups, self.seen = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.lengths) > CACHE_WINDOWS or len(self.flat) > CACHE_LINKS

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        self[key] = number = len(self)
        return number

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.new:
            ids = np.frombuffer(b"".join(self.new), np.int32)
            gaps = np.flatnonzero(ids < 0)  # one in each window, between its sides
            stops = np.cumsum([len(x) for x in self.new]) // 4
            starts = np.concatenate([[0], stops[:-1]])
            side = np.zeros(len(ids), bool)
            side[gaps] = True
            second = np.cumsum(side) > np.repeat(np.arange(len(stops)), stops - starts)
            a, b = ids[~second], ids[second & ~side]
            i, j, n_links, n_groups, texts = align(a, b, gaps - starts, stops - gaps - 1, *self.vocabularies)
            self.flat = np.concatenate([self.flat, a[i].astype(np.int64) * len(self.vocabularies[1]) + b[j]])
            self.lengths = np.concatenate([self.lengths, n_links])
            self.groups = np.concatenate([self.groups, n_groups])
            self.seen = np.concatenate([self.seen, np.zeros(len(stops), np.int64)])
            self.texts += texts
            self.new = []
        self.seen += np.bincount(found, minlength=len(self.seen))
        return found

    def links(self, numbers: np.ndarray) -> np.ndarray:
        starts = np.cumsum(self.lengths) - self.lengths
        return gather(self.flat, starts[numbers], self.lengths[numbers])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of all windows that came, and how often."""
        keys, place = np.unique(self.flat, return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, place, np.repeat(self.seen, self.lengths))
        return keys, times


def cut_windows(a: np.ndarray, b: np.ndarray, first: Vocabulary, second: Vocabulary) -> tuple[list[bytes], np.ndarray]:
    """Windows of the tokens of texts that lie end to end: their ids (a gap of -1 between the sides) and byte ends."""
    ends_a, ends_b = np.cumsum(first.counts[a]), np.cumsum(second.counts[b])
    at_b = np.zeros(int(ends_b[-1]) + 1, bool)
    at_b[ends_b] = True
    i = np.flatnonzero(at_b[ends_a])
    j = np.searchsorted(ends_b, ends_a[i])
    marked = np.append(first.spaced[a], True)[i + 1] & np.append(second.spaced[b], True)[j + 1]
    i, j = i[marked], j[marked]
    n_a, n_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
    sizes = n_a + 1 + n_b
    stops = np.cumsum(sizes)
    starts = stops - sizes
    ids = np.full(int(stops[-1]), -1, np.int32)
    ids[np.arange(len(a)) + np.repeat(starts - (np.cumsum(n_a) - n_a), n_a)] = a
    ids[np.arange(len(b)) + np.repeat(starts + n_a + 1 - (np.cumsum(n_b) - n_b), n_b)] = b
    data = ids.tobytes()
    return [data[4 * s : 4 * e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], ends_a[i]


def _batch(texts: list[str | None], windows: Windows) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text the numbers of ids of both sides and of windows; then all windows in order."""
    first, second = windows.vocabularies
    filled = [t for t in texts if t]
    both = zip(*(tokenise(filled, v) for v in (first, second)), strict=True) if filled else iter(())
    none = np.empty(0, np.int32)
    rows = [next(both) if t else (none, none) for t in texts]
    rows = [(a, b) if len(a) and len(b) else (none, none) for a, b in rows]
    n_a, n_b = (np.array([len(r[k]) for r in rows], np.int64) for k in (0, 1))
    if not n_a.any():
        return [n_a, n_b], np.zeros(len(rows), np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    keys, ends = cut_windows(a, b, first, second)
    text_ends = np.concatenate([[0], np.cumsum(first.counts[a])])[np.cumsum(n_a)]
    upto = np.searchsorted(ends, text_ends, "right")
    return [n_a, n_b], np.diff(upto, prepend=0), windows.numbers(keys)


def _longs(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _ints(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


_STATE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups {groups}, keys array<{key}>, times array<int>, sums array<long>"


def _aligned(docs: DataFrame, paths: tuple[str, str], digest: Callable[[str], str]) -> DataFrame:
    """A row for each text (``row`` not null) with its distinct pairs, and rows of pairs that a task has counted."""
    key_type = "int" if len(vocabulary(paths[0])) * len(vocabulary(paths[1])) < 1 << 31 else "long"
    lists = _ints if key_type == "int" else _longs
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times", "sums"]

    def counted(windows: Windows) -> Iterator[pa.RecordBatch]:
        keys, times = windows.counts()
        for k in range(0, len(keys), CHUNK):
            n = np.array([len(keys[k : k + CHUNK])])
            none = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string())]
            yield pa.RecordBatch.from_arrays([*none, lists(keys[k : k + CHUNK], n), lists_of_none(), _longs(times[k : k + CHUNK], n)], names)

    def lists_of_none() -> pa.Array:
        return pa.nulls(1, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*map(vocabulary, paths))
        for batch in batches:
            if not batch.num_rows:
                continue
            if windows.full:
                yield from counted(windows)
                windows.forget()
            (n_a, n_b), per_row, numbers = _batch(batch.column("text").to_pylist(), windows)
            n_links = _sums(windows.lengths[numbers], per_row)
            owner = np.repeat(np.arange(len(n_links)), n_links)
            pairs, times = np.unique(owner << 40 | windows.links(numbers), return_counts=True)
            own = np.bincount(pairs >> 40, minlength=len(n_links))
            cuts = np.concatenate([[0], np.cumsum(per_row)]).tolist()
            texts = list(map(windows.texts.__getitem__, numbers.tolist()))
            groups = [digest(";".join(texts[x:y])) if y > x else "" for x, y in pairwise(cuts)]
            counts = map(pa.array, (n_a, n_b, _sums(windows.groups[numbers], per_row), n_links))
            lists_ = lists(pairs & ((1 << 40) - 1), own), _ints(times, own), pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *counts, pa.array(groups, pa.string()), *lists_], names)
        yield from counted(windows)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), c("doc_id").cast("long"), c("text").cast("string"))
    return rows.mapInArrow(run, _STATE.format(groups="string", key=key_type))


def _hot(pairs: DataFrame) -> DataFrame:
    """The most frequent pairs: those counted from a power of two on, so that they are no more than ``HOT_PAIRS``."""
    sizes = pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()
    held, least = 0, 1 << 62
    for row in sorted(sizes, key=lambda r: -r["bits"]):
        held += row["count"]
        if held > HOT_PAIRS:
            break
        least = 1 << (row["bits"] - 1)
    return pairs.where(c("n") >= least)


@dataclass
class Alignment:
    """``documents``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``; ``pairs``: ``a, b, n``."""

    documents: DataFrame
    pairs: DataFrame


def align_corpus(
    docs: DataFrame, first: str | None = None, second: str | None = None, digest: Callable[[str], str] = str
) -> Alignment:
    """Alignments of all ``docs`` (``doc_id, text``) by two vocabulary files.

    ``groups`` are the ids of each group as text (``1,2|3;4|5,6``), or what ``digest`` makes of that;
    empty for texts without tokens.
    """
    spark = text_session(docs.sparkSession)
    paths = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    size = len(vocabulary(paths[1]))
    state = materialize(_aligned(docs, paths, digest), "aligned")
    counted = state.where("row is null").select(F.explode(F.arrays_zip("keys", "sums")).alias("p"))
    pairs = materialize(counted.groupBy(c("p.keys").alias("key")).agg(F.sum("p.sums").alias("n")), "pairs")

    hot = _hot(pairs).toArrow().sort_by("key")
    best = pairs.groupBy((c("key") % size).alias("b")).agg(F.max("n").alias("n")).toArrow()
    highest = np.zeros(size, np.int64)
    highest[best["b"].to_numpy()] = best["n"].to_numpy()
    shared = spark.sparkContext.broadcast((hot["key"].to_numpy().astype(np.int64), hot["n"].to_numpy(), highest))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, highest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            (own, lengths), (times, _) = list_parts(batch.column("keys")), list_parts(batch.column("times"))
            own, times = own.astype(np.int64), times.astype(np.int64)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            n = np.where(known, counts[at], 0) if len(keys) else np.zeros(len(own), np.int64)
            is_best = known & (n == highest[own % size])
            total, n_best = _sums(n * times, lengths), _sums(times * is_best, lengths)
            left = _sums(~known, lengths)
            rest = _longs(own[~known], left), _longs(times[~known], left)
            kept = [batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(total), *rest], [*names, "n_best", "count_sum", "keys", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long, keys array<long>, times array<long>"
    summed = materialize(state.where("row is not null").mapInArrow(add_counts, schema), "summed")
    rare = summed.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "times")).alias("p"))
    rare = rare.select("row", c("p.keys").alias("key"), c("p.times").alias("times")).join(pairs, "key")
    tops = pairs.groupBy((c("key") % size).alias("b")).agg(F.max("n").alias("top"))
    rare = rare.withColumn("b", c("key") % size).join(tops, "b").groupBy("row")
    more = rare.agg(F.sum(c("n") * c("times")).alias("more_sum"), F.sum(F.when(c("n") == c("top"), c("times")).otherwise(0)).alias("more_best"))
    documents = summed.join(more, "row", "left").select(
        *names[1:-1],
        (c("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (c("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups",
    )
    ids = (c("key") / size).cast("long").alias("a"), (c("key") % size).cast("long").alias("b")
    return Alignment(documents, pairs.select(*ids, "n"))
