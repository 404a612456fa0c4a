"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all normalised items is walked word by word along each text. Its state is the longest
suffix of the text so far that occurs in some item; where that is at least ``window`` words long, the
last ``window`` words occur in an item and are hit. The state that holds exactly these words knows
their items. An item of fewer words (but not none) is looked up as a whole along the suffix links.

Only runs of words that items use at all are walked, and only runs as long as the shortest thing
sought, so a clean text costs one dictionary lookup per word.

The automaton lives in each Python worker. Items are taken in blocks of about ``BLOCK_BYTES`` bytes of
text; a larger benchmark is matched block after block, each pass adding to the hits of the one before.

Edge cases: null and empty texts and items have no words and no hits; items that repeat are hit under
each of their ids; an item without an id is hit under the empty id; empty tables give no hits. Further
columns of the documents are kept, columns named as in ``HITS`` are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.llm.text import byte_total, map_batches, spans, text_bytes, text_session
from quantspan.session import materialize

WINDOW = 10
#: Share of a document's words above which it is dropped as a whole.
MAX_COVERAGE = 0.5
#: Text of the items that one automaton holds (its states take some hundred times as much memory).
BLOCK_BYTES = 1 << 20

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: Words, runs of hit words as [start, end), and the ids of the items, sorted.
HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(_SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]

#: Lower-cases A-Z and turns every other ASCII character but a-z and 0-9 into a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")

Items = tuple[tuple[str, bytes], ...]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """Suffix automaton of word sequences that knows the items of each window."""

    def __init__(self, items: Items, window: int):
        self.window, self.vocabulary = window, _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                texts.append((name, ids))
                state = 0
                for word in ids:
                    state = self._extend(state, word)
        self.shortest = min([window, *(len(ids) for _, ids in texts)])
        self.at_window = self._window_states()
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in texts:
            state = 0
            for k, word in enumerate(ids):
                state = self.next[state][word]
                if k + 1 >= window:
                    self.items.setdefault(self.at_window[state], set()).add(name)
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), name))
        self.up = self._short_above()

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """A state for the strings of ``child`` that ``parent`` leads to; they have further ends now."""
        twin = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: int) -> int:
        child = self.next[last].get(word)
        if child is not None:
            return child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            child = self.next[last][word]
            self.link[new] = child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        return new

    def _by_length(self) -> list[int]:
        return sorted(range(1, len(self.link)), key=self.length.__getitem__)

    def _window_states(self) -> list[int]:
        """For each state the one that holds the last ``window`` words of its strings, or -1."""
        out = [-1] * len(self.link)
        for s in self._by_length():
            if self.length[s] >= self.window:
                out[s] = s if self.length[self.link[s]] < self.window else out[self.link[s]]
        return out

    def _short_above(self) -> list[int]:
        """For each state the nearest one along its suffix links that is a whole short item, or -1."""
        out = [-1] * len(self.link)
        for s in self._by_length():
            above = self.link[s]
            out[s] = above if above in self.short else out[above]
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and by which items."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        hit, names = np.zeros(len(words), bool), set()
        for a, b in spans(ids >= 0):
            if b - a >= self.shortest:
                self._walk(ids[a:b].tolist(), hit[a:b], names)
        return hit, names

    def _walk(self, ids: list[int], hit: np.ndarray, names: set[str]) -> None:
        state, length, window = 0, 0, self.window
        for k, word in enumerate(ids):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= window:
                hit[k - window + 1 : k + 1] = True
                names |= self.items[self.at_window[state]]
            at = state
            while at > 0 and self.short:
                for n, name in self.short.get(at, ()):
                    if n <= length:
                        hit[k - n + 1 : k + 1] = True
                        names.add(name)
                at = self.up[at]


@lru_cache(maxsize=2)
def _automaton(items: Items, window: int) -> Automaton:
    return Automaton(items, window)


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The distinct items in blocks of about ``BLOCK_BYTES``, each small enough for the driver and a worker."""
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    rows = materialize(rows.distinct(), "items")  # rows that repeat would all fall into one block
    n = max(1, -(-byte_total(rows) // BLOCK_BYTES))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield tuple(sorted((name, text.encode()) for name, text in block.collect()))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``HITS``."""
    text_session(docs.sparkSession)
    names = [f.name for f in HITS]
    if set(names) & set(docs.columns):
        raise ValueError(f"there are columns named {names} already")
    schema = T.StructType([*docs.schema.fields, *HITS])
    out = docs
    for k, block in enumerate(_blocks(items)):
        out = materialize(out, "hits") if k else out
        out = out.mapInArrow(_pass(block, window, text, len(docs.columns), schema), schema)
    return out


def _pass(block: Items, window: int, text: str, n_columns: int, schema: T.StructType):
    names, types = schema.names, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, window)
        for batch in batches:
            before = batch.columns[n_columns:]
            rows: list[tuple] = []
            for i, data in enumerate(text_bytes(batch.column(text))):
                words = words_of(data)
                hit, found = automaton.hits(words)
                if before:
                    for s in before[1][i].as_py():
                        hit[s["start"] : s["end"]] = True
                    found |= set(before[2][i].as_py())
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans(hit).tolist()], sorted(found)))
            counts, runs, found = zip(*rows, strict=True) if rows else ((), (), ())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            added = [pa.array(counts, pa.int64()), pa.array(runs, span), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *added], names)

    return run


def n_hit(column: str = "hit_spans"):
    """How many words the spans cover."""
    return F.aggregate(column, F.lit(0), lambda total, s: total + s["end"] - s["start"])


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without what lies from the first to the last word of each run."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_NORMAL))]
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the runs of words that occur in items; documents covered beyond ``max_coverage`` go."""
    covered = F.try_divide(n_hit(), F.col("n_words"))
    found = find_hits(docs, items, window).where(F.coalesce(covered, F.lit(0.0)) <= max_coverage)
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns[: len(names)]
        runs = batch.column("hit_spans").to_pylist()
        if any(runs):
            texts = batch.column("text").to_pylist()
            cuts = [cut_words(t, [(s["start"], s["end"]) for s in own]) if own else t for t, own in zip(texts, runs, strict=True)]
            columns[names.index("text")] = pa.array(cuts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(found, cut, docs.schema)
