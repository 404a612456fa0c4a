"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

The symbols of many words lie in one flat array. In each round every word merges all places of its
lowest-rank pair at once, which gives the same symbols as merging them one by one: a pair made by a
merge always ranks after it. Ranks of pairs are found by binary search over the sorted pair keys and
kept, so a round looks up only the pairs next to a merge. Words without a pair to merge leave the
array.

A text is cut before each space that follows a character other than white space. The splitting
pattern never joins what lies on both sides of such a cut, so equal pieces encode equally wherever
they stand, and a worker encodes a piece once (``PieceCoder``).

Edge cases: a null text counts as empty, an empty text has no ids, strings of the special tokens in a
text become their ids, ids that the vocabulary lacks decode to nothing, and bytes that are not UTF-8
decode to the replacement character. Other columns are left as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantspan.llm.text import CACHE_WORDS

DEFAULT = "byte_bpe_50k.json"
_NO_RANK = np.int32(2**31 - 1)
#: Symbols that one series of merge rounds works on.
ROUND_SYMBOLS = 1 << 20

#: A space after white space: such a text is cut by the pattern itself.
_ODD = re.compile("[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
PATTERN = regex.compile(public_tokenizers.PATTERN)

Coded = tuple[np.ndarray, np.ndarray]


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for each start and length, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class PieceCoder:
    """Ids of texts from ids of their pieces. ``encode`` codes pieces not seen before; ``kept`` is how many it remembers."""

    def __init__(self, encode: Callable[[list[str]], Coded], specials: dict[str, int], kept: int = CACHE_WORDS):
        self.encode, self.specials, self.kept = encode, specials, kept
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.clear()

    def clear(self) -> None:
        self.places = {"": _Places(self, ""), " ": _Places(self, " ")}
        self.new: list[str] = []
        self.size = 0
        self.flat, self.lengths, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _places(self, text: str) -> np.ndarray:
        """The places of a text's pieces in the store."""
        first, after = self.places[""], self.places[" "]
        if not text:
            return np.empty(0, np.int64)
        if _ODD.search(text):
            return np.array([first[x] for x in PATTERN.findall(text)], np.int64)
        head, *rest = text.split(" ")
        own = np.fromiter(map(after.__getitem__, rest), np.int64, len(rest))
        return np.concatenate([[first[head]], own]) if head else own

    def texts(self, texts: list[str | None]) -> Coded:
        """Ids of all texts end to end, and how many each has."""
        if self.size > self.kept:
            self.clear()
        rows = []
        for text in texts:
            if text and self.split and any(s in text for s in self.specials):
                parts = enumerate(self.split.split(text))
                rows.append(np.concatenate([[self.places[""][x]] if k % 2 else self._places(x) for k, x in parts]))
            else:
                rows.append(self._places(text or ""))
        if self.new:
            flat, lengths = self.encode(self.new)
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int64)])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.new = []
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        places = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        lengths = self.lengths[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.flat, self.starts[places], lengths), np.diff(ends[cuts])


class _Places(dict):
    """From a piece, without what it begins with, to its place; a new piece gets the next one."""

    def __init__(self, owner: PieceCoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> int:
        self[piece] = place = self.owner.size
        self.owner.size += 1
        self.owner.new.append(self.lead + piece)
        return place


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class MergeTable:
    """The merges of a vocabulary file as sorted pair keys, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.specials = special_tokens(path)
        tokens = {i: bytes(letters[x] for x in t) for t, i in vocab.items()}
        tokens |= {i: t.encode() for t, i in self.specials.items()}
        each = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(each), np.uint8)
        self.byte_counts = np.array([len(x) for x in each], np.int64)
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search; ``_NO_RANK`` where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def words(self, words: list[bytes]) -> Coded:
        """Ids of each word, in rounds over at most about ``ROUND_SYMBOLS`` symbols."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, lengths, first, held = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0, 0
        for k, n in enumerate(sizes):
            held += n
            if held >= ROUND_SYMBOLS or k == len(words) - 1:
                ids, counts = self._rounds(np.frombuffer(b"".join(words[first : k + 1]), np.uint8), sizes[first : k + 1])
                flat.append(ids)
                lengths.append(counts)
                first, held = k + 1, 0
        return np.concatenate(flat), np.concatenate(lengths)

    def _rounds(self, data: np.ndarray, sizes: np.ndarray) -> Coded:
        symbols, word = self.of_byte[data], np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        ranks = self._all_ranks(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(word)]]))
            least = np.minimum.reduceat(ranks, starts)
            ended = np.repeat(least == _NO_RANK, counts)
            if ended.any():
                done_symbols.append(symbols[ended])
                done_words.append(word[ended])
                symbols, word, ranks = symbols[~ended], word[~ended], ranks[~ended]
                least, counts = least[least != _NO_RANK], counts[least != _NO_RANK]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, counts))
            if len(at) > 1:  # of places that overlap, every other one from the left
                begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
                run = at[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
                at = at[(at - run) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # where the merged symbols are after the others have moved up
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            for places in (now, now[now > 0] - 1):
                self._renew(symbols, word, ranks, places)
        order = np.argsort(np.concatenate(done_words), kind="stable")
        counts = np.bincount(np.concatenate(done_words), minlength=len(sizes))
        return np.concatenate(done_symbols)[order], counts

    def _all_ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), _NO_RANK)
        self._renew(symbols, word, ranks, np.arange(len(symbols)))
        return ranks

    def _renew(self, symbols: np.ndarray, word: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> None:
        """Ranks of the pairs that begin at ``places``; the last symbol of a word begins none."""
        ranks[places] = _NO_RANK
        places = places[places < len(symbols) - 1]
        places = places[word[places] == word[places + 1]]
        ranks[places] = self.rank(symbols[places], symbols[places + 1])

    def pieces(self, pieces: list[str]) -> Coded:
        """Ids of pieces: split by the pattern, each distinct word encoded once."""
        place: dict[str, int] = {}
        rows = [[place.setdefault(w, len(place)) for w in PATTERN.findall(p)] if p not in self.specials else [] for p in pieces]
        ids, lengths = self.words([w.encode() for w in place])
        starts = np.cumsum(lengths) - lengths
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        words = np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))
        ends = np.concatenate([[0], np.cumsum(lengths[words])])
        flat, out = gather(ids, starts[words], lengths[words]), np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        for k in [k for k, p in enumerate(pieces) if p in self.specials]:
            flat = np.insert(flat, int(out[:k].sum()), self.specials[pieces[k]])
            out[k] = 1
        return flat, out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each list of ids."""
        known = (ids >= 0) & (ids < len(self.byte_counts))
        ids = np.where(known, ids, 0)
        counts = np.where(known, self.byte_counts[ids], 0)
        data = gather(self.bytes, self.byte_starts[ids], counts).tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(lengths)])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@cache
def coder(path: str) -> PieceCoder:
    own = merge_table(path)
    return PieceCoder(own.pieces, own.specials)


def list_parts(column: pa.Array) -> Coded:
    """Values and lengths of an array of lists; null lists are empty."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, np.diff(offsets)


def to_lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the ids of its texts in a further column, a list of ints."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = to_lists(*coder(path).texts(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, coded], [*batch.schema.names, ids])

    return df.mapInArrow(run, _added(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of its ids in a further column."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = pa.array(merge_table(path).decode(*list_parts(batch.column(ids))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, text])

    return df.mapInArrow(run, _added(df, text, T.StringType()))
