"""Quality from weak labels: accuracies of heuristics by expectation-maximisation, then a linear scorer.

Each labeller votes good (1), bad (-1) or not at all (0) on a text; most know one defect and have no
opinion without it. How often each is right is not known; EM finds it from how the labellers agree, with
the true quality of each document hidden: given it votes are independent, and each labeller has shares of
its three votes on good and on bad documents, which say how accurate it is. All documents count; as votes are all that EM needs, Spark counts the patterns of votes (``3 ** len(LABELLERS)`` at
most), and the driver iterates over these.

The posterior of its pattern labels a document for the scorer, a logistic model over hashed words and
word shapes, which also judges texts that no labeller votes on. All texts are read once for votes and
features, which are written without the texts; each step of the fit (L-BFGS, ``STEPS`` at most) adds up the gradient over all of
them. Its terms are rounded to multiples of ``2 ** -30`` and added as integers, so that the weights do
not depend on how the documents are dealt into tasks.

Memory: texts are looked at in groups of about ``GROUP_CHARS`` characters, a longer one by itself, with
some forty bytes a character; a task of the fit holds one gradient.

Edge cases: null and empty texts have no words, on which only the length labeller votes, bad. A table without rows
gives a scorer of 0.5 for all. Documents that repeat count each time. Further columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.llm.bpe import list_parts
from quantspan.llm.text import text_session
from quantspan.session import materialize

SLOTS = 1 << 16
#: Of the squared weights; steps of the fit, and what they remember.
PENALTY, STEPS, REMEMBERED = 1e-5, 15, 8
#: Parts of one that gradients are rounded to; slots whose sums travel together.
UNIT, CHUNK = 1 << 30, 1 << 10
GROUP_CHARS = 1 << 20
#: Words whose slots a worker remembers.
KEPT_WORDS = 400_000
#: Shares of the votes bad, none, good on bad and on good documents, to begin with, and their pseudo-votes.
PRIOR = np.array([[0.4, 0.55, 0.05], [0.02, 0.58, 0.4]])
PRIOR_VOTES = 20.0
ROUNDS, ENOUGH = 200, 1e-7
KEEP = 0.5

#: Bits of what a character is.
LETTER, UPPER, DIGIT, ALPHA, ALNUM, SPACE, SYMBOL, END = (1 << k for k in range(8))

c = F.col


@cache
def _kinds() -> np.ndarray:
    """The bits of every code point."""
    chars = list(map(chr, range(0x110000)))
    out = np.zeros(len(chars), np.uint8)
    tests = (str.isupper, UPPER), (str.isdigit, DIGIT), (str.isalpha, ALPHA), (str.isalnum, ALNUM), (str.isspace, SPACE)
    for test, bit in tests:
        out |= np.fromiter(map(test, chars), bool, len(chars)) * np.uint8(bit)
    decimal = np.fromiter(map(str.isdecimal, chars), bool, len(chars))
    out |= ((out & ALNUM > 0) & ~decimal) * np.uint8(LETTER)
    for marks, bit in ((r"#$%&*<>|~^_=\@+{}[]", SYMBOL), (".!?…", END)):
        out[[ord(x) for x in marks]] |= np.uint8(bit)
    return out


class Texts:
    """What the labellers look at, for a group of texts: arrays with a value each."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.words = [t.split() for t in self.texts]
        self.chars = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kinds = _kinds()[self.points]
        self.stops = np.cumsum(self.chars)
        self.n_words = np.fromiter(map(len, self.words), np.int64, len(texts))
        space = self.kinds & SPACE > 0
        edge = np.zeros(len(space) + 1, bool)
        edge[0] = edge[self.stops] = True
        first, last = ~space & (edge[:-1] | np.append(True, space)[:-1]), ~space & (edge[1:] | np.append(space, True)[1:])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.before_gap = edge[1:] | np.append(space, True)[1:]

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many characters of each text have the flag."""
        upto = np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], self.stops])]
        return np.diff(upto)

    def kind(self, bit: int) -> np.ndarray:
        return self.count(self.kinds & bit > 0)

    def in_words(self, bit: int) -> np.ndarray:
        """How many characters of each word have the bit."""
        upto = np.concatenate([[0], np.cumsum(self.kinds & bit > 0)])
        return upto[self.ends] - upto[self.starts]

    def count_words(self, flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], np.cumsum(self.n_words)])]
        return np.diff(upto)


def _bad(found: np.ndarray) -> np.ndarray:
    return np.where(found, -1, 0)


def symbols(t: Texts) -> np.ndarray:
    return _bad(t.kind(SYMBOL) > 0.03 * t.chars)


def capitals(t: Texts) -> np.ndarray:
    letters = t.kind(LETTER)
    return _bad((letters > 0) & (t.kind(UPPER) > 0.35 * letters))


def shouting(t: Texts) -> np.ndarray:
    return _bad(t.count(t.points == ord("!")) > 0.15 * t.n_words)


def repeated_lines(t: Texts) -> np.ndarray:
    def often(text: str) -> bool:
        rows = [x for x in text.split("\n") if x.strip()] if text.count("\n") > 1 else []
        return len(rows) > 2 and len(set(rows)) < 0.7 * len(rows)

    return _bad(np.array([often(x) for x in t.texts], bool))


def bare_marks(t: Texts) -> np.ndarray:
    """Words without a letter or digit, as between the items of a list."""
    return _bad(t.count_words(t.in_words(ALNUM) == 0) > 0.1 * t.n_words)


def sentences(t: Texts) -> np.ndarray:
    """Sentences that end, at lengths usual in prose."""
    ends = t.count((t.kinds & END > 0) & t.before_gap) / np.maximum(t.n_words, 1)
    usual = (ends >= 1 / 60) & (ends <= 1 / 3)
    return np.where(t.n_words < 20, 0, np.where(usual, 1, -1))


def plain(t: Texts) -> np.ndarray:
    """Nearly all words are letters, with a mark behind them at most, and they vary."""
    n, length = t.in_words(ALPHA), t.ends - t.starts
    marked = (n == length - 1) & (length > 1) & (t.kinds[t.ends - 1] & ALPHA == 0)
    words = t.count_words((n == length) | marked)
    return np.where((t.n_words >= 8) & (stutter(t) == 0) & (words > 0.97 * t.n_words), 1, 0)


def digits(t: Texts) -> np.ndarray:
    return _bad(t.kind(DIGIT) > 0.15 * t.chars)


def stutter(t: Texts) -> np.ndarray:
    """Words that are the same as the one before."""
    same = np.array([sum(map(str.__eq__, w, w[1:])) for w in t.words], np.int64)
    return _bad(same > 0.15 * t.n_words)


def word_length(t: Texts) -> np.ndarray:
    mean = (t.chars - t.kind(SPACE)) / np.maximum(t.n_words, 1)
    return _bad((t.n_words > 0) & ((mean < 2.5) | (mean > 14)))


def length(t: Texts) -> np.ndarray:
    return _bad(t.n_words < 8)


LABELLERS = (symbols, capitals, shouting, repeated_lines, bare_marks, sentences, plain, digits, stutter, word_length, length)


def pattern(votes: list):
    """The votes as a number, or as numbers."""
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def vote(t: Texts) -> np.ndarray:
    """The patterns of all labellers' votes."""
    return pattern([f(t) for f in LABELLERS])


@dataclass
class WeakLabels:
    """What EM found: the share of good documents, shares of votes by quality and labeller, posteriors."""

    good: float
    votes: np.ndarray
    posterior: dict[int, float]

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        right = (1 - self.good) * self.votes[0, :, 0] + self.good * self.votes[1, :, 2]
        wrong = (1 - self.good) * self.votes[0, :, 2] + self.good * self.votes[1, :, 0]
        return right / (right + wrong)


def expectation_maximisation(counts: dict[int, int]) -> WeakLabels:
    """``counts`` of documents by pattern of votes."""
    codes = sorted(counts)
    prior = np.repeat(PRIOR[:, None, :], len(LABELLERS), 1)
    good, shares, posterior = 0.5, prior, np.empty(0)
    votes = np.array([votes_of(x) for x in codes]).reshape(-1, len(LABELLERS))
    cast = np.stack([votes == v for v in (-1, 0, 1)], -1).astype(float)
    n = np.array([counts[x] for x in codes], float)
    for _ in range(ROUNDS):
        likelihood = np.einsum("pjv,kjv->kp", cast, np.log(shares))
        odds = np.log(good) - np.log(1 - good) + likelihood[1] - likelihood[0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weight = np.stack([n * (1 - posterior), n * posterior])
        before = shares
        shares = np.einsum("kp,pjv->kjv", weight, cast) + PRIOR_VOTES * prior
        shares /= shares.sum(-1, keepdims=True)
        good = float((weight[1].sum() + 1) / (n.sum() + 2))
        if np.abs(shares - before).max() < ENOUGH:
            break
    return WeakLabels(good, shares, dict(zip(codes, posterior.tolist(), strict=True)))


def _map(df: DataFrame, added: list[T.StructField], columns) -> DataFrame:
    if {f.name for f in added} & set(df.columns):
        raise ValueError(f"there are columns named {[f.name for f in added]} already")
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns(batch.column("text").to_pylist())], schema.names)

    return df.mapInArrow(run, schema)


_SAME, _MARKS = re.compile(r"([Aa0])\1+"), re.compile(r"([^Aa0])\1{3,}")


def _shape(word: str) -> str:
    """Kinds of characters in a row, each kind once; marks stand for themselves, at most three of a kind."""
    body = word if word.isalpha() else word[:-1]
    if body.islower() and body.isalpha():  # as most words: one kind, and a mark or digit at most
        return "a" + word[len(body) :].translate(_shapes)
    return _MARKS.sub(r"\1\1\1", _SAME.sub(r"\1", word.translate(_shapes)))


class _Shapes(dict):
    """From a code point to the letter of its kind."""

    def __missing__(self, point: int) -> str:
        x = chr(point)
        self[point] = kind = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else x
        return kind


_shapes = _Shapes()


def _slot(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % SLOTS


class _ShapeSlots(dict):
    """From a shape to its slot."""

    def __missing__(self, shape: str) -> int:
        slot = _slot("\0" + shape)
        if len(self) < KEPT_WORDS:
            self[shape] = slot
        return slot


class _Slots(dict):
    """From a word to the slots of itself and of its shape, as one number."""

    def __missing__(self, word: str) -> int:
        self[word] = both = _slot(word.lower()) * SLOTS + _shape_slots[_shape(word)]
        return both


_shape_slots, _slots = _ShapeSlots(), _Slots()


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each text's words and their shapes, how often each came, and how many slots each text has."""
    if len(_slots) > KEPT_WORDS:
        _slots.clear()
    both = np.fromiter(map(_slots.__getitem__, chain.from_iterable(t.words)), np.int64, int(t.n_words.sum()))
    row = np.repeat(np.arange(len(t.words)), t.n_words) * SLOTS
    keys, counts = np.unique(np.concatenate([row + both // SLOTS, row + both % SLOTS]), return_counts=True)
    return keys % SLOTS, counts, np.bincount(keys // SLOTS, minlength=len(t.words))


def _values(counts: np.ndarray, lengths: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's words, one half each from words and shapes."""
    return np.sqrt(counts / np.repeat(2 * np.maximum(n_words, 1), lengths))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500.0, 500.0)))


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``GROUP_CHARS`` characters."""
    first = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= GROUP_CHARS:
            yield texts[first : k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield texts[first:]


def described(docs: DataFrame) -> DataFrame:
    """``votes, n_words, slots, counts`` of all texts; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _groups(batch.column("text").to_pylist()):
                t = Texts(texts)
                slots, counts, lengths = features(t)
                at = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (slots, counts)]
                own = [pa.array(vote(t).astype(np.int32)), pa.array(t.n_words.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *lists], ["votes", "n_words", "slots", "counts"])

    return materialize(docs.select(c("text").cast("string").alias("text")).mapInArrow(run, "votes int, n_words int, slots array<int>, counts array<int>"), "described")


def weak_labels(known: DataFrame) -> WeakLabels:
    """EM over all of the votes."""
    return expectation_maximisation({r["votes"]: r["count"] for r in known.groupBy("votes").count().collect()})


def _loss_and_gradient(known: DataFrame, labels: WeakLabels, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over all texts, of slots and, last, of the constant."""
    posterior, shared = labels.posterior, known.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, loss = shared.value, np.zeros(SLOTS + CHUNK, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            (slots, lengths), (counts, _) = list_parts(batch.column("slots")), list_parts(batch.column("counts"))
            values = _values(counts, lengths, batch.column("n_words").to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            z = np.bincount(row, w[slots] * values, minlength=len(lengths)) + w[SLOTS]
            y = np.fromiter(map(posterior.__getitem__, batch.column("votes").to_pylist()), float, len(lengths))
            error = _probability(z) - y
            total[:SLOTS] += np.bincount(slots, np.rint(values * error[row] * UNIT), minlength=SLOTS).astype(np.int64)
            total[SLOTS] += int(np.rint(error * UNIT).sum())
            loss += int(np.rint((np.logaddexp(0, z) - y * z) * (1 << 20)).sum())
        at = np.arange(0, len(total) + 1, CHUNK)
        sums = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(at[:-1]), sums, pa.array(np.where(at[:-1] == 0, loss, 0))], ["at", "sums", "loss"])

    def add(group: pa.Table) -> pa.Table:
        flat = group["sums"].combine_chunks().values.to_numpy().reshape(-1, CHUNK).sum(axis=0)
        loss = int(group["loss"].to_numpy().sum())
        return pa.table({"at": group["at"][:1], "sums": pa.array([flat], pa.list_(pa.int64())), "loss": pa.array([loss], pa.int64())})

    schema = "at long, sums array<long>, loss long"
    rows = known.mapInArrow(run, schema).groupBy("at").applyInArrow(add, schema).toArrow().sort_by("at")
    shared.destroy()
    if not rows.num_rows:
        return 0.0, np.zeros(SLOTS + 1)
    return sum(rows["loss"].to_pylist()) / (1 << 20), np.concatenate(rows["sums"].to_pylist())[: SLOTS + 1] / UNIT


def minimise(function: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int) -> np.ndarray:
    """L-BFGS from zero; a step that does not lower the value enough is halved."""
    at = np.zeros(size)
    value, slope = function(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, kept = slope.copy(), []
        for s, y in reversed(steps):
            kept.append((s @ way) / (s @ y))
            way -= kept[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 4.0
        for (s, y), k in zip(steps, reversed(kept), strict=True):
            way += (k - (y @ way) / (s @ y)) * s
        rate, gain = 1.0, slope @ way
        if gain <= 1e-10:
            break
        for _ in range(8):
            after, after_slope = function(at - rate * way)
            if after <= value - 1e-4 * rate * gain:
                break
            rate /= 2
        else:
            break
        step, turn = -rate * way, after_slope - slope
        if step @ turn > 1e-12:
            steps = [*steps, (step, turn)][-REMEMBERED:]
        at, value, slope = at + step, after, after_slope
    return at


def train(known: DataFrame, labels: WeakLabels) -> np.ndarray:
    """Weights of the slots and, last, of the constant."""
    n = known.count()
    if not n:
        return np.zeros(SLOTS + 1)

    def function(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _loss_and_gradient(known, labels, weights)
        return loss / n + PENALTY / 2 * (weights @ weights), gradient / n + PENALTY * weights

    return minimise(function, SLOTS + 1)


def add_quality(docs: DataFrame, labels: WeakLabels, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``weak_label`` (the posterior of its votes) and ``quality`` (the scorer's), both 0 to 1."""
    posterior, good, shared = labels.posterior, labels.good, docs.sparkSession.sparkContext.broadcast(weights)

    def columns(texts: list[str | None]) -> list[pa.Array]:
        w, labels_, scores = shared.value, [], []
        for group in _groups(texts):
            t = Texts(group)
            slots, counts, lengths = features(t)
            row = np.repeat(np.arange(len(lengths)), lengths)
            z = np.bincount(row, w[slots] * _values(counts, lengths, t.n_words), minlength=len(lengths)) + w[SLOTS]
            scores += _probability(z).tolist()
            labels_ += [posterior.get(x, good) for x in vote(t).tolist()]
        return [pa.array(labels_, pa.float64()), pa.array(scores, pa.float64())]

    return _map(docs, [T.StructField("weak_label", T.DoubleType()), T.StructField("quality", T.DoubleType())], columns)


def score_quality(docs: DataFrame) -> DataFrame:
    """Weak labels of all ``docs``, a scorer of them, and both on each document."""
    text_session(docs.sparkSession)
    known = described(docs)
    labels = weak_labels(known)
    return add_quality(docs, labels, train(known, labels))
