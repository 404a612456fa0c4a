"""Language by rank order: a document's most frequent n-grams against a profile of each language.

Texts are lower-cased letters, words apart by one blank; an n-gram has 1 to ``LONGEST`` characters, with
blanks at its ends only. A language's profile is its ``PROFILE`` most frequent n-grams in order, counted
over all documents that name it. A document has such an order too; each of its n-grams is out of place by
the difference of its two ranks, or by ``PROFILE`` where the profile lacks it. The language with the
smallest sum is predicted (the first by name of equal ones); the score is 1 less the sum's share of the
largest one possible.

Counts are summed up within tasks over all texts before the shuffle. What the driver gets is the
profiles: ``PROFILE`` rows per language.

Edge cases: null texts and texts without a letter are ``und`` with a score of 0; null languages teach
nothing; without any language all documents are ``und``; documents that repeat count each time; ties of
counts are broken by the n-gram. Further columns are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.llm.text import crc_bucket, text_session

LONGEST = 3
PROFILE = 400
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Characters whose n-grams are counted at a time.
CHUNK = 1 << 20
#: Distinct n-grams a task sums up before it hands on what it has.
FLUSH = 500_000

c = F.col

_BLANK = ord(" ")
#: From a code point to its lower-case letter, or to a blank. Filled as characters come up.
_letters: dict[int, int] = {}


def _letter(code: int) -> int:
    low = chr(code).lower()
    return ord(low) if len(low) == 1 and unicodedata.category(low)[0] == "L" else code if unicodedata.category(chr(code))[0] == "L" else _BLANK


def _codes(text: str) -> np.ndarray:
    """Letters as code points, words apart by one blank, a blank at both ends; one blank if there is none."""
    raw = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, place = np.unique(raw, return_inverse=True) if len(raw) < 256 else _kinds(raw)
    mapped = np.array([_letters[k] if k in _letters else _letters.setdefault(k, _letter(k)) for k in kinds.tolist()], np.uint64)
    codes = mapped[place]
    blank = codes == _BLANK
    return codes[~blank | np.concatenate([[True], ~blank[:-1]])]


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the place of each, by a table over the range of values."""
    present = np.flatnonzero(np.bincount(raw))
    table = np.zeros(int(present[-1]) + 1, np.int64)
    table[present] = np.arange(len(present))
    return present, table[raw]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, 21 bits for each character."""
    codes = _codes(text)
    if len(codes) < 2:
        return np.empty(0, np.uint64)
    blank = codes == _BLANK
    out, packed = [codes[~blank]], codes
    for n in range(2, LONGEST + 1):
        packed = (packed[:-1] << np.uint64(21)) | codes[n - 1 :]
        inner = np.zeros(len(packed), bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + len(packed)]
        out.append(packed[~inner])
    return np.concatenate(out)


def gram_text(gram: int) -> str:
    """The characters of an n-gram."""
    out = ""
    while gram:
        out, gram = chr(gram & (1 << 21) - 1) + out, gram >> 21
    return out


@dataclass
class Profiles:
    """Languages by name; n-grams in order, and for each of them and each language its rank."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def _summed(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[starts], np.add.reduceat(weights, starts) if len(values) else weights


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts of ``docs`` (``text``, ``lang``)."""

    def row(lang: str, counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        values, n = counted
        langs = pa.array([lang]).take(pa.array(np.zeros(len(values), np.int64)))
        return pa.RecordBatch.from_arrays([langs, pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(grams(text))
            for lang, own in texts.items():
                values, n = _summed(np.concatenate(own))
                if lang in sums:
                    values, n = _summed(np.concatenate([sums[lang][0], values]), np.concatenate([sums[lang][1], n]))
                sums[lang] = values, n
            if sum(len(v) for v, _ in sums.values()) > FLUSH:
                yield from (row(lang, own) for lang, own in sums.items())
                sums = {}
        yield from (row(lang, own) for lang, own in sums.items())

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Profiles:
    """Profiles of the languages that ``docs`` (``text``, ``lang``) name."""
    text_session(docs.sparkSession)
    ranked = gram_counts(docs).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    rows = ranked.where(c("rank") <= PROFILE).select("lang", "gram", "rank").toPandas()
    languages = sorted(rows["lang"].unique())
    all_grams = np.unique(rows["gram"].to_numpy(np.uint64))
    ranks = np.full((len(all_grams), len(languages)), -1, np.int64)
    ranks[np.searchsorted(all_grams, rows["gram"].to_numpy(np.uint64)), np.searchsorted(languages, rows["lang"])] = rows["rank"] - 1
    return Profiles(languages, all_grams, ranks)


def distances(text: str, profiles: Profiles) -> np.ndarray | None:
    """How far out of place the n-grams of ``text`` are in each language, as a share of the most possible."""
    values, n = _summed(grams(text))
    if not len(values):
        return None
    top = values[np.lexsort((values, -n))[:PROFILE]]
    at = np.minimum(np.searchsorted(profiles.grams, top), len(profiles.grams) - 1)
    known = np.where((profiles.grams[at] == top)[:, None], profiles.ranks[at], -1)
    places = np.abs(known - np.arange(len(top))[:, None])
    return np.where(known < 0, PROFILE, places).sum(0) / (PROFILE * len(top))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    names = [*docs.columns, "lang_pred", "score"]
    if len(set(names)) < len(names):
        raise ValueError("there is a column lang_pred or score already")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                far = distances(text, profiles) if text and profiles.languages else None
                best = None if far is None else int(far.argmin())
                found.append((UNKNOWN, 0.0) if best is None else (profiles.languages[best], 1 - float(far[best])))
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return docs.mapInArrow(run, schema)


def training(docs: DataFrame) -> DataFrame:
    """The documents that are not held out."""
    return docs.where(crc_bucket(c("doc_id"), FOLDS) != HELD_OUT)
