"""Spelling variants: words one edit apart, found by one-edit neighbourhoods over a reduced alphabet.

A hash takes each letter to one of ``SYMBOLS`` symbols. Words one edit apart have reduced words that
are equal or one edit apart. So of each word's reduced word every string within one edit is generated:
itself, a symbol deleted, replaced or inserted, ``2 * SYMBOLS`` a letter whatever alphabet the words use.
They are joined with the reduced words of the vocabulary, and what joins is verified on the words themselves.

Strings of symbols are compared by 64-bit polynomial hashes, which numpy finds for a batch of words of
one length at once from sums of their beginnings. Equal hashes of different strings cost a comparison, not a result. Each
string comes once: a symbol is deleted only at the start of a run of it, and inserted only before a run.

Most strings of a neighbourhood are no word's. So a bitmap of ``FILTER_BITS`` bits, which the hashes of all
reduced words set, goes to every worker and lets pass what may be one; that is all the filter does, and the
join after it is exact, however full the bitmap is.

Words are extracted, counted, joined and verified by DataFrame functions. Neighbourhoods carry the
number of their word only, and those of a long word come in pieces of ``PIECE`` places. The join has no
limit; a reduced word that many words share is a key that Spark splits (adaptive skew joins).

Edge cases: null and empty texts have no words; a null ``doc_id`` counts as the empty text where it is
hashed; repeated rows count each time; a table without words gives no rows. Of near words of equal count
the smallest in code-point order is the form. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.llm.text import mix, text_session
from quantspan.session import materialize

SYMBOLS = 8
#: Places of a word whose neighbours are generated at a time, and rows of one Arrow batch about.
PIECE, ROWS = 1 << 14, 1 << 18
#: Bits of the bitmap of reduced words, and of a piece of it.
FILTER_BITS, PIECE_BITS = 1 << 27, 1 << 15
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 7, 2, 10
LETTERS = r"[A-Za-zÀ-ÿ]"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

c = F.col


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelled(word: Column, doc_id: Column, one_in: int) -> Column:
    """``word`` without one of its letters, in one of ``one_in`` documents, chosen by a checksum of both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % one_in == 0, shorter).otherwise(word)


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int | None = None) -> DataFrame:
    """``word, n`` of lower-cased runs of letters in ``docs`` (``doc_id, text``), of at least so many letters and occurrences.

    With ``one_in`` an occurrence loses a letter as ``misspelled`` says.
    """
    # shorter runs give no words, so that only runs of the letters wanted are extracted
    runs = F.regexp_extract_all(c("text").cast("string"), F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lower_ascii(c("run")).alias("run"))
    word = misspelled(c("run"), c("doc_id"), one_in) if one_in else c("run")
    words = each.select(word.alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= least_count)


def reduced(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point, from 1 on."""
    return mix(points.astype(np.uint64) + np.uint64(1)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))


def own_codes(symbols: np.ndarray) -> np.ndarray:
    """Hashes of reduced words of one length, a row each."""
    return mix((symbols * _powers(symbols.shape[1] - 1)).sum(axis=1, dtype=np.uint64))


def neighbour_codes(symbols: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of strings one edit from reduced words of one length, for edits at ``first <= place < last``.

    At place ``n`` (the length) there is only inserting.
    """
    rows, n = symbols.shape
    powers = _powers(n)
    upto = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(symbols * powers[:n], axis=1, dtype=np.uint64)], axis=1)
    whole = upto[:, -1:]
    inside = slice(first, min(last, n))
    here = symbols[:, inside]
    before = np.concatenate([np.zeros((rows, 1), np.uint64), symbols], axis=1)[:, first:last]
    number = np.arange(rows)[:, None]

    def chosen(where: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.broadcast_to(number, where.shape)[where], mix(codes[where])

    rest = whole - upto[:, inside.start + 1 : inside.stop + 1]
    yield chosen(before[:, : here.shape[1]] != here, upto[:, inside] + rest * _INVERSE)
    for symbol in np.arange(1, SYMBOLS + 1, dtype=np.uint64):
        yield chosen(here != symbol, whole + (symbol - here) * powers[inside])
        inserted = upto[:, first:last] + symbol * powers[first:last] + (whole - upto[:, first:last]) * _BASE
        yield chosen(before != symbol, inserted)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and symbols of a batch's words, those of one length together, in blocks of bounded size."""
    words = batch.column("word").to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = batch.column("id").to_numpy()
    for n in np.unique(lengths).tolist():
        some = np.flatnonzero(lengths == n)
        for k in range(0, len(some), max(1, ROWS // n)):
            block = some[k : k + max(1, ROWS // n)]
            data = "".join(words[x] for x in block).encode("utf-32-le", "surrogatepass")
            yield ids[block], reduced(np.frombuffer(data, np.uint32)).reshape(len(block), n)


def _codes(ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(codes.view(np.int64))], ["id", "code"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, symbols in _by_length(batch):
            yield _codes(ids, own_codes(symbols))


def code_bitmap(own: DataFrame) -> np.ndarray:
    """Bytes of the bitmap in which the bits that the codes lead to are set."""
    at = F.pmod("code", F.lit(FILTER_BITS))
    pieces = own.groupBy((at / PIECE_BITS).cast("long").alias("piece")).agg(F.bitmap_construct_agg(at % PIECE_BITS).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in pieces:
        first = row["piece"] * PIECE_BITS // 8
        out[first : first + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """``id, other`` of words that differ by one edit, both ways. ``words``: ``id, word``, distinct words."""
    spark = text_session(words.sparkSession)
    schema = "id long, code long"
    own = materialize(words.select("id", "word").mapInArrow(_own, schema), "reduced").select(c("id").alias("other"), "code")
    bitmap = spark.sparkContext.broadcast(code_bitmap(own))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value

        def known(ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            at = codes % np.uint64(8 * len(bits))
            kept = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return _codes(ids[kept], codes[kept])

        for batch in batches:
            for ids, symbols in _by_length(batch):
                yield _codes(ids, own_codes(symbols))
                for first in range(0, symbols.shape[1] + 1, PIECE):
                    edits = neighbour_codes(symbols, first, min(first + PIECE, symbols.shape[1] + 1))
                    rows, codes = (np.concatenate(x) for x in zip(*edits, strict=True))
                    yield known(ids[rows], codes)

    met = words.select("id", "word").mapInArrow(near, schema).join(own, "code").where("id <> other").select("id", "other")
    spelled = {k: words.select(c("id").alias(k), c("word").alias(f"{k}_word")) for k in ("id", "other")}
    both = met.join(spelled["id"], "id").join(spelled["other"], "other")
    return both.where(F.levenshtein("id_word", "other_word", 1) == 1).select("id", "other")


def group_variants(counted: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words and their counts (``word, n``).

    A word's form is its most frequent near word, if that is ``times`` as frequent as the word (2 at least); its root is
    where forms lead to. Each step of that multiplies the count, so that there are only a few.
    """
    if times < 2:
        raise ValueError("times must be 2 at least")
    words = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    others = words.select(c("id").alias("other"), c("word").alias("other_word"), c("n").alias("other_n"))
    best = F.min(F.struct((-c("other_n")).alias("less"), c("other_word").alias("word"))).alias("best")
    near = near_words(words).join(others, "other").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best)
    most = -c("best.less")
    has_form = most >= times * c("n")
    found = words.join(near, "id", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, c("best.word")).alias("form"),
        F.when(has_form, most).alias("form_n"),
    )
    found = materialize(found, "variants")
    steps = found.where("form is not null").select("word", "form")
    roots = steps.withColumnRenamed("form", "root")
    while True:
        onward = roots.join(steps.select(c("word").alias("root"), c("form").alias("next")), "root", "left")
        roots = materialize(onward.select("word", F.coalesce("next", "root").alias("root"), c("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
