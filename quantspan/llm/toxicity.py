"""Toxicity: class-conditional Kneser-Ney models over the letters of words.

Each word, between marks of its beginning and end, is a sequence of letters; a gram is a letter with
up to ``ORDER - 1`` letters before it. Counts of grams in toxic and in ordinary labelled documents give
two models with absolute discounting. Both back off to one shared Kneser-Ney model, whose shorter grams
count the distinct letters seen before them in either class. Letters are compared where both classes
have seen what stands before them: a rare expression is judged by where it leaves what both know, once
and not at each of its letters.

A word's log-likelihood ratio is the sum over its letters. Of these a document has length-normalised
means (of all, of positive ones, of what exceeds ``CLEAR``), the largest one and the sum of excesses,
since a few words among many make a long document toxic; a logistic calibration turns them into a score.

Counts cover every training document: those with a label whose ``crc32`` of the id modulo 4 is 0 or 1.
Those with remainder 3 calibrate (at most ``CALIBRATION_ROWS``, taken by the hash of their id); those
with remainder 2 are never looked at.

Ratios stay in a table by context, of any size. The distinct words of the documents are spelled out and
joined with it letter by letter, which gives each word its exact ratio. Contexts and words of which each
is a ``HOT_CONTEXTS``th or ``HOT_SHARE``th of all are broadcast and looked up; all others are joined. Before that join
letters go whose context is not in the table, most of them by a bitmap of hashes of its contexts. A text's
features belong to its hash, so that rows meet them again without their text being grouped.

Edge cases: a null or empty text, or one without letters, has ratios of 0; labels other than 0 and 1
and null labels count as none; a document that repeats, or has several labels, counts for each of
them; where one class has no labels among those that calibrate, but both have among those counted, the score goes
by the sign and size of the mean ratio; with no labelled document of one class among these every score is the share of toxic ones
among the labels (0 without labels). Further columns are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quantspan.llm.text import LETTERS, crc_bucket, text_session
from quantspan.llm.variants import FILTER_BITS, PIECE_BITS, code_bitmap
from quantspan.session import materialize as written

ORDER = 8
#: Of the class models and of the shared one.
DISCOUNT, SHARED_DISCOUNT = 0.9, 0.75
#: A word whose ratio exceeds this speaks for a class by itself.
CLEAR = 2.0
#: Words that make up one in so many of all words are broadcast, at most so many words therefore.
HOT_SHARE = 1_000_000
#: As ``HOT_SHARE``, of contexts among those of all counted letters.
HOT_CONTEXTS = 100_000
#: A longer word goes by its SHA-256.
KEY_LETTERS = 64
#: Rows of spelled words that are handed on at a time.
SPELLED_ROWS = 50_000
CALIBRATION_ROWS = 20_000
#: Share of folds; the remainder of the crc32 of the id says what a document is for.
FOLDS, COUNTED, CALIBRATING, HELD_OUT = 4, (0, 1), 3, 2
THRESHOLD = 0.3
#: Distinct words a task counts before it hands on what it has.
FLUSH_WORDS = 300_000

c = F.col


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written, as words and grams take up much less room with this codec."""
    return written(df, name, "zstd")


def labelled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], columns: Sequence[str] = ("text",)) -> DataFrame:
    """``doc_id``, the columns and ``toxic`` of the labelled documents of these folds.

    Texts are long, so documents that no label can be of are left out before they are joined.
    """
    rows = docs.withColumn("text", c("text").cast("string")).select("doc_id", *columns).where(crc_bucket(c("doc_id"), FOLDS).isin(*folds))
    known = labels.where("toxic in (0, 1)").where(crc_bucket(c("doc_id"), FOLDS).isin(*folds)).select("doc_id", c("toxic").cast("int"))
    rows = _maybe_in(rows, known) if "text" in columns else rows
    return rows.join(known, "doc_id").select("doc_id", *columns, "toxic")


def _maybe_in(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is not among the known ones, by a bitmap of hashes."""
    at = F.pmod(F.xxhash64(c("doc_id").cast("string")), F.lit(FILTER_BITS))
    piece, bit = (at / PIECE_BITS).cast("long"), at % PIECE_BITS
    pieces = known.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    found = rows.withColumns({"_piece": piece, "_bit": bit}).join(F.broadcast(pieces), "_piece")
    byte = F.conv(F.hex(F.substring("_bits", (c("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (c("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def word_counts(rows: DataFrame) -> DataFrame:
    """Each word with its counts in toxic and in ordinary texts. Tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for word in LETTERS.findall((text or "").lower()):
                    counts.setdefault(word, [0, 0])[toxic] += 1
            if len(counts) > FLUSH_WORDS:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    counted = rows.mapInArrow(run, "word string, ordinary long, toxic long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    ordinary, toxic = zip(*counts.values(), strict=True) if counts else ((), ())
    columns = [pa.array(list(counts), pa.string()), pa.array(ordinary, pa.int64()), pa.array(toxic, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "ordinary", "toxic"])


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, toxic, ordinary``: each letter of each word, behind the letters before it."""
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"), "toxic", "ordinary")
    first = F.greatest(F.lit(1), c("i") - (ORDER - 1))
    return (
        marked.select("w", "toxic", "ordinary", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("i"))
        .select(c("w").substr(first, c("i") - first + 1).alias("gram"), "toxic", "ordinary")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )


def _context(gram="gram"):
    return F.substring(gram, F.lit(1), F.length(gram) - 1)


def shared_backoff(grams: DataFrame) -> DataFrame:
    """``suffix, p``: Kneser-Ney probability of the last letter of each gram without its first letter."""
    levels: dict[int, DataFrame] = {}
    for n in range(ORDER - 1, 0, -1):
        longer = grams.where(F.length("gram") == n + 1).select("gram")
        if n + 1 in levels:
            longer = longer.union(levels[n + 1].select("gram"))
        # written: each level below and each model above would count it anew, with all the longer ones
        levels[n] = materialize(longer.groupBy(F.substring("gram", F.lit(2), F.lit(n)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "level")
    out, shorter = None, None
    for n in range(1, ORDER):
        own = W.partitionBy("context")
        level = levels[n].withColumn("context", _context()).withColumns(
            {"total": F.sum("n").over(own), "kinds": F.count("n").over(own)}
        )
        if shorter is None:
            level = level.withColumn("below", 1 / c("kinds"))
        else:
            level = level.withColumn("suffix", F.substring("gram", F.lit(2), F.lit(n - 1))).join(
                shorter.select(c("gram").alias("suffix"), c("p").alias("below")), "suffix"
            )
        p = (c("n") - SHARED_DISCOUNT) / c("total") + SHARED_DISCOUNT * c("kinds") / c("total") * c("below")
        shorter = materialize(level.select("gram", p.alias("p")), "backoff")
        out = shorter if out is None else out.union(shorter)
    return out.select(c("gram").alias("suffix"), "p")


def context_ratios(grams: DataFrame) -> DataFrame:
    """``context, seen, unseen, n``: log-likelihood ratios behind contexts that both classes have seen, of letters and of letters new there."""
    contexts = grams.groupBy(_context().alias("context")).agg(
        *[F.sum(k).alias(f"{k}_total") for k in ("toxic", "ordinary")],
        *[F.count_if(c(k) > 0).alias(f"{k}_kinds") for k in ("toxic", "ordinary")],
    )
    contexts = contexts.where("toxic_total > 0 and ordinary_total > 0").withColumns(
        {f"{k}_left": DISCOUNT * c(f"{k}_kinds") / c(f"{k}_total") for k in ("toxic", "ordinary")}
    )
    below = shared_backoff(grams)
    full = grams.withColumns({"context": _context(), "suffix": F.expr("substring(gram, 2)")}).join(contexts, "context").join(below, "suffix")

    def probability(k: str):
        return F.greatest(c(k) - DISCOUNT, F.lit(0.0)) / c(f"{k}_total") + c(f"{k}_left") * c("p")

    letter = F.struct(F.substring("gram", -1, 1), F.ln(probability("toxic") / probability("ordinary")))
    # as many letters as there are kinds of them behind a context
    return full.groupBy("context").agg(
        F.map_from_entries(F.collect_list(letter)).alias("seen"), F.first(F.ln(c("toxic_left") / c("ordinary_left"))).alias("unseen"), F.first(c("toxic_total") + c("ordinary_total")).alias("n")
    )


def vocabulary(df: DataFrame) -> DataFrame:
    """``word, n``: how often each word occurs in the texts. Tasks sum up before the shuffle."""

    def counted(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(LETTERS.findall((text or "").lower()))
            if len(counts) > FLUSH_WORDS:
                yield counted(counts)
                counts = Counter()
        yield counted(counts)

    return df.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key(word: str) -> str:
    return word if len(word) <= KEY_LETTERS else "#" + hashlib.sha256(word.encode()).hexdigest()


def _broadcast_contexts(contexts: DataFrame):
    """The frequent contexts: to the ratios of letters seen there, under "" that of new ones."""
    total = contexts.agg(F.sum("n")).first()[0] or 0
    most = contexts.where(c("n") * HOT_CONTEXTS >= total).select("context", "seen", "unseen").toArrow()
    columns = [most[x].to_pylist() for x in most.column_names]
    return contexts.sparkSession.sparkContext.broadcast({x: {**dict(seen), "": unseen} for x, seen, unseen in zip(*columns, strict=True)})


def _grams(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    return (marked[max(0, i - ORDER) : i] for i in range(2, len(marked) + 1))


def _bitmap(contexts: DataFrame):
    """Bits that Spark's hashes of the contexts lead to: a context whose bit is not set is not in the table."""
    return contexts.sparkSession.sparkContext.broadcast(code_bitmap(contexts.select(F.xxhash64("context").alias("code"))))


def spelled(words: DataFrame, hot, bitmap) -> tuple[DataFrame, DataFrame]:
    """``id, word, n, base``, whose base is the ratio of the letters behind frequent contexts, and ``id, gram`` of the others.

    The latter are without most grams whose context is in no table.
    """

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            base = []
            for word in batch.column("word").to_pylist():
                total = 0.0
                for gram in _grams(word):
                    if own := known.get(gram[:-1]):
                        total += own.get(gram[-1], own[""])
                base.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, pa.float64())], ["word", "n", "base"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = hot.value, bitmap.value.tobytes()
        mask = 8 * len(bits) - 1
        ids: list[int] = []
        grams: list[str] = []
        for batch in batches:
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                for gram in _grams(word):
                    if (context := gram[:-1]) not in known:
                        at = xxhash.xxh64_intdigest(context.encode(), 42) & mask
                        if not bits[at >> 3] >> (at & 7) & 1:
                            continue
                        ids.append(i)
                        grams.append(gram)
                        if len(ids) >= SPELLED_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], ["id", "gram"])
                            ids, grams = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], ["id", "gram"])

    # written, so that the ids stay
    own = words.select("word", "n").mapInArrow(bases, "word string, n long, base double").withColumn("id", F.monotonically_increasing_id())
    own = materialize(own, "words")
    return own, own.select("id", "word").mapInArrow(others, "id long, gram string")


def word_ratios(words: DataFrame, contexts: DataFrame) -> DataFrame:
    """``key, n, ratio`` of each word: the sum over its letters of what their contexts say, where they are known."""
    own, rest = spelled(words, _broadcast_contexts(contexts), _bitmap(contexts))
    # a context and its letter are one string until they have met: these are the most rows of all
    rest = rest.join(contexts.withColumnRenamed("context", "_context").drop("n"), _context() == c("_context"))
    letter = F.substring("gram", -1, 1)
    ratios = rest.groupBy("id").agg(F.sum(F.coalesce(F.try_element_at("seen", letter), c("unseen"))).alias("rest"))
    digest = F.concat(F.lit("#"), F.sha2("word", 256))
    key = F.when(F.length("word") <= KEY_LETTERS, c("word")).otherwise(digest)
    return own.join(ratios, "id", "left").select(key.alias("key"), "n", (c("base") + F.coalesce("rest", F.lit(0.0))).alias("ratio"))


#: Means of the ratios, of what exceeds ``CLEAR`` and of the positive ones; the largest; log of the sum of excesses.
FEATURES = ("ratio_mean", "ratio_clear", "ratio_positive", "ratio_top", "ratio_sum")

#: What stands for a text: 96 bits of hashes.
TEXT_KEYS = {"_text_hash": F.xxhash64, "_text_check": F.hash}


@dataclass
class Model:
    #: As of ``context_ratios``.
    contexts: DataFrame
    #: The documents the model was made from, and the features of their texts.
    docs: DataFrame
    known: DataFrame
    #: Of 1 and the features.
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(FEATURES)))
    #: The score of every document where one class has no labelled document.
    constant: float | None = None


def _text_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({k: f(c("text").cast("string")) for k, f in TEXT_KEYS.items()})


def _looked_up(rows: DataFrame, hot) -> DataFrame:
    """For each row whose text has words: sums over the hot ones, and the others with their counts."""
    sums = ["n", "total", "clear", "positive", "top"]
    schema = "_text_hash long, _text_check int, n long, total double, clear double, positive double, top double, rare array<string>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = hot.value.get
        for batch in batches:
            at, out, rare, times = [], {x: [] for x in sums}, [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = LETTERS.findall(text.lower()) if text else []
                if not words:
                    continue
                own = np.fromiter(map(get, words, repeat(np.nan)), float, len(words))
                new = np.isnan(own)
                others = Counter([_key(words[i]) for i in np.flatnonzero(new).tolist()])
                own = own[~new]
                long = {x: m for x, m in others.items() if x[0] == "#" and x in hot.value}
                if long:
                    own = np.concatenate([own, np.repeat([get(x) for x in long], list(long.values()))])
                    others = {x: m for x, m in others.items() if x not in long}
                at.append(k)
                values = len(words), own.sum(), np.maximum(own - CLEAR, 0).sum(), np.maximum(own, 0).sum(), own.max() if len(own) else None
                for x, v in zip(sums, values, strict=True):
                    out[x].append(v)
                rare.append(list(others))
                times.append(list(others.values()))
            keys = [batch.column(x).take(pa.array(at, pa.int64())) for x in TEXT_KEYS]
            columns = [pa.array(out[x], pa.int64() if x == "n" else pa.float64()) for x in sums]
            lists = [pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*keys, *columns, *lists], [*TEXT_KEYS, *sums, "rare", "times"])

    return _text_keys(rows.select(c("text").cast("string").alias("text"))).mapInArrow(run, schema)


def text_features(df: DataFrame, contexts: DataFrame) -> DataFrame:
    """``FEATURES`` by ``TEXT_KEYS`` of the texts that have words."""
    spark = text_session(df.sparkSession)
    ratios = materialize(word_ratios(vocabulary(df), contexts), "word-ratios")
    n_words = ratios.agg(F.sum("n")).first()[0] or 0
    is_hot = c("n") * HOT_SHARE >= n_words
    most = ratios.where(is_hot).select("key", "ratio").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(most["key"].to_pylist(), most["ratio"].to_pylist(), strict=True)))
    # a row goes by a number, which is shorter than its text's hashes where each of its words has it
    found = materialize(_looked_up(df, hot).withColumn("_row", F.monotonically_increasing_id()), "looked-up")
    each = found.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("_row", c("w.rare").alias("key"), c("w.times").alias("m"))
    each = each.join(ratios.where(~is_hot).select("key", "ratio"), "key")
    parts = {"total": c("ratio"), "clear": F.greatest(c("ratio") - CLEAR, F.lit(0.0)), "positive": F.greatest(c("ratio"), F.lit(0.0))}
    rest = each.groupBy("_row").agg(*[F.sum(c("m") * x).alias(f"_{k}") for k, x in parts.items()], F.max("ratio").alias("_top"))
    whole = found.drop("rare", "times").join(rest, "_row", "left")
    whole = whole.withColumns({k: c(k) + F.coalesce(f"_{k}", F.lit(0.0)) for k in parts}).withColumn("top", F.greatest("top", "_top"))
    means = [c("total") / c("n"), c("clear") / c("n"), c("positive") / c("n"), c("top"), F.log1p("clear")]
    # rows of one text differ by the order of their sums at most
    whole = whole.groupBy(*TEXT_KEYS).agg(*[F.max(m).alias(x) for m, x in zip(means, FEATURES, strict=True)])
    # written before it is joined: only then can a common text be split among tasks
    return materialize(whole, "features")


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of the constant and the columns by Newton steps, the latter with a penalty at unit scale."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    ridge, w = np.diag([1e-6] + [penalty] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return np.concatenate([[w[0] - slopes @ centre], slopes])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Count, take ratios, calibrate."""
    text_session(docs.sparkSession)
    words = word_counts(labelled(docs, labels, COUNTED))
    grams = materialize(gram_counts(words), "grams")
    contexts = materialize(context_ratios(grams), "contexts")
    model = Model(contexts, docs, text_features(docs, contexts))
    some = _joined(labelled(_text_keys(docs), labels, (CALIBRATING,), list(TEXT_KEYS)), model.known, ["doc_id", "toxic"])
    rows = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        model.weights = _logistic(x, y)
        return model
    counted = words.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if all(counted):
        model.weights[:2] = math.log(THRESHOLD / (1 - THRESHOLD)), 1.0
    else:
        share = labelled(docs, labels, (*COUNTED, CALIBRATING)).agg(F.avg("toxic")).first()[0]
        model.constant = float(share or 0.0)
    return model


def add_features(df: DataFrame, model: Model, known: DataFrame | None = None) -> DataFrame:
    """``df`` with the columns ``FEATURES``; ``known`` has those of its texts, if it is given."""
    if taken := {*FEATURES, *TEXT_KEYS} & set(df.columns):
        raise ValueError(f"there are columns named {sorted(taken)} already")
    if known is None:
        known = model.known if df is model.docs else text_features(df, model.contexts)
    return _joined(_text_keys(df), known, df.columns)


def _joined(rows: DataFrame, known: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of the rows, which have ``TEXT_KEYS``, and the features of their texts."""
    return rows.join(known, list(TEXT_KEYS), "left").select(*columns, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in FEATURES])


def score(model: Model) -> Column:
    """From 0 to 1, of the columns ``FEATURES``."""
    if model.constant is not None:
        return F.lit(model.constant)
    z = F.lit(float(model.weights[0]))
    for x, w in zip(FEATURES, model.weights[1:], strict=True):
        z = z + c(x) * float(w)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def add_scores(df: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``df`` with a column ``name``: from 0 to 1, higher the likelier toxic."""
    if name in df.columns:
        raise ValueError(f"there is a column named {name} already")
    if model.constant is not None:
        return df.withColumn(name, score(model))
    return add_features(df, model).withColumn(name, score(model)).drop(*FEATURES)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score is below ``threshold``, by a model of their own labelled documents."""
    scored = add_scores(docs, fit(docs, labels), "_toxicity")
    return scored.where(c("_toxicity") < threshold).select(*docs.columns)
