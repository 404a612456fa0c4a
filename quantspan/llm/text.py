"""What the text operators share: Arrow batches of whole texts, word hashes, counted parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.session import prepare

#: Rows and bytes of one Arrow batch, which is what a Python worker holds at a time.
BATCH_ROWS = "1000"
BATCH_BYTES = str(16 << 20)
#: Distinct words a worker keeps hashes or ids of before it starts anew.
CACHE_WORDS = 200_000


def text_session(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for whole texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{folder}/{name}.parquet")


def crc_bucket(key: Column, n: int) -> Column:
    """``crc32`` of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``function`` over each Arrow batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it holds ``CACHE_WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Base of the rolling window hash: odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each ``size`` consecutive values, by start; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return mix(out)


def spans(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true values, one row per run."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


#: A letter or mark of letters, as a word of prose is made of.
LETTERS = re.compile(r"[^\W\d_]+")


def byte_total(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(df: DataFrame, bytes_each: int, column: str = "text") -> int:
    """How many parts of about ``bytes_each`` bytes of text, and no fewer than the session shuffles into."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-byte_total(df, column) // bytes_each))
