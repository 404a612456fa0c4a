"""Token ids of whole texts as ORC files in id order, and reading them back.

Rows are dealt by ranges of the document id, sorted, encoded with the tokenizers library and written
as ORC. The writer keeps ids as run-length encoded integers, an index over every ``ROW_STRIDE`` rows
and a Bloom filter on the document id, so a reader takes stripes in parallel and skips stripes and row
groups by their metadata. Each row also has its place within its file; a sum over one row per file
then gives its place among all documents without ordering rows again.

Columns of the files: ``doc_id``, ``part`` (which file), ``first`` (ids before it in the file),
``n_tokens`` and ``ids``, the end id last.

Edge cases: a null text counts as empty and has the end id alone; rows with a null ``doc_id`` come
first; rows that repeat a ``doc_id`` stay apart and follow each other; an empty table gives files
without rows. Further columns of the documents are not written.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.llm import bpe
from quantspan.llm.text import text_session

#: Id that ends a document.
END = 0
STRIPE_BYTES = 16 << 20
ROW_STRIDE = 1000
SCHEMA = "doc_id long, first long, n_tokens long, ids array<int>"

c = F.col


#: Characters of joined pieces in one text for the library, and such texts in one call.
JOINED_CHARS = 1 << 10
CALL_TEXTS = 64
#: Pieces whose ids a worker that writes files remembers (some 250 bytes each).
KEPT_PIECES = 600_000


@cache
def library_coder(path: str, plain_specials: bool = False, kept: int = bpe.CACHE_WORDS) -> bpe.PieceCoder:
    """Pieces encoded by the library, many at a time. With ``plain_specials`` special tokens in a text are text.

    Pieces that begin with a space and do not end in white space are joined: a text of them may be cut
    before each of these spaces (see ``bpe``), so the tokens of one piece end where the next one begins.
    Others are encoded one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library, sizes = Tokenizer.from_file(path), bpe.merge_table(path).byte_counts
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = plain_specials

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        out = [np.empty(0, np.int32)]
        for k in range(0, len(texts), CALL_TEXTS):  # without offsets, which nobody reads
            out += [np.array(x.ids, np.int32) for x in library.encode_batch_fast(texts[k : k + CALL_TEXTS], add_special_tokens=False)]
        return out

    def encode(pieces: list[str]) -> bpe.Coded:
        plain = np.fromiter((x[0] == " " and not x[-1].isspace() for x in pieces), bool, len(pieces))
        first, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        some = [pieces[k] for k in first.tolist()]
        groups = np.cumsum(np.fromiter(map(len, some), np.int64, len(some))) // JOINED_CHARS
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(some)]
        ids = np.concatenate(ids_of(["".join(some[a:b]) for a, b in zip(edges, edges[1:])]))
        ends, wanted = np.cumsum(sizes[ids]), np.cumsum(np.fromiter((len(x.encode()) for x in some), np.int64, len(some)))
        cuts = np.searchsorted(ends, wanted) + 1
        if len(some) and (cuts[-1] != len(ids) or (ends[cuts - 1] != wanted).any()):
            raise ValueError("tokens of joined pieces do not end where the pieces do")
        own = ids_of([pieces[k] for k in other.tolist()])[1:]
        flat = np.concatenate([ids, *own])
        lengths = np.concatenate([np.diff(cuts, prepend=0), np.fromiter(map(len, own), np.int64, len(own))])
        starts, back = np.cumsum(lengths) - lengths, np.argsort(np.concatenate([first, other]))
        return bpe.gather(flat, starts[back], lengths[back]), lengths[back]

    return bpe.PieceCoder(encode, {} if plain_specials else bpe.special_tokens(path), kept)


def _encoded(rows: DataFrame, path: str, end: int) -> DataFrame:
    """``doc_id, text`` in the order of its partitions, as rows of ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for batch in batches:
            ids, lengths = library_coder(path, kept=KEPT_PIECES).texts(batch.column("text").to_pylist())
            ids, lengths = np.insert(ids, np.cumsum(lengths), end), lengths + 1
            ends = first + np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ends - lengths), pa.array(lengths), bpe.to_lists(ids, lengths)],
                ["doc_id", "first", "n_tokens", "ids"],
            )
            first = int(ends[-1]) if len(ends) else first

    return rows.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``) to the folder ``out``, in ascending ``doc_id`` order."""
    text_session(docs.sparkSession)
    rows = docs.select(c("doc_id").cast("long"), c("text").cast("string")).repartitionByRange("doc_id")
    coded = _encoded(rows.sortWithinPartitions("doc_id"), tokenizer or bpe.default_path(), end)
    coded.withColumn("part", F.spark_partition_id()).write.mode("errorifexists").options(
        **{
            "orc.bloom.filter.columns": "doc_id",
            "orc.create.index": "true",
            "orc.row.index.stride": str(ROW_STRIDE),
            "orc.stripe.size": str(STRIPE_BYTES),
            "orc.compress": "ZSTD",
        }
    ).orc(out)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; bounds and ids reach the reader, which skips what their metadata excludes."""
    df = spark.read.schema("doc_id long, first long, n_tokens long, ids array<int>, part int").orc(path)
    if low is not None:
        df = df.where(c("doc_id") >= low)
    if high is not None:
        df = df.where(c("doc_id") <= high)
    return df if ids is None else df.where(c("doc_id").isin(ids))


def starts(files: DataFrame) -> DataFrame:
    """Per file: how many ids all files before it hold. Reads two columns; one row per file."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
