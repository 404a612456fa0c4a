"""From raw documents to token ids: the stages, and a run of all of them.

A stage takes ``(spark, docs, sf_dir)`` and returns what the next one works on. Stages read the tables
they need beside the documents (labels, benchmark) from ``sf_dir``. Between stages documents are written
as Parquet to the shared folder, so a lost executor costs at most the work of one stage.

Every stage but the last returns the columns of ``documents``, ``n_chars`` following the text. Nulls,
empty tables and repeated rows have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.llm import bpe, decontamination, line_dedup, minhash, toxicity
from quantspan.llm.text import table
from quantspan.session import materialize


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where they have it, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of single lines of many words, are deleted; documents that lose all their lines go."""
    return _measured(line_dedup.drop_repeated_lines(docs, min_words=line_dedup.MIN_WORDS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return minhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that mostly consist of them go."""
    return _measured(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), ids="ids"), ids="ids")
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", lossless.alias("lossless"))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("bpe_tokens", tokens),
]

#: The first and the last stage are models and merges that SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
