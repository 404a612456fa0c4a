"""Markdown notes with frontmatter and wikilinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.functions.text import FRONTMATTER, frontmatter_body, frontmatter_map, inline_list, wikilinks

# Required frontmatter keys, id form and status domain of decision notes.
REQUIRED_KEYS = ("id", "title", "type", "status", "owner", "created")
DECISION_ID = r"^DEC-\d{3}$"
STATUSES = ("proposed", "accepted", "superseded", "rejected")


def parse_notes(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text) → note columns."""
    rows = texts.withColumn("meta_", frontmatter_map(F.col(text)))
    meta = lambda k: F.col("meta_")[k]
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")
    return rows.select(
        F.col(path).alias("path"),
        F.coalesce(meta("id"), stem).alias("id_key"),
        F.coalesce(meta("title"), stem).alias("title"),
        F.when(F.col(path).contains("/"), F.substring_index(F.col(path), "/", 1)).otherwise("").alias("folder"),
        inline_list(meta("tags")).alias("tags"),
        meta("instrument").alias("instrument"),
        meta("regime").alias("regime"),
        wikilinks(F.col(text)).alias("links"),
        frontmatter_body(F.col(text)).alias("body"),
    )


def read_note_texts(spark: SparkSession, root: str) -> DataFrame:
    """Recursive scan of ``*.md`` as (path relative to the root, text)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = root.rstrip("/").split("://")[-1]
    full = F.col("_metadata.file_path")
    relative = F.substring(full, F.instr(full, F.lit(base)) + len(base) + 1, F.length(full))
    return files.select(F.url_decode(relative).alias("path"), F.col("value").alias("text"))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    return parse_notes(read_note_texts(spark, root))


def content_hash(text: Column) -> Column:
    """Hash of a note body without its frontmatter and leading line breaks."""
    return F.sha2(F.ltrim(frontmatter_body(text), F.lit("\n")), 256)


def frontmatter_problems(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Decision notes with the array of frontmatter problems; the id must start the file name."""
    rows = texts.withColumn("m", frontmatter_map(F.col(text)))
    name = F.element_at(F.split(F.col(path), "/"), -1)
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.map_keys("m"))
    has = F.col(text).rlike(FRONTMATTER)
    m = F.col("m")
    problems = F.when(~has, F.array(F.lit("no frontmatter"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(F.sort_array(missing), ","))),
                F.when(~m["id"].rlike(DECISION_ID), F.concat(F.lit("invalid id: "), m["id"])),
                F.when(~m["status"].isin(*STATUSES), F.concat(F.lit("invalid status: "), m["status"])),
                F.when(~F.startswith(name, m["id"]), F.lit("id is not the file name prefix")),
            )
        )
    )
    return rows.select(F.col(path).alias("path"), problems.alias("problems"))
