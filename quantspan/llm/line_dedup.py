"""Line dedup by winnowing, in DataFrame functions alone.

A run of lines is a repeat if the same lines stand earlier, in an earlier document (by ``doc_id``) or
earlier in the same one. Runs of ``min_lines`` lines and more are found; lines of later ones are deleted.

Each line is hashed. Of every ``min_lines`` consecutive lines the smallest hash is a fingerprint (the
last of equal ones): what it selects depends on these lines alone, so two equal runs that long are
guaranteed to share a fingerprint at the same place. Fingerprints that occur once in the corpus end
here, which is nearly all of them. Each other one is extended over the lines around it: every window of
lines that selected it is compared by its content with the first place where that content stands, to
the left and to the right of the fingerprint, and windows that stand earlier join to maximal runs.

Where ``min_words`` is given, a single line of that many words is a repeat too if the same line stands
earlier, in a document of any number of lines: a passage written as one paragraph. In scripts without
spaces each letter counts as a word.

The first place of a window, or of a long line, is an aggregate (summed up within tasks before the shuffle) and is joined
back, so neither a common line nor a copied document meets in one task, and no pairs are made.

Edge cases: a null text stays null; an empty text is one empty line; blank lines are lines like others;
documents of fewer than ``min_lines`` lines lose long lines at most; overlapping repeats (a line many times
over) keep the first; rows that share a ``doc_id`` are compared as one document whose rows stand one
above the other, and lose the same lines; rows with a null ``doc_id`` are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.llm.text import text_session
from quantspan.session import materialize

MIN_LINES = 2
#: Words of a line that is a passage by itself.
MIN_WORDS = 50
#: Letters that are counted one by one, since their scripts put no spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
#: The same, with letters of no such script named first: what a script a letter has is looked up is most of the work.
_SPACED = rf"[\x21-\x7E\u00A1-\u058F[^\x20\x09-\x0D{UNSPACED}]]"

c = F.col


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, hashes``: the hash of each line."""
    return docs.where("doc_id is not null and text is not null").select(
        c("doc_id").cast("long"), F.transform(lines(c("text")), lambda x: F.xxhash64(x)).alias("hashes")
    )


def fingerprints(hashed: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, at, fingerprint, around``: the selected lines, with the lines a window of theirs can reach."""
    reach = min_lines - 1
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), (-i).alias("back")))
    least = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - min_lines), lambda i: -F.array_min(F.slice(placed, i + 1, min_lines))["back"]
    )
    first = F.greatest(c("at") - reach, F.lit(0))
    return (
        hashed.where(F.size("hashes") >= min_lines)
        .select("doc_id", "hashes", F.explode(F.array_distinct(least)).alias("at"))
        .select(
            "doc_id",
            "at",
            first.alias("first"),
            F.get("hashes", c("at")).alias("fingerprint"),
            F.slice("hashes", first + 1, c("at") + reach - first + 1).alias("around"),
        )
    )


def repeated_windows(prints: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, start``: the windows that stand earlier. ``prints`` is read twice."""
    # written before they are joined: only then can a common key be split among tasks
    often = materialize(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "often")
    start = c("first") + c("k")
    windows = (
        prints.join(often, "fingerprint")
        .select("doc_id", "at", "first", "around", F.explode(F.sequence(F.lit(0), F.size("around") - min_lines)).alias("k"))
        .select("doc_id", "at", start.alias("start"), F.slice("around", c("k") + 1, min_lines).alias("window"))
    )
    chosen = F.array_max(F.transform("window", lambda h, i: F.when(h == F.array_min("window"), i)))
    windows = materialize(
        windows.where(c("start") + chosen == c("at")).select("doc_id", "start", F.xxhash64("window").alias("content")), "windows"
    )
    place = F.struct("doc_id", "start")
    firsts = materialize(windows.groupBy("content").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    return windows.join(firsts, "content").where(c("earliest") < place).select("doc_id", "start")


def repeated_long_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, start``: the lines of ``min_words`` words and more that stand earlier."""
    # so many words have as many letters at least: short lines are not searched for words, others only up to that number
    words = rf"^[\x20\x09-\x0D]*+(?:(?:{_SPACED}++|[{UNSPACED}])[\x20\x09-\x0D]*+){{{min_words}}}"
    long = lambda x: F.when(F.length(x) >= min_words, x.rlike(words))
    placed = F.transform(lines(c("text")), lambda x, i: F.when(long(x), F.struct(i.alias("start"), F.xxhash64(x).alias("content"))))
    found = (
        docs.where("doc_id is not null and text is not null")
        .select(c("doc_id").cast("long").alias("doc_id"), F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("line"))
        .select("doc_id", "line.*")
    )
    found, place = materialize(found, "long-lines"), F.struct("doc_id", "start")
    earliest = found.groupBy("content").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return found.join(materialize(earliest, "firsts"), "content").where(c("earliest") < place).select("doc_id", "start")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``doc_id, repeated``: the places (from 0) of the lines to delete, where there are any."""
    text_session(docs.sparkSession)
    prints = materialize(fingerprints(line_hashes(docs), min_lines), "fingerprints")
    runs = repeated_windows(prints, min_lines).withColumn("end", c("start") + (min_lines - 1))
    if min_words is not None:
        runs = runs.unionByName(repeated_long_lines(docs, min_words).withColumn("end", c("start")))
    found = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    covered = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"])))
    return found.select("doc_id", F.array_distinct(covered).alias("repeated"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``docs`` with the columns ``kept`` (the text without later repeats), ``n_lines`` and ``n_removed``."""
    taken = {"kept", "n_lines", "n_removed"} & set(docs.columns)
    if taken:
        raise ValueError(f"there are columns named {sorted(taken)} already")
    found = repeated_lines(docs, min_lines, min_words).withColumnsRenamed({"doc_id": "_of", "repeated": "_repeated"})
    rows = docs.join(found, docs["doc_id"].cast("long") == c("_of"), "left")
    own = lines(c("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), c("_repeated"))
    kept = F.when(c("_repeated").isNull(), c("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))
    n_lines = F.coalesce(F.when(c("text").isNotNull(), F.size(own)), F.lit(0)).cast("long")
    n_left = F.when(c("_repeated").isNull(), n_lines).otherwise(F.size(left).cast("long"))
    return rows.select(*[docs[x] for x in docs.columns], kept.alias("kept"), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``docs`` with later repeats deleted from ``text``; documents that lose every line go."""
    renamed = docs.withColumnsRenamed({x: f"_{k}_{x}" for k, x in enumerate(docs.columns) if x not in ("doc_id", "text")})
    rows = remove_repeated_lines(renamed, min_lines, min_words)
    rows = rows.where("n_lines = 0 or n_removed < n_lines").withColumn("text", c("kept")).drop("kept", "n_lines", "n_removed")
    return rows.toDF(*docs.columns)
