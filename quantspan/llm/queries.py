"""Named queries of the text operators, and their SQL statements.

Each query applies its operator to a whole table and derives the columns of its result from what the
operator returns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.llm import (
    alignment,
    bpe,
    decontamination,
    embedding,
    language,
    line_dedup,
    minhash,
    phrases,
    quality,
    substring_dedup,
    token_output,
    toxicity,
    variants,
)
from quantspan.llm.text import crc_bucket, map_batches, table
from quantspan.session import fresh_path

c = F.col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text and the text of these ids, as digests."""

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), ",")
        sha = [[hashlib.sha256(x.as_py().encode()).hexdigest() for x in col] for col in (joined, batch.column("decoded"))]
        lengths = pc.list_value_length(ids).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths, *map(pa.array, sha)], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(bpe.decode(coded), digests, schema)


@query
def op3_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's ids stand in the token files, read back from them."""
    out = fresh_path(spark, "tokens")
    token_output.write_tokens(table(spark, folder, "documents"), out)
    files = token_output.read_tokens(spark, out)

    def checksums(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lengths = bpe.list_parts(batch.column("ids"))
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths) * 4
        sums = [zlib.crc32(data[b - 4 * n : b]) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
        columns = [batch.column("doc_id"), batch.column("part"), batch.column("first"), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    read = map_batches(files, checksums, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return read.join(token_output.starts(files), "part").select(
        "doc_id", (c("before") + c("first")).alias("start"), "n_tokens", "ids_crc32"
    )


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each text without word windows that an earlier document holds."""
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", substring_dedup.n_removed().alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that occur in benchmark items, and the items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_hits(docs, table(spark, folder, "benchmark"))
    hit = decontamination.n_hit().cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE["op4_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT body, min(doc_id) AS d FROM starts GROUP BY body),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT s.doc_id, s.i FROM starts s JOIN firsts f ON s.body = f.body WHERE f.d < s.doc_id), range(13) t(k)),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.p) AS body, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

ORACLE["op5_decontamination"] = r"""
WITH lower_d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
lower_b AS (
  SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_d),
b AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_b),
sought AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS body FROM (
    SELECT item_id, w[i:i + 9] AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b)
    UNION ALL SELECT item_id, w FROM b WHERE len(w) BETWEEN 1 AND 9)),
sizes AS (SELECT DISTINCT n FROM sought),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS body
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
found AS (SELECT p.doc_id, p.i, p.n, s.item_id FROM places p JOIN sought s ON p.n = s.n AND p.body = s.body),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document, by models of the labelled documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.add_scores(docs, model)
    return scored.select(
        "doc_id",
        (crc_bucket(c("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        c("toxicity").alias("score"),
        (c("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document, how many of them are later repeats, and what is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.remove_repeated_lines(docs, min_words=line_dedup.MIN_WORDS)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op2_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS p FROM d),
pairs AS (
  SELECT doc_id, p, x || chr(10) || lead(x) OVER w AS body FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
firsts AS (SELECT body, min((doc_id, p)) AS place FROM pairs WHERE body IS NOT NULL GROUP BY body),
long AS (
  SELECT doc_id, p, x FROM each WHERE length(x) >= 50
    AND len(regexp_extract_all(x, '[{unspaced}]|[^\x20\x09-\x0D{unspaced}]+')) >= 50),
first_long AS (SELECT x, min((doc_id, p)) AS place FROM long GROUP BY x),
gone AS (
  SELECT doc_id, p + k AS p
  FROM (SELECT a.doc_id, a.p FROM pairs a JOIN firsts f ON a.body = f.body WHERE f.place < (a.doc_id, a.p)), range(2) t(k)
  UNION SELECT l.doc_id, l.p FROM long l JOIN first_long f ON l.x = f.x WHERE f.place < (l.doc_id, l.p)),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.x, chr(10) ORDER BY e.p) AS body
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(d.l) AS n_lines, len(d.l) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
""".replace("{unspaced}", r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}")


@query
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by a similarity of 0.85 and more of their sets of three words."""
    near = minhash.Near(shingle=3, percent=85)
    groups = minhash.near_groups(table(spark, folder, "documents"), near)
    return groups.select("doc_id", "n_shingles", "component_id", (c("doc_id") == c("component_id")).alias("kept"))


ORACLE["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(l.b, w.doc_id)) AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN lowest l ON l.a = w.doc_id
"""


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, by profiles of those that are not held out."""
    docs = table(spark, folder, "documents")
    profiles = language.fit(language.training(docs).select("text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), profiles)
    held_out = crc_bucket(c("doc_id"), language.FOLDS) == language.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document: the posterior of its heuristics, and a scorer trained on these."""
    scored = quality.score_quality(table(spark, folder, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "weak_label", c("quality").alias("score"), (c("quality") >= quality.KEEP).cast("int").alias("predicted"))


@query
def op7_embedding_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 and more: how many links each has, and its component."""
    found = embedding.near_vectors(table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (c("vec_id") == c("component_id")).alias("kept"))


ORACLE["op7_embedding_graph"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(l.b, v.vec_id)) AS kept
FROM v LEFT JOIN degree d ON d.a = v.vec_id LEFT JOIN lowest l ON l.a = v.vec_id
"""


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two tokenizers line up in each text, and how often its pairs of tokens meet in all texts."""
    found = alignment.align_corpus(table(spark, folder, "documents"), digest=_sha256).documents
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select("doc_id", *counts, c("groups").alias("groups_sha256"))


@query
def op12_phrase_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of each text and of an edited form, and how like the edited text and the next one are."""
    found = phrases.compare_in_order(table(spark, folder, "documents"))
    digests = [F.lower(F.hex(x)).alias(x) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", *digests, "near_edited", "near_next")


#: Of so many occurrences of words about one loses a letter, so that there are misspelled words to find.
MISSPELLED_ONE_IN = 31


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words, how many others are one edit apart, and the frequent word that each is a variant of."""
    words = variants.count_words(table(spark, folder, "documents"), one_in=MISSPELLED_ONE_IN)
    return variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
