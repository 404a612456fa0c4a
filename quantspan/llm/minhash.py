"""MinHash near-dedup: banded candidates, checked by odd sketches and then exactly.

A document's set holds the hashes of its distinct word shingles. Its MinHash samples give the keys of
``bands`` bands and an odd sketch: each sample flips one bit of a bitmap, so the bits in which two
bitmaps differ tell how many samples differ, most precisely where few do.

1. Documents with equal sets are one class, represented by a text of the smallest id; copies end here.
2. Representatives that share the key of a band are a bucket. Each is paired with the smallest of its
   bucket, pairs whose sketches differ too much are dropped (far below the similarity sought), and the
   others are compared on their full sets. The links found give components.
3. A bucket that still spans several components may hide a link between others than the smallest. Its
   members outside its largest component are compared with all of it, block by block and exactly, within
   tasks that return the links that join components. Buckets of the same members are compared once.

So no bucket meets in one task and no pairs of a group are emitted, yet a link between two components
is missed only if a pair shares no band: at a similarity of 0.85 that has a probability of 6e-11, at 0.8
of 5e-8, with 32 bands of 4.

Edge cases: null and empty texts and texts without words have an empty set and are linked with nothing; a
text of fewer words than a shingle is one shingle; rows that share a ``doc_id`` are one document in
``near_groups``, which has the links of each of them, but ``keep_one`` judges each of these rows by its own text, so that no
text goes without one like it that stays; rows with a null ``doc_id`` are linked with nothing and kept; tables
without rows give none. Further columns are neither read nor changed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.llm.components import components
from quantspan.llm.text import WORDS, map_batches, mix, rolling, text_bytes, text_session
from quantspan.session import materialize

c = F.col

#: Members of a block; a task compares two blocks.
BLOCK = 1024
#: How far below the similarity sought (six standard errors and more) a sketch rules a pair out.
MARGIN = 0.25
#: Shingles hashed at a time.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Near:
    """Similar means: sets of ``shingle`` words with a Jaccard similarity of ``percent`` and more."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    bits: int = 512

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Bits in which the sketches of a pair worth comparing differ at most."""
        differing = 2 * self.samples * (1 - (self.percent / 100 - MARGIN))
        return math.ceil(self.bits / 2 * (1 - math.exp(-2 * differing / self.bits)))

    def similar(self, common, either):
        return 100 * common >= self.percent * either


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order; A-Z are lower-cased."""
    words = text.lower().split() if text else []
    return np.unique(rolling(WORDS.of(words), min(size, max(1, len(words)))))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``n`` hash functions, from their numbers alone."""
    values = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return values[:n] | np.uint64(1), values[n:]


def min_samples(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash samples of sets that are not empty: one row each."""
    factors, offsets = _constants(n)
    out = np.empty((len(sets), n), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= CHUNK):
            size += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for k in range(n):
            out[first:last, k] = np.minimum.reduceat(((values * factors[k] + offsets[k]) >> np.uint64(32)).astype(np.uint32), starts)
        first = last
    return out


def band_keys(samples: np.ndarray, near: Near) -> np.ndarray:
    key = np.tile(np.arange(1, near.bands + 1, dtype=np.uint64) << np.uint64(40), (len(samples), 1))
    grouped = samples.astype(np.uint64).reshape(len(samples), near.bands, near.rows)
    for r in range(near.rows):
        key = mix(key ^ grouped[:, :, r]) + np.uint64(r + 1)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words."""
    n, k = samples.shape
    place = mix(samples.astype(np.uint64) | (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flat = place.astype(np.int64) + np.arange(n)[:, None] * bits
    odd = np.bincount(flat.ravel(), minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, keys, sketch``; the last three null for an empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, near.shingle) for t in text_bytes(batch.column("text"))]
        full = [k for k, s in enumerate(sets) if len(s)]
        digests: list = [None] * len(sets)
        keys, sketches = list(digests), list(digests)
        if full:
            samples = min_samples([sets[k] for k in full], near.samples)
            for k, own, sketch in zip(full, band_keys(samples, near), odd_sketch(samples, near.bits), strict=True):
                digests[k], keys[k], sketches[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), own, sketch
        longs = pa.list_(pa.int64())
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs)]
        own = [batch.column("doc_id"), batch.column("text_key")]
        return pa.RecordBatch.from_arrays([*own, *columns], ["doc_id", "text_key", "n_shingles", "digest", "keys", "sketch"])

    schema = "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>, sketch array<long>"
    return map_batches(docs, run, schema)


def differing_bits(a: str, b: str, near: Near) -> Column:
    each = [F.bit_count(c(a)[k].bitwiseXOR(c(b)[k])) for k in range(near.bits // 64)]
    return sum(each[1:], each[0])


def compare_pairs(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar, by their full texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True):
            x, y = shingles(a, near.shingle), shingles(b, near.shingle)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(near.similar(common, len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep))

    one, other = (texts.select(c("node").alias(k), c("text").alias(f"text_{k}")) for k in "ab")
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def similar_matrix(left: list[np.ndarray], right: list[np.ndarray], near: Near) -> np.ndarray:
    """Which sets of ``left`` are similar to which of ``right``, from counts of common members."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)), np.float32)

    def member(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(some)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(some, s)
            at = at[(at < len(some))]
            out[k, at[np.isin(some[at], s, assume_unique=False)]] = 1
        return out

    for k in range(0, len(shared), 4096):
        some = shared[k : k + 4096]
        common += member(left, some) @ member(right, some).T
    common = common.astype(np.int64)
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return near.similar(common, sizes - common)


def _distinct(pairs: np.ndarray) -> tuple[list, list]:
    """The distinct rows whose two values differ, and where each of them stands first."""
    apart = np.flatnonzero(pairs[:, 0] != pairs[:, 1])
    values, first = np.unique(pairs[apart], axis=0, return_index=True)
    return values.tolist(), apart[first].tolist()


def _join_blocks(near: Near):
    """Of two blocks, links between members of different components, enough of them to join these."""

    def run(group: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            rows = group.filter(pa.compute.equal(group["side"], side))
            texts = [shingles(t, near.shingle) for t in text_bytes(rows["text"].combine_chunks())]
            sides.append((rows["node"].to_pylist(), rows["component"].to_pylist(), texts))
        found: list[tuple[int, int]] = []
        if sides[0][0] and sides[1][0]:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            rows, columns = np.nonzero(similar_matrix(sides[0][2], sides[1][2], near))
            ends = np.column_stack([np.array(sides[0][1])[rows], np.array(sides[1][1])[columns]])
            for (a, b), k in zip(*_distinct(ends), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((sides[0][0][rows[k]], sides[1][0][columns[k]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def compare_blocks(members: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Links between the components of each bucket. ``members``: ``key, node, component``.

    Those outside a bucket's largest component are compared with all of its members, a block of the
    former with a block of the latter in a task; members of the largest one are not with each other.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("most"))
    blocks = sizes.select("key", "main", F.ceil(c("n") / BLOCK).alias("all"), F.ceil((c("n") - c("most")) / BLOCK).alias("rest"))
    rows = members.join(materialize(blocks, "blocks"), "key")

    def dealt(some: DataFrame, own: str, other: str, side: int) -> DataFrame:
        """Each row in its block of ``own`` blocks, once for each block of the other side."""
        block, each = F.pmod(F.xxhash64("node"), c(own)), F.explode(F.sequence(F.lit(0).cast("long"), c(other) - 1))
        i, j = ("block", "each") if side == 0 else ("each", "block")
        placed = some.withColumn("block", block).withColumn("each", each)
        return placed.select("key", "node", "component", c(i).alias("i"), c(j).alias("j"), F.lit(side).alias("side"))

    tiles = dealt(rows, "all", "rest", 0).union(dealt(rows.where("component <> main"), "rest", "all", 1))
    return tiles.join(texts, "node").groupBy("key", "i", "j").applyInArrow(_join_blocks(near), "a long, b long")


def _relabelled(components_: DataFrame, more: DataFrame) -> DataFrame:
    """Components after components have been joined: ``more`` says what each of them belongs to now."""
    again = more.select(c("node").alias("component"), c("component").alias("joined"))
    return components_.join(again, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def _keyed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a hash of the text, which tells rows of one id apart."""
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def _same_members(named: DataFrame) -> DataFrame:
    """One key of each set of members that several components share. Sets are told apart by 128 bits of hashes of their members."""
    own = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set_{k}") for k in (0, 1)]
    sums = [F.min("node").alias("first"), F.max("node").alias("last"), F.max("n").alias("n"), *own]
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *sums).where("low < high")
    return mixed.groupBy("first", "last", "n", "set_0", "set_1").agg(F.min("key").alias("key")).select("key")


def text_groups(docs: DataFrame, near: Near, by_id: bool) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id``: per row, the smallest id among the texts that links lead to.

    With ``by_id`` rows that share an id are linked too.
    """
    text_session(docs.sparkSession)
    rows = _keyed_rows(docs)
    signed = materialize(signatures(rows, near), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    # a class has a number of its own: several of them may begin with one id
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "first.*"), "classes")
    firsts = filled.join(classes, ["digest", "doc_id", "text_key"]).select("node", "keys", "sketch")
    firsts = materialize(firsts.dropDuplicates(["node"]), "firsts")
    keyed = firsts.select("node", F.explode("keys").alias("key"))
    # written before it is joined: only then can the rows of a common key be split among tasks
    buckets = materialize(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialize(keyed.join(buckets, "key"), "members")

    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key")
    texts = rows.join(wanted, ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    sketch = {k: firsts.select(c("node").alias(k), c("sketch").alias(f"sketch_{k}")) for k in "ab"}
    pairs = members.where("node <> hub").select(c("hub").alias("a"), c("node").alias("b")).distinct()
    close = pairs.join(sketch["a"], "a").join(sketch["b"], "b").where(differing_bits("sketch_a", "sketch_b", near) <= near.most_bits)
    first_links = compare_pairs(close.select("a", "b").distinct(), texts, near)
    grouped = materialize(components(first_links), "components")

    named = members.where("n > 2").select("key", "node", "n").join(grouped, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")), "named")
    mixed = materialize(_same_members(named), "mixed")
    open_members = materialize(named.join(mixed, "key", "left_semi").dropDuplicates(["key", "node"]), "open")
    second_links = compare_blocks(open_members, texts, near)
    label = grouped.select("node", "component")
    between = second_links
    for k in "ab":
        own = label.select(c("node").alias(k), c("component").alias(f"of_{k}"))
        between = between.join(own, k, "left").withColumn(f"of_{k}", F.coalesce(f"of_{k}", k))
    more = components(between.select(c("of_a").alias("a"), c("of_b").alias("b")))
    # nodes that the first links left alone are their own components
    alone = more.join(label, "node", "left_anti").select("node", c("node").alias("component"))
    final = _relabelled(label.union(alone), more).groupBy("node").agg(F.min("component").alias("component"))

    placed = signed.select("doc_id", "text_key", "n_shingles", "digest").join(classes.select("digest", "node", c("doc_id").alias("first")), "digest", "left")
    if by_id:
        ids = placed.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        shared = materialize(ids.where("low < high").select("doc_id", "low"), "shared-ids")
        if not shared.isEmpty():
            joined = placed.join(shared, "doc_id").select(c("low").alias("a"), c("node").alias("b"))
            final = components(final.select(c("component").alias("a"), c("node").alias("b")).union(joined))
    names = final.join(classes.select("node", c("doc_id").alias("own")), "node")
    least = names.groupBy("component").agg(F.min("own").alias("least"))
    final = materialize(names.join(least, "component").select("node", "least"), "components")
    component = F.when(c("doc_id").isNotNull(), F.coalesce("least", "first", "doc_id"))
    return placed.join(final, "node", "left").select("doc_id", "text_key", "n_shingles", component.alias("component_id"))


def near_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:  # noqa: B008
    """``doc_id, n_shingles, component_id``: per row, the smallest document that links lead to."""
    return text_groups(docs, near, by_id=True).drop("text_key")


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:  # noqa: B008
    """``docs`` without texts that belong to the group of one with a smaller id."""
    gone = text_groups(docs, near, by_id=False).where("component_id < doc_id").select(c("doc_id").alias("_gone"), c("text_key").alias("_text")).distinct()
    same = (docs["doc_id"].cast("long") == c("_gone")) & (F.xxhash64(docs["text"].cast("string")) == c("_text"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
