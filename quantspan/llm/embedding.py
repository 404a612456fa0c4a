"""Near-dedup of embeddings on a flat, robustly pruned neighbour graph.

1. Equal vectors are one node with a number of copies, so a vector however common is searched once.
2. Centres are fitted on a bounded sample (``SAMPLE_ROWS``). Each node goes to its ``OVERLAP`` nearest
   centres and to all nearly as near (``MARGIN``), so shards overlap. A shard beyond ``SLICE`` nodes is
   dealt into slices of about that size.
3. Each slice builds a graph: a node's nearest ones and some others, pruned robustly (a candidate stays
   unless one kept before is nearer to it by ``ALPHA``), with edges in both directions. The lists of a
   node from all its shards are united.
4. Every node is a query in its shards, against each slice of them. In its own slice it starts from where it is in the
   graph: to its neighbours and on from every one within range, until no more are within range. In other slices of a shard
   a greedy search with a beam starts from the slice's medoid and goes on like that.
   Links count in both directions, and those of a pair of slices run in one task, so they are symmetric.
5. Every candidate is verified by its cosine in double precision. Links give numbers and components.

``audit_recall`` holds the links against brute force for every 20th vector.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components are linked with
nothing; vectors of different lengths are never compared; rows that repeat (id and vector) count once;
rows with a null id are linked like others but count as no one's link. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.components import components
from quantspan.llm.text import mix, text_session
from quantspan.session import materialize

COSINE = 0.95
SAMPLE_ROWS = 20_000
#: Nodes for each centre, as far as the sample has ``MIN_SAMPLE`` rows for each.
SHARD, MIN_SAMPLE, CENTRE_ROUNDS = 400, 8, 6
OVERLAP, MARGIN = 2, 0.06
SLICE = 3000
#: Rows that are compared at a time while a graph is built or searched, and pairs whose vectors are held.
BLOCK, PAIRS = 256, 100_000
#: Nearest and other candidates of a node; kept ones of each; how much nearer a kept one must be to prune.
NEAREST, OTHERS, KEPT, KEPT_OTHERS, ALPHA = 40, 16, 16, 6, 1.2
BEAM = 40
AUDIT_EVERY, AUDIT_BLOCK = 20, 2048

c = F.col


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array(rows, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``node, vector, copies``: each distinct usable vector, with the smallest id that has it."""
    vector = c("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(c("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(~odd & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit vectors, by rounds of nearest-centre means; the first ones are spread evenly over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(CENTRE_ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def _centres(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centres by length of vector."""
    sizes = {r["d"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("d")).count().collect()}
    out = {}
    for d, n in sizes.items():
        own = nodes.where(F.size("vector") == d).orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS)
        sample = unit([r["vector"] for r in own.select("vector").collect()])
        out[d] = fit_centres(sample, max(1, min(-(-n // SHARD), len(sample) // MIN_SAMPLE)))
    return out


def assign(nodes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``shard, node, vector, copies``: a row for each shard of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            values = batch.column("vector").flatten().to_numpy()
            begins = np.cumsum(lengths) - lengths
            shards, rows = [], []
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                near = unit(values[begins[at][:, None] + np.arange(d)]) @ centres[int(d)].T
                least = np.sort(near, 1)[:, -min(OVERLAP, near.shape[1])]
                i, k = np.nonzero(near >= np.minimum(least, near.max(1) - MARGIN)[:, None])
                shards.append([f"{d}-{x}" for x in k])
                rows.append(at[i])
            if rows:
                own = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(sum(shards, [])), *own.columns], ["shard", *own.schema.names])

    return nodes.select("node", "vector", "copies").mapInArrow(run, "shard string, node long, vector array<double>, copies long")


def prune(near: np.ndarray, between: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (columns, nearest first) stay, row by row.

    ``near`` has their distances from the row, ``between`` those from each other, ``own`` says which of them are the row itself.
    """
    kept = np.zeros(near.shape, bool)
    for t in range(near.shape[1]):
        stays = ~own[:, t] & (kept.sum(1) < most)
        stays &= ~(kept[:, :t] & (ALPHA * between[:, :t, t] <= near[:, t, None])).any(1)
        kept[:, t] = stays
    return kept


def build_graph(x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors. Distances are held for ``BLOCK`` rows at a time."""
    n = len(x)
    edges = [np.empty((0, 2), np.int64)]
    for start in range(0, n, BLOCK):
        rows = np.arange(start, min(start + BLOCK, n))
        distances = np.maximum(2 - 2 * (x[rows] @ x.T), 0)
        near = np.arange(n)[None].repeat(len(rows), 0)
        if n > NEAREST + 1:
            near = np.argpartition(distances, NEAREST, 1)[:, : NEAREST + 1]
        draw = mix(ids[rows].astype(np.uint64)[:, None] * np.uint64(64) + np.arange(OTHERS, dtype=np.uint64)) % np.uint64(n)
        for found, most in ((near, KEPT), (draw.astype(np.int64), KEPT_OTHERS)):
            far = np.take_along_axis(distances, found, 1)
            order = np.argsort(far, 1, kind="stable")
            found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
            y = x[found]
            between = np.maximum(2 - 2 * (y @ y.transpose(0, 2, 1)), 0)
            i, k = np.nonzero(prune(far, between, found == rows[:, None], most))
            edges.append(np.column_stack([rows[i], found[i, k]]))
    pairs = np.concatenate(edges)
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return np.split(pairs[:, 1], np.cumsum(np.bincount(pairs[:, 0], minlength=n))[:-1]) if n else []


def _vectors(rows: pa.Table) -> np.ndarray:
    column = rows["vector"].combine_chunks()
    return unit(column.flatten().to_numpy().reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def _build(group: pa.Table) -> pa.Table:
    ids = group["node"].to_numpy()
    near = build_graph(_vectors(group), ids)
    return pa.table({"node": group["node"], "near": pa.array([ids[x] for x in near], pa.list_(pa.int64()))})


def search(x: np.ndarray, near: list[np.ndarray], medoid: int, query: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of ``x`` within range of ``query``, as far as the graph leads to them."""
    seen = np.zeros(len(x), bool)
    found, scores = np.array([medoid]), x[[medoid]] @ query
    seen[medoid] = True
    spread = np.zeros(1, bool)
    while not spread.all():
        at = np.flatnonzero(~spread)
        at = at[scores[at] >= cosine] if (scores[at] >= cosine).any() else at[[scores[at].argmax()]]
        spread[at] = True
        new = np.unique(np.concatenate([near[i] for i in found[at]] or [np.empty(0, np.int64)]))
        new = new[~seen[new]]
        seen[new] = True
        found, scores = np.concatenate([found, new]), np.concatenate([scores, x[new] @ query])
        spread = np.concatenate([spread, np.zeros(len(new), bool)])
        if len(found) > BEAM:  # the beam: the best ones, and all within range
            stay = scores >= min(np.partition(scores, -BEAM)[-BEAM], cosine)
            found, scores, spread = found[stay], scores[stay], spread[stay]
    return found[scores >= cosine]


def _edges(rows: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours that are among ``rows`` too: where each row's begin (and end), and their places."""
    column, n = rows["near"].combine_chunks(), len(ids)
    order = np.argsort(ids, kind="stable")
    to = column.flatten().to_numpy()
    own = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
    place = order[np.minimum(np.searchsorted(ids[order], to), n - 1)]
    here = ids[place] == to
    return np.concatenate([[0], np.cumsum(np.bincount(own[here], minlength=n))]), place[here]


def spread(x: np.ndarray, ends: np.ndarray, to: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` within range, each row searched from where it is itself in the graph.

    From a row to its neighbours, and on from those within range or nearly so (``ALPHA``), until no more are: what pruning has
    taken off a row's list it has left on the list of one that is nearer to it. All rows of a block go on together.
    """
    n, reach = len(x), 1 - ALPHA * (1 - cosine)
    found = [np.empty((0, 2), np.int64)]
    for start in range(0, n, BLOCK):
        asks = np.arange(start, min(start + BLOCK, n))
        seen = np.zeros((len(asks), n), bool)
        seen[np.arange(len(asks)), asks] = True
        asking, at = np.arange(len(asks)), asks
        while len(at):
            going = [(asking[:0], at[:0])]
            for k in range(0, len(at), PAIRS // 32):
                q, v = asking[k : k + PAIRS // 32], at[k : k + PAIRS // 32]
                degree = ends[v + 1] - ends[v]
                q = np.repeat(q, degree)
                v = to[np.repeat(ends[v] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())]
                new = np.unique((q * n + v)[~seen[q, v]])
                q, v = np.divmod(new, n)
                seen[q, v] = True
                for j in range(0, len(q), PAIRS):
                    a, b = q[j : j + PAIRS], v[j : j + PAIRS]
                    score = np.einsum("ij,ij->i", x[asks[a]], x[b])
                    found.append(np.column_stack([asks[a], b])[score >= cosine])
                    going.append((a[score >= reach], b[score >= reach]))
            asking, at = (np.concatenate(y) for y in zip(*going, strict=True))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _search_slices(cosine: float):
    """Links between two slices (or within one), and what joins their nodes to components."""

    def run(group: pa.Table) -> pa.Table:
        sides = [group.filter(pa.compute.equal(group["side"], s)) for s in (0, 1)]
        x = [_vectors(s) for s in sides]
        ids = [s["node"].to_numpy() for s in sides]
        a, b, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def link(left: int, i: np.ndarray, right: int, j: np.ndarray) -> None:
            for p, r, q, s in ((left, i, right, j), (right, j, left, i)):
                a.append(ids[p][r])
                b.append(ids[q][s])
                n.append(sides[q]["copies"].to_numpy()[s])

        if not len(ids[1]) and len(ids[0]):
            i, j = spread(x[0], *_edges(sides[0], ids[0]), cosine)
            link(0, i, 0, j)
        elif len(ids[0]) and len(ids[1]):
            for index, asking in ((0, 1), (1, 0)):
                ends, to = _edges(sides[index], ids[index])
                near = np.split(to, ends[1:-1])
                medoid = int((x[index] @ x[index].mean(0)).argmax())
                for k, query in enumerate(x[asking]):
                    j = search(x[index], near, medoid, query, cosine)
                    link(asking, np.full(len(j), k), index, j)
        a, b, n = (np.concatenate(y) for y in (a, b, n))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        once = a != b
        once[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, n = a[once], b[once], n[once]
        nodes, begins = np.unique(a, return_index=True)
        links = pa.StructArray.from_arrays([pa.array(b), pa.array(n)], ["node", "copies"])
        ends = pa.array(np.append(begins, len(a)), pa.int32())
        return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.ListArray.from_arrays(ends, links)})

    return run


def find_links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """The nodes, and for each linked one the nodes and copies it is linked with."""
    text_session(vectors.sparkSession)
    nodes = materialize(nodes_of(vectors), "nodes")
    placed = materialize(assign(nodes, _centres(nodes)), "shards")
    sizes = materialize(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "sizes")
    slices = F.ceil(c("n") / SLICE)
    sliced = placed.join(sizes, "shard").select(
        "shard", F.pmod(F.xxhash64("shard", "node"), slices).cast("int").alias("slice"), slices.cast("int").alias("slices"), "node", "vector", "copies"
    )
    built = sliced.select("shard", "slice", "node", "vector").groupBy("shard", "slice").applyInArrow(_build, "node long, near array<long>")
    graph = materialize(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    tile = F.explode(
        F.transform(
            F.sequence(F.lit(0), c("slices") - 1),
            lambda k: F.struct(F.least("slice", k).alias("i"), F.greatest("slice", k).alias("j"), (c("slice") > k).cast("int").alias("side")),
        )
    )
    tiles = sliced.withColumn("t", tile).select("shard", "t.*", "node", "vector", "copies").join(graph, "node")
    found = tiles.groupBy("shard", "i", "j").applyInArrow(_search_slices(cosine), "node long, links array<struct<node:long,copies:long>>")
    united = found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    return nodes, materialize(united, "links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id`` per row of ``vectors``."""
    nodes, links = find_links(vectors, cosine)
    # a node's links to smaller ones join it to its component; the smallest of them is one of these
    edges = links.select(c("node").alias("a"), F.explode(F.filter("links.node", lambda b: b < c("node"))).alias("b"))
    whole = components(edges)
    near = F.aggregate("links", F.lit(0).cast("long"), lambda total, x: total + x["copies"])
    told = (
        nodes.join(links.select("node", near.alias("near")), "node", "left")
        .join(whole, "node", "left")
        .select("vector", (c("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    rows = vectors.select(c("vec_id").cast("long").alias("vec_id"), c("embedding").cast("array<double>").alias("vector"))
    return rows.join(materialize(told, "told"), "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


def audit_recall(nodes: DataFrame, links: DataFrame, cosine: float = COSINE, every: int = AUDIT_EVERY) -> float:
    """Of the links that brute force finds for the nodes whose id is divisible by ``every``, the share found."""
    asked = nodes.where(c("node") % every == 0)
    blocks = max(1, -(-asked.count() // AUDIT_BLOCK))
    true = hit = 0
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).select("node", "vector").collect()
        ids, vectors = [r["node"] for r in rows], [r["vector"] for r in rows]

        def pairs(batches: Iterator[pa.RecordBatch], ids=ids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for node, v in zip(batch.column("node").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                    same = [i for i, q in enumerate(vectors) if len(q) == len(v)]
                    if same:
                        near = unit([vectors[i] for i in same]) @ unit([v])[0] >= cosine
                        found += [(ids[i], node) for i, x in zip(same, near, strict=True) if x and ids[i] != node]
                a, b = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        exact = nodes.select("node", "vector").mapInArrow(pairs, "a long, b long")
        own = links.select(c("node").alias("a"), F.explode("links.node").alias("b")).withColumn("hit", F.lit(1))
        row = exact.join(own, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k")).first()
        true, hit = true + row["n"], hit + row["k"]
    return hit / true if true else 1.0
