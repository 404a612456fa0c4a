"""Near duplicates of texts and of vectors against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quantspan.llm import embedding, minhash
from quantspan.llm.components import components


def _grouped(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def _set(text, k):
    words = (text or "").lower().split()
    return {tuple(words[p : p + k]) for p in range(max(1, len(words) - k + 1))} if words else set()


def _brute(rows, near):
    sets = {i: _set(t, near.shingle) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= near.percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in _grouped(ids, links).items()}


@pytest.mark.parametrize(("near", "block"), [(minhash.Near(3, 85), 256), (minhash.Near(), 4)])
def test_groups(docs, monkeypatch, near, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(block)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows = []
    for group in range(6):  # copies and near copies, some of which are near others only
        base = [word() for _ in range(r.choice([30, 60, 120]))]
        for _ in range(r.choice([2, 9, 25])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    rows += [(2000 + k, " ".join(word() for _ in range(n))) for k, n in enumerate((1, 2, 3, 5, 50))]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_groups(docs(rows), near).collect()}
    assert got == _brute(rows, near)


def test_no_text_goes_with_a_repeated_id(docs):
    """A row stays unless a text like its own stays under a smaller id, whatever else its id stands for."""
    a, b, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abd")
    rows = [(3, a), (8, a), (8, b), (20, b)]
    assert [tuple(x) for x in minhash.near_groups(docs(rows)).select("doc_id", "component_id").orderBy("doc_id").collect()] == [(3, 3), (8, 3), (8, 3), (20, 3)]
    assert sorted((x["doc_id"], x["text"]) for x in minhash.keep_one(docs(rows)).collect()) == [(3, a), (8, b)]
    r = random.Random(8)
    texts = [a, b, d, a + " x", b.replace("b7 ", "q "), d + " y z", "", None]
    for seed in range(3):
        r.seed(seed)
        rows = [(r.randrange(6), r.choice(texts)) for _ in range(20)]
        kept = {(x["doc_id"], x["text"]) for x in minhash.keep_one(docs(rows)).collect()}
        sets = {t: _set(t, 5) for t in texts}
        for i, t in rows:
            near = [(j, u) for j, u in rows if u == t or (sets[t] and 100 * len(sets[t] & sets[u]) >= 80 * len(sets[t] | sets[u]))]
            assert any((j, u) in kept and j <= i for j, u in near)


def test_text_edges(docs, odd):
    rows = [*odd, (30, "ONE"), (31, "a b c"), (32, "a  b\nc")]
    got = {}
    for x in minhash.near_groups(docs(rows)).collect():
        got.setdefault(x["doc_id"], set()).add((x["n_shingles"], x["component_id"]))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)} and got[4] == {(1, 4)} and got[5] == {(1, 4)}
    assert got[30] == {(1, 4)} and got[31] == got[32] == {(1, 31)} and got[6] == {(1, 6)} and got[8] == {(2, 8)}
    kept = minhash.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 8, 31]
    assert minhash.near_groups(docs([])).count() == 0


def test_sketches_tell_how_far_apart():
    near, r = minhash.Near(), np.random.default_rng(0)
    base = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    for share in (0.0, 0.05, 0.1, 0.5):
        n = int(share * len(base))
        other = np.concatenate([base[n:], r.integers(0, 2**63, n).astype(np.uint64)])
        sketch = minhash.odd_sketch(minhash.min_samples([base, np.unique(other)], near.samples), near.bits)
        bits = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
        differing = -near.bits / 2 * np.log(1 - 2 * bits / near.bits)
        similarity = (1 - share) / (1 + share)
        assert abs(1 - differing / (2 * near.samples) - similarity) < 0.15
        assert similarity < 0.8 or bits <= near.most_bits


def test_similar_matrix():
    r, near = np.random.default_rng(2), minhash.Near(percent=50)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = minhash.similar_matrix(sets[:12], sets, near)
    for i in range(12):
        for j in range(30):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (100 * len(a & b) >= 50 * len(a | b))


def test_components(spark):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)]
    links = [x for x in links if x[0] != x[1]]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for x in links for i in x}
    assert got == _grouped(ids, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")


@pytest.mark.parametrize("size", [1500, 60])
def test_vectors(spark, monkeypatch, size):
    monkeypatch.setattr(embedding, "SLICE", size)
    monkeypatch.setattr(embedding, "SHARD", 100)
    r = np.random.default_rng(size)
    x = r.normal(size=(400, 24))
    crowd = r.normal(size=24) + 0.12 * r.normal(size=(150, 24))  # most of these are near each other
    x = np.concatenate([x, x[:60] + 0.1 * r.normal(size=(60, 24)), crowd, x[:3], x[:3]]).astype(np.float32)
    rows = [(int(i) * 11 % 2003, v.tolist()) for i, v in enumerate(x)]
    nodes, links = embedding.find_links(_vectors(spark, rows))
    assert embedding.audit_recall(nodes, links, every=1) > 0.99
    u = embedding.unit(x.astype(float))
    true = (u @ u.T >= embedding.COSINE) & ~np.eye(len(u), dtype=bool)
    ids = [i for i, _ in rows]
    label = _grouped(ids, [(ids[a], ids[b]) for a, b in np.argwhere(true)])
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embedding.near_vectors(_vectors(spark, rows)).collect()}
    want = {i: (int(n), label[i]) for i, n in zip(ids, true.sum(1), strict=True)}
    assert sum(got[i] == want[i] for i in ids) >= 0.99 * len(ids) and all(got[i][0] <= want[i][0] for i in ids)


def test_vectors_of_a_slice_start_from_themselves(monkeypatch):
    monkeypatch.setattr(embedding, "search", None)  # from the medoid: for other slices only
    r = np.random.default_rng(8)
    centre = r.normal(size=24)
    x = embedding.unit(np.concatenate([centre + s * r.normal(size=(300, 24)) for s in (0.1, 0.22, 0.3, 2.0)]))
    ids = r.permutation(10_000)[: len(x)].astype(np.int64)
    near = [np.append(ids[at], -1) for at in embedding.build_graph(x, ids)]  # -1 is in no slice
    group = pa.table({"side": np.zeros(len(x), int), "node": ids, "vector": list(x), "copies": ids % 3 + 1, "near": near})
    got = embedding._search_slices(embedding.COSINE)(group).to_pylist()
    true = (x @ x.T >= embedding.COSINE) & ~np.eye(len(x), dtype=bool)
    want = {int(ids[i]): {(int(ids[j]), int(ids[j] % 3 + 1)) for j in np.flatnonzero(row)} for i, row in enumerate(true)}
    found = {g["node"]: {(k["node"], k["copies"]) for k in g["links"]} for g in got}
    assert all(own <= want[i] for i, own in found.items())
    assert sum(map(len, found.values())) >= 0.999 * true.sum()


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [2.0, 4.0])]
    rows += [(9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 0.0]), (11, [-1.0, -2.0])]
    got = {}
    for g in embedding.near_vectors(_vectors(spark, rows)).collect():
        got.setdefault(g["vec_id"], []).append((g["n_links"], g["component_id"]))
    for i in (1, 2, 3, 4, 5, 6, 10, 11):
        assert got[i] == [(0, i)]
    assert got[7] == [(2, 7)] and got[8] == [(2, 7)] and got[9] == [(2, 7)] * 2
    assert embedding.near_vectors(_vectors(spark, [])).count() == 0
