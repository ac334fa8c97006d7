"""SimHash and embedding near duplicates against all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hexwarden.llm import cells, components, embeddings, simhash
from tests.llm.conftest import SF, ordered


def _smallest_reachable(ids, linked):
    """Component ids by union of all linked pairs; null ids count last."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in linked(i):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        if x is not None:
            groups[find(i)] = min(x, groups.get(find(i), x))
    return [groups.get(find(i)) for i in range(len(ids))]


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_all_pairs(spark, frame):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, None), (900_000, ""), (900_001, "one two"), (900_002, "ONE two"), (900_003, "É É É É"), (900_004, "w " * 50_000), (docs[0][0], docs[0][1])]
    got = simhash.near_duplicates(frame([(*d, "x") for d in docs], "doc_id long, text string, fp string"))
    prints = np.array([_fingerprint(t) for _, t in docs], dtype=np.uint64)
    ids = _smallest_reachable([d for d, _ in docs], lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3))
    want = [(d[0], f"{int(p):016x}", c) for d, p, c in zip(docs, prints, ids, strict=True)]
    assert ordered(map(tuple, got.collect())) == ordered(want)
    kept = simhash.one_of_each(frame([(*d, "x") for d in docs], "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert ordered({r.doc_id for r in kept.collect()}) == ordered(set(ids)) and kept.count() == len(set(ids))
    assert simhash.near_duplicates(frame([], "doc_id long, text string")).count() == 0


def test_pigeonring_loses_no_link(spark, frame):
    rng = random.Random(1)
    prints = []
    for _ in range(150):
        base = rng.getrandbits(64)
        prints += [base]
        for n in (1, 2, 3, 4):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints = np.array(sorted(set(prints)), dtype=np.uint64)
    df = frame([(int(p),) for p in prints.view(np.int64)], "fp long")
    got = {r.node: r.component for r in simhash.print_components(df).collect()}
    signed = prints.view(np.int64).tolist()
    want = _smallest_reachable(signed, lambda i: np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3))
    assert [got.get(p, p) for p in signed] == want


def test_components(frame):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    near = {n: [] for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].append(b)
            near[b].append(a)
    want = _smallest_reachable(nodes, lambda i: [nodes.index(x) for x in near[nodes[i]]])
    got = {r.node: r.component for r in components.components(frame(edges, "a long, b long")).collect()}
    assert got == dict(zip(nodes, want, strict=True))
    assert components.components(frame([], "a long, b long")).count() == 0


def test_blocks_of_a_large_group_meet(frame):
    rows = frame([(1, i) for i in range(100)] + [(2, 5)], "k long, v long")
    dealt = cells.dealt(rows, ["k"], F.col("v"), "t", block=30).collect()
    by_cell = {}
    for r in dealt:
        by_cell.setdefault(r.cell, []).append(r)
    met = {(a.v, b.v) for own in by_cell.values() for a in own for b in own}
    assert len(met) == 100 * 100 and max(map(len, by_cell.values())) <= 60
    assert {r.k for r in dealt} == {1}  # A group of one has nobody to meet.


def _vectors(rng, n, dim):
    base = rng.normal(size=(n, dim))
    rows = [v for b in base for v in (b, b, 3 * b, b + rng.normal(size=dim) * rng.choice([0.02, 0.18, 0.25]))]
    return np.float32(rows)


def test_embeddings_equal_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 32)
    rng = np.random.default_rng(3)
    vectors = _vectors(rng, 150, 16)
    rows = [(i, v.tolist(), int(i // 4 % 2), "x") for i, v in enumerate(vectors)]
    df = frame(rows, "vec_id long, embedding array<float>, label int, leaf string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = [np.flatnonzero((unit @ unit[i] >= 0.98) & (label == label[i])) for i in range(len(rows))]
    found, all_links = sum(r.n_links for r in got.values()), sum(len(x) - 1 for x in linked)
    assert 0.95 * all_links <= found <= all_links and all(got[i].n_links <= len(linked[i]) - 1 for i in got)
    want = _smallest_reachable(list(range(len(rows))), lambda i: linked[i])
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_odd_vectors(frame):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [1.0, 0.0], None), (7, [2.0, 0.0], 1),
        (8, [1.0, 0.0, 0.0], 1), (9, [1.0, None], 1), (None, [1.0, 0.0], 1), (10, [], 1), (11, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (12, [float("inf")], 1),
    ]
    df = frame(rows, "vec_id long, embedding array<float>, label int")
    got = ordered(map(tuple, embeddings.near_duplicates(df).collect()))
    linked = {1, 2, 7, None}
    want = [(i, 4, 1, i == 1) if i in linked else (i, 0, i, True) for i, _, _ in rows if i != 6] + [(6, 0, 6, True)]
    assert got == ordered(want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
