"""op8 on a dense group of distinct vectors over several blocks, and on vectors of huge and tiny length, against brute force."""

import numpy as np

from cellweave.llm import vectors


def _brute(ids, v, threshold=0.93):
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= threshold
    root = np.array(ids)
    while True:
        least = np.where(near, root[None, :], root.max()).min(axis=1)
        if (least == root).all():
            return {i: (int(n) - 1, int(r)) for i, n, r in zip(ids, near.sum(axis=1), root)}
        root = least


def test_dense_group_over_blocks(spark):
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(24)
    v = np.concatenate([centre + 0.17 * rng.standard_normal((1400, 24)), rng.standard_normal((300, 24))])
    ids = list(range(len(v)))
    docs = spark.createDataFrame([(i, x.tolist(), 1) for i, x in zip(ids, v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(docs).collect()}
    want = _brute(ids, v)
    links = sum(n for n, _ in want.values())
    assert links > 1_500_000 and len({r for _, r in want.values()}) > 250
    # a pair just at the threshold may miss all buckets with probability 1e-4
    assert 0 <= links - sum(n for n, _ in got.values()) <= links * 1e-3
    assert all(got[i][0] <= want[i][0] and got[i][1] == want[i][1] for i in ids)


def test_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((8, 16))
    v = np.concatenate([base * s for s in (1e300, 1.0, 1e-300)])
    v[1] += 1e299 * rng.standard_normal(16) * 0.1
    docs = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(docs).collect()}
    assert got == {i: (2, i % 8) for i in range(24)}


def test_unmet_members():
    key = np.array([[1, 7, 5], [1, 8, 5], [2, 8, 5], [1, 8, 5], [3, 9, 5]])
    assert vectors._unmet(key, 0).tolist() == [0, 1, 2, 3, 4]
    assert vectors._unmet(key, 1).tolist() == [2, 4]
    assert len(vectors._unmet(key, 2)) == 2 and len(vectors._unmet(np.ones((4, 3), np.int64), 1)) == 0
