"""op8 on null ids, ties, repeated rows, no rows and columns with clashing names; graph components against union-find."""

import numpy as np

from cellweave.llm import graph, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, key string, copies int, code int, component_id int"


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = [float(x) for x in rng.normal(size=16)]
    w = [-x for x in v]
    rows = [(5, v, 1), (3, v, 1), (9, v, 2), (None, v, 1), (7, w, 1), (8, [0.0] * 16, 1), (10, v[:8], 1), (11, None, 1), (12, v, None), (13, [2 * x for x in v], 1)]
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(docs).collect()}
    assert got == {3: (2, 3, True), 5: (2, 3, False), 13: (2, 3, False), 9: (0, 9, True), None: (0, None, True), 7: (0, 7, True), 8: (0, 8, True), 10: (0, 10, True), 11: (0, 11, True), 12: (0, 12, True)}
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_hub_a_chain_and_a_random_graph(spark):
    rng = np.random.default_rng(7)
    edges = [(1000, 2000 + i) for i in range(400)] + [(5000 + i, 5001 + i) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(6000, 6400, (250, 2))] + [(1, 1), (None, 4), (2001, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component_id"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
