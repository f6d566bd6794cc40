"""Shapes of width 0, and full inner layers, against the definition in numpy."""

import numpy as np

from cellweave.operators import shapes


def _layered(spark, n_layers):
    v = np.random.default_rng(7).integers(1, 50, (8, n_layers)).astype(float)
    return v, spark.createDataFrame([("i", 1, "A", a, j, float(v[a, j]), j) for a in range(8) for j in range(n_layers)], "image_id string, ObjectNumber int, channel string, angle int, layer int, value double, ring int")


def _depths(spark):
    out = {}
    for r in shapes.shapes(spark, 8, 2, 0, 0.4).collect():
        out.setdefault(r["shape_id"], np.zeros(8, int))
        if r["angle"] is not None:
            out[r["shape_id"]][r["angle"]] = r["depth"]
    return out


def test_unmoved_boundary_is_a_shape(spark):
    d = _depths(spark)
    assert len(d) == 8 * (1 + 2 + 4 + 8) and sum(not x.any() for x in d.values()) == 8
    rows = [("i", 1, c, a, r, x, 1) for a in range(8) for r in range(6) for c, x in (("A", float(a + r)), ("own_nucleus", float(r < 2)))]
    profile = spark.createDataFrame(rows, "image_id string, ObjectNumber int, channel string, angle int, ring int, value double, n int")
    got = {r["shape_id"]: r for r in shapes.what_if(profile, shapes.shapes(spark, 8, 2, 0, 0.4)).collect()}
    own = np.add.outer(np.arange(8), np.arange(3)).mean()
    assert len(got) == 120 and all(got[i]["n"] == 0 and abs(got[i]["marker"] - own) < 1e-9 for i in range(8))


def test_sliding_sums_have_full_inner_layers(spark):
    v, layered = _layered(spark, 4)
    s, d = shapes.shapes(spark, 8, 2, 0, 0.4), _depths(spark)
    got = {(r["shape_id"], r["start"]): (r["shape_sum"], r["shape_n"]) for r in shapes.sliding_sums(layered, s, 4).collect()}
    want = {(i, j): (v[:, :j].sum() + sum(v[a, j : j + x[a]].sum() for a in range(8)), 8 * j + x.sum()) for i, x in d.items() for j in range(3)}
    assert got == want
