"""Shapes that are never listed against the table of shapes, and against brute force where there are many."""

import itertools

import numpy as np
import pytest

from cellweave.operators import shapes

KEY = ("image_id", "ObjectNumber", "channel")


def _profile(spark, cells=5, n=8, rings=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(cells):
        inner = rng.integers(5, 8, n)
        for a, r in itertools.product(range(n), range(rings)):
            rows.append(("i", k, "A", a, r, float(rng.integers(0, 50))))
            rows.append(("i", k, "B", a, r, 3.0))
            rows.append(("i", k, "own_nucleus", a, r, float(r < inner[a]) if k else 0.0))
    rows += [("i", 99, c, a, r, 1.0) for c in ("A", "own_nucleus") for a in range(n) for r in range(rings)]  # no room outside
    return spark.createDataFrame(rows, "image_id string, ObjectNumber int, channel string, angle int, ring int, value double")


@pytest.mark.parametrize("dmax,maxdist,how,own", [(2, 2, "all", False), (3, 3, "all", True), (3, -4, "all", False), (2, 4, "all", False), (2, -4, "all", True), (2, 3, "sub", False), (3, 3, "none", False)])
def test_summaries_and_histogram_of_all_shapes(spark, dmax, maxdist, how, own):
    p = _profile(spark).cache()
    table = shapes.shapes(spark, 8, dmax, 0.0, 0.4)
    markers = shapes.what_if(p, table, maxdist, how, only_own=own).cache()
    want = {tuple(r[k] for k in KEY): r for r in shapes.marker_summaries(markers).collect()}
    got = {tuple(r[k] for k in KEY): r for r in shapes.what_if_summaries(p, 8, dmax, 0.0, 0.4, maxdist, how, only_own=own).collect()}
    assert set(got) == set(want) and got
    for k, r in want.items():
        for c in ("max", "min", "range", "mean", "median", "sd", "cv"):
            assert got[k][c] == pytest.approx(r[c], abs=1e-7), (k, c)
    means = p.where("channel <> 'own_nucleus'").groupBy(*KEY).agg({"value": "avg"}).withColumnRenamed("avg(value)", "value")
    if how == "all":
        count = shapes.n_shapes(8, dmax, 0.0, 0.4)
        same = lambda df: {(*[r[k] for k in KEY], r["bin"]): r["n"] for r in df.collect()}
        assert same(shapes.what_if_histogram(p, means, 8, dmax, 0.0, 0.4, maxdist, only_own=own)) == same(shapes.histogram(markers, means, count))


def test_moved_patterns_have_starts(spark):
    p = _profile(spark)
    table = shapes.shapes(spark, 8, 2, 0.0, 0.4)
    assert {r["start"] for r in shapes.what_if(p, table, 4).select("start").distinct().collect()} == {0, 1, 2}
    assert "start" not in shapes.what_if(p, table, 2).columns


def test_millions_of_shapes(spark):
    """16 angles, depths up to 6: 895,792 shapes of each cell; medians by counting equal those of a list."""
    p = _profile(spark, cells=2, n=16, rings=22, seed=3)
    got = {tuple(r[k] for k in KEY): r for r in shapes.what_if_summaries(p, 16, 6, 0.0, 0.4).collect()}
    assert shapes.n_shapes(16, 6, 0.0, 0.4) == 895_792 and ("i", 1, "A") in got
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 50, (3, 16, 6)).astype(float)
    moves = shapes._Moves(grid, np.array([900.0, 10.0, 0.0]), np.array([40.0, 3.0, 16.0]), 6, range(0, 5), "all", False)
    m = moves.listed()
    low, high, mean, sd, number = moves.moments()
    assert (number == m.shape[1]).all() and np.allclose(low, m.min(axis=1)) and np.allclose(high, m.max(axis=1))
    assert np.allclose(mean, m.mean(axis=1)) and np.allclose(sd, m.std(axis=1))
    assert np.allclose([moves._counted_median(r, low[r], high[r], int(number[r])) for r in range(3)], np.median(m, axis=1), atol=1e-9)
