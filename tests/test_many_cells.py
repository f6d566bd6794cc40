"""Hodges-Lehmann shifts of many cells in a task: those that batches cut, those of several batches, and odd ones."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import cells


def test_cells_that_batches_cut(spark):
    rng = np.random.default_rng(5)
    sizes = [1, 3, 700, 2, 1, 40, 41, 5, 260, *rng.integers(1, 30, 60).tolist()]
    rows = [(n, r, int(rng.integers(0, 50)), bool(r % 3 == 0)) for n, size in enumerate(sizes) for r in range(size)]
    at = spark.createDataFrame([("I", r, n, n, e) for n, r, _, e in rows], "image_id string, row int, col int, label int, is_edge boolean")
    px = spark.createDataFrame([("I", c, r, n, float(v * k)) for n, r, v, _ in rows for c, k in (("A", 1), ("B", 2), (None, 3))], "image_id string, channel string, row int, col int, value double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        made = cells.hodges_lehmann(px, at)
        assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()  # a call of Python for each cell
        got = {(r["ObjectNumber"], r["channel"]): r["hl"] for r in made.collect()}
        huge = {(r["ObjectNumber"], r["channel"]): r["hl"] for r in cells.hodges_lehmann(px, at, pairs=50).collect()}
        assert cells.hodges_lehmann(px.where(F.lit(False)), at).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == 3 * len(sizes) and got == huge
    for n in range(len(sizes)):
        edge = np.array([v for m, _, v, e in rows if m == n and e], float)
        core = np.array([v for m, _, v, e in rows if m == n and not e], float)
        want = float(np.median(core[:, None] - edge[None, :])) if len(core) and len(edge) else None
        for channel, k in (("A", 1), ("B", 2), (None, 3)):
            assert got[n, channel] == (None if want is None else want * k)


def test_pixels_without_a_value(spark):
    at = spark.createDataFrame([("I", r, 0, 1, r < 3) for r in range(6)], "image_id string, row int, col int, label int, is_edge boolean")
    px = spark.createDataFrame([("I", "A", r, 0, v) for r, v in enumerate([1.0, None, 3.0, 10.0, 20.0, None])] + [("I", "B", r, 0, None) for r in range(6)], "image_id string, channel string, row int, col int, value double")
    assert {r["channel"]: r["hl"] for r in cells.hodges_lehmann(px, at).collect()} == {"A": 13.0, "B": None}
