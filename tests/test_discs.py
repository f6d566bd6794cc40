"""Disc sums over tiles against every pixel's own disc."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import stencil


@pytest.mark.parametrize("radius", [2.5, 20, 200])
def test_disc_sums(spark, radius):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (150, 97)).astype(float)
    grid = spark.createDataFrame([("i", "A", r, c, float(v), "kept") for (r, c), v in np.ndenumerate(x)], "image_id string, channel string, row int, col int, value double, other string")
    got = stencil.disc_sums(grid, {"s": F.col("value"), "n": F.lit(1.0)}, radius).collect()
    rows, cols = np.mgrid[0:150, 0:97]
    assert len(got) == x.size and {r["other"] for r in got} == {"kept"}
    for r in got[::97]:
        disc = (rows - r["row"]) ** 2 + (cols - r["col"]) ** 2 <= radius**2
        assert (r["s"], r["n"], r["value"]) == (x[disc].sum(), disc.sum(), x[r["row"], r["col"]])


def test_rows_shuffled_at_radius_50(spark):
    """Each pixel of a 512 x 512 plane goes to 2.25 tiles at most."""
    r, side = 50, 200
    at = np.arange(512)
    low, high = np.maximum((at - r) // side, 0), (at + r) // side
    assert (high - low + 1).mean() ** 2 <= 2.25
    grid = spark.range(512 * 512).select(F.lit("i").alias("image_id"), F.lit("A").alias("channel"), F.expr("cast(id div 512 as int)").alias("row"), F.expr("cast(id % 512 as int)").alias("col"), F.lit(1.0).alias("value"))
    got = stencil.disc_sums(grid, {"n": F.lit(1.0)}, r).agg(F.count(F.lit(1)), F.max("n")).first()
    assert got[0] == 512 * 512 and got[1] == sum(2 * int((r * r - d * d) ** 0.5) + 1 for d in range(-r, r + 1))
