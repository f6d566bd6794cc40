import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import hotspot
from cellweave.operators.stencil import PLANE

KEY = [*PLANE, "row", "col"]


def _pixels(spark):
    return spark.range(40 * 30).select(F.lit("i").alias("image_id"), F.lit("A").alias("channel"), F.expr("int(id div 30)").alias("row"), F.expr("int(id % 30)").alias("col"), F.expr("double(id * 37 % 101)").alias("value"))


def test_all_radii_of_a_pixel_share_a_group(spark):
    """Pixels are shuffled once, not once for each radius and again to count and to merge."""
    p = _pixels(spark)
    got = hotspot.g_radii(p, (2, 5, -1), 19, merge="mean")
    assert hotspot.g_radii(p, (2, 5), 19)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    each = [hotspot.g_disc_permutation(p, 2, 19), hotspot.g_disc_permutation(p, 5, 19), hotspot.g_permutation(p, 19)]
    g = {}
    for one in each:
        for r in one.collect():
            g.setdefault((r["row"], r["col"]), []).append(r["g"])
    rows = got.collect()
    assert len(rows) == 1200 and all(abs(r["g"] - np.mean(g[r["row"], r["col"]])) < 1e-12 for r in rows)
    least = hotspot.g_radii(p, (2, 5, -1), 19).collect()
    assert all(r["g_hot"] in g[r["row"], r["col"]] and 0.05 <= r["p_hot"] <= 1 for r in least)


def test_places_are_even_over_a_disc(spark):
    """Every place of a clipped disc, the pixel itself excepted, is drawn equally often; after ten tries few are alike."""
    x = np.zeros((9, 11))
    for i, j, r in ((0, 0, 3.5), (4, 5, 2.5), (8, 3, 20.5)):
        at = [(a, b) for a in range(9) for b in range(11) if 0 < (a - i) ** 2 + (b - j) ** 2 <= r * r]
        for n, place in enumerate(at):
            x[:] = 0
            x[place] = 1
            sums = np.concatenate([s.ravel() for _, s in hotspot._disc_sums_drawn(x, np.array([i]), np.array([j]), r * r, 4, 4000, np.random.default_rng(n))])
            want = 4 / len(at)
            assert len(sums) == 4000 and (sums > 1).sum() <= 8 and abs(sums.mean() - want) < 5 * (want * (1 - want) / 4000) ** 0.5
