"""Small cases worked out from the definitions, apart from the operators and their SQL."""

import numpy as np
import pytest

from cellweave.jobs import workloads
from cellweave.operators import affine, hotspot, scores, shapes

LAYERED = "image_id string, ObjectNumber int, channel string, angle int, layer int, value double"


def test_sliding_sum_of_one_shape(spark):
    layered = spark.createDataFrame([("i", 1, "A", a, j, float(10 * a + j)) for a in range(8) for j in range(3)], LAYERED)
    got = shapes.sliding_sums(layered, spark.createDataFrame([(0, 0, 1)], "shape_id int, angle int, depth int"), 3).where("start = 1").first()
    assert (got["shape_sum"], got["shape_n"]) == (281, 9)  # layer 0 of all angles, 280, and layer 1 of angle 0


def test_histogram_of_moved_boundaries(spark):
    rng = np.random.default_rng(3)
    markers, means = {c: rng.normal(10 * c, c, 300) for c in (1, 2, 3)}, {1: 9.0, 2: 21.0, 3: 30.0}
    bins, fine = 100, 1000
    first, last = min(m.min() - means[c] for c, m in markers.items()), max(m.max() - means[c] for c, m in markers.items())
    want = np.zeros((4, bins), int)
    for c, m in markers.items():
        count = np.histogram(m, bins=fine, range=(m.min(), m.max()))[0]
        points = np.linspace(m.min() - means[c], m.max() - means[c], fine)
        for j, at in enumerate(np.digitize(points, np.linspace(first, last, bins + 1), right=True)):
            want[c, min(at, bins) - 1] += count[j]  # 0 - 1 is the last bin
    m = spark.createDataFrame([("i", c, "A", i, float(x)) for c, v in markers.items() for i, x in enumerate(v)], "image_id string, ObjectNumber int, channel string, shape_id int, marker double")
    got = shapes.histogram(m, spark.createDataFrame([("i", c, "A", v) for c, v in means.items()], "image_id string, ObjectNumber int, channel string, value double"), 300).collect()
    grid, found = np.linspace(first, last, bins), np.zeros((4, bins), int)
    for r in got:
        found[r["ObjectNumber"], r["bin"]] = r["n"]
        assert r["grid"] == pytest.approx(grid[r["bin"]])
    assert (found == want).all()


def test_bins_follow_the_number_of_shapes():
    assert shapes.n_shapes(8, 2, 0, 0.4) == 120 and shapes.n_shapes(16, 4, 0.0, 0.4) == 16 * (1 + 4 + 16 + 64 + 256 + 1024 + 4096)


def _what_if(spark, rings, depth, maxdist):
    rows = [("i", 1, c, a, r, x) for a in range(8) for r in range(rings) for c, x in (("A", 1.0), ("own_nucleus", float(r < depth)))]
    profile = spark.createDataFrame(rows, "image_id string, ObjectNumber int, channel string, angle int, ring int, value double")
    return {r["status"] for r in shapes.what_if(profile, shapes.shapes(spark, 8, 1, 0, 0.2), maxdist).collect()}


def test_status_of_cells_without_room(spark):
    assert _what_if(spark, 6, 2, 3) == {"ok"} and _what_if(spark, 5, 2, 3) == {"past_last_ring"}
    assert _what_if(spark, 9, 2, -3) == {"nucleus_too_small"} and _what_if(spark, 9, 3, -3) == {"ok"}


def test_location_weights_are_the_smaller_areas(spark):
    rows = [("i", "A", k, 0.6, 0.6 + d, float(e + c), e, c) for k, (d, e, c) in enumerate([(0.1, 2, 30), (-0.05, 6, 100), (0.2, 50, 2)])]
    cells = spark.createDataFrame(rows, "image_id string, channel string, ObjectNumber int, edge double, core double, AREA double, AREA_EDGE int, AREA_CORE int")
    got = scores.marker_location(cells).first()
    assert got["n"] == 3 and got["proportion"] == pytest.approx(4 / 10) and got["location"] == "Whole_cell"


def test_bootstrap_draws_as_many_as_there_are(spark):
    one = spark.createDataFrame([("i", "A", 1, 1.0, 5.0), ("i", "B", 1, -1.0, 5.0)], "image_id string, channel string, ObjectNumber int, value double, weight double")
    assert {tuple(r) for r in scores.bootstrap_share(one).collect()} == {("i", "A", 1.0, 1.0), ("i", "B", 0.0, 0.0)}
    many = spark.createDataFrame([("i", "A", k, 1.0 if k < 60 else -1.0, 1.0) for k in range(100)], one.schema)
    got = scores.bootstrap_share(many, 2000).first()
    assert abs(got["ci_low"] - 0.5) <= 0.02 and abs(got["ci_high"] - 0.69) <= 0.02  # binomial(100, 0.6) / 100


def test_scores_hold_means_against_two_sided_p(spark):
    rng = np.random.default_rng(5)
    rows = [("i", "A", r, c, float(rng.integers(0, 9) + 20 * (r // 8 == c // 8))) for r in range(32) for c in range(32)]
    pixels = spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double")
    mask = spark.createDataFrame([("i", r, c, 1 + (r // 8) * 4 + c // 8 if r % 8 and c % 8 else 0) for r in range(32) for c in range(32)], "image_id string, row int, col int, label int")
    f = workloads.calculate_features(pixels, mask, include_scores=True, include_weights=True).collect()
    assert {r["channel"] for r in f} == {"A", "A_GP", "A_GPhot", "A_weights"}
    mean, p, score = ({r["ObjectNumber"]: r[c] for r in f if r["channel"] == ch} for ch, c in (("A", "MEAN"), ("A_GP", "MEAN"), ("A", "MEAN_GP_SCORE")))
    xy = spark.createDataFrame([("i", "A", k, mean[k], p[k]) for k in mean], "image_id string, channel string, ObjectNumber int, x double, y double")
    want = {r["ObjectNumber"]: r["score"] for r in scores.score(xy, scores.smooth_max(xy)).collect()}
    assert score == pytest.approx(want)


def test_disc_totals():
    x = np.random.default_rng(1).random((9, 14))
    for r2 in (0.25, 2.25, 12.25, 400.0):
        want = [[sum(x[a, b] for a in range(9) for b in range(14) if (a - i) ** 2 + (b - j) ** 2 <= r2) for j in range(14)] for i in range(9)]
        assert np.allclose(hotspot._disc_totals(x, r2), want)


def _drawn(n, rng):
    """Eight of n, drawn anew up to ten times if one came twice."""
    for _ in range(11):
        at = rng.integers(0, n, 8)
        if len(set(at.tolist())) == 8:
            break
    return at


@pytest.mark.parametrize("radius, tile", [(2, 5), (100, 0)])
def test_disc_permutation_by_its_definition(spark, radius, tile):
    x = np.random.default_rng(2).integers(0, 20, (12, 12)).astype(float)
    x[3:5, 3:5] += 60
    rows = [("i", "A", a, b, float(x[a, b])) for a in range(12) for b in range(12)]
    got = hotspot.g_disc_permutation(spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double"), radius, 199, tile=tile).collect()
    total = hotspot._disc_totals(x, (radius + 0.5) ** 2)
    pad = np.pad(x, 1, mode="edge")
    near = sum(pad[a : a + 12, b : b + 12] for a in range(3) for b in range(3)) - x
    rng = np.random.default_rng(8)
    assert len(got) == 144
    for r in got:
        i, j = r["row"], r["col"]
        assert r["g"] == pytest.approx(near[i, j] / total[i, j])
        if (i, j) in ((4, 4), (0, 0), (11, 6)):  # p against a plain simulation
            disc = np.array([x[a, b] for a in range(12) for b in range(12) if 0 < (a - i) ** 2 + (b - j) ** 2 <= (radius + 0.5) ** 2])
            sims = np.array([x[i, j] + disc[_drawn(len(disc), rng)].sum() for _ in range(2000)]) / total[i, j]
            assert r["p_hot"] == pytest.approx((sims > near[i, j] / total[i, j]).mean(), abs=0.15)


def test_large_discs_in_bounded_memory(spark):
    x = np.random.default_rng(6).random((150, 130))
    rows = [("i", "A", a, b, float(x[a, b])) for a in range(150) for b in range(130)]
    got = hotspot.g_disc_permutation(spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double"), 50, 3)
    assert got.count() == 150 * 130


def test_a_fraction_of_the_transforms(spark):
    assert affine.RANGES["sx"] == (0.8, 1.2) and affine.RANGES["rot"][1] == pytest.approx(np.pi / 12)
    every = affine.chosen_transforms(spark)
    some = {r["transform_id"] for r in affine.chosen_transforms(spark, sample_fraction=0.1).collect()}
    assert every.count() == 2187 and len(some) == 218 and affine.chosen_transforms(spark, 40, 0.5).count() == 20
