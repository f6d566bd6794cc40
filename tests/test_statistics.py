"""Hand cases and properties."""

import math

import numpy as np
import pytest

from cellweave.functions.special import phi
from cellweave.operators import affine, cells, hotspot, polar, scores, stencil


def _pixels(spark, a, image="i", channel="A"):
    rows = [(image, channel, r, c, float(v)) for r, line in enumerate(a) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double")


def _mask(spark, a, image="i"):
    rows = [(image, r, c, int(v)) for r, line in enumerate(a) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id string, row int, col int, label int")


def test_phi(spark):
    xs = [-40.0, -8.0, -1.5, 0.0, 0.3, 2.0, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", phi("x").alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-14) for r in got)


def test_constant_plane_has_no_statistic(spark):
    got = hotspot.g_statistic(_pixels(spark, np.ones((5, 5)))).collect()
    assert len(got) == 25 and all(r["g"] is None and r["p_hot"] is None for r in got)


def test_p_values_belong_together(spark):
    got = hotspot.g_statistic(_pixels(spark, np.random.default_rng(1).integers(0, 9, (12, 12)))).collect()
    assert all(r["p_cold"] + r["p_hot"] == pytest.approx(1) and r["p_both"] == pytest.approx(2 * min(r["p_cold"], r["p_hot"])) for r in got)


def test_edges_of_small_cells(spark):
    m = [[1, 0, 0, 0], [0, 2, 2, 2], [0, 2, 2, 2], [0, 2, 2, 2]]
    got = {(r["row"], r["col"]): r["is_edge"] for r in stencil.perimeter(_mask(spark, m)).collect()}
    assert got[0, 0] and not got[2, 2] and sum(got.values()) == 9
    f = {r["ObjectNumber"]: r for r in cells.features(_pixels(spark, np.arange(16).reshape(4, 4)), stencil.perimeter(_mask(spark, m))).collect()}
    assert f[1]["CORE_MEAN"] == 0 and f[1]["AREA_CORE"] == 0 and f[2]["CORE_MEAN"] == 10 and f[2]["AREA"] == 9


def test_large_cells_shift_by_bisection(spark):
    rng = np.random.default_rng(3)
    p, e = _pixels(spark, rng.integers(0, 50, (9, 9))), stencil.perimeter(_mask(spark, np.ones((9, 9))))
    assert cells.hodges_lehmann(p, e).first()["hl"] == pytest.approx(cells.hodges_lehmann(p, e, pairs=1).first()["hl"])


def test_permutations_repeat_and_are_in_range(spark):
    p = _pixels(spark, np.random.default_rng(2).normal(size=(10, 10)))
    for f in (lambda: hotspot.g_permutation(p, 19), lambda: hotspot.g_disc_permutation(p, 2, 19, tile=5), lambda: hotspot.h_permutation(p, 19)):
        a, b = (sorted(map(tuple, f().collect())) for _ in range(2))
        assert a == b and len(a) == 100
    got = hotspot.g_disc_permutation(p, 2, 19).collect()
    assert all(1 / 20 <= r["p_hot"] <= 1 for r in got)


def test_put_back_value_matches_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(6, 6))
    full = lambda v: hotspot._stencil(v, True) + v
    s = np.random.default_rng(6).permutation(x.ravel()).reshape(x.shape)
    e, d = s - full(s) / 9, x - s
    top = hotspot._stencil(e * e, True) - 2 * d / 9 * hotspot._stencil(e, True) + 8 * (d / 9) ** 2 + (e + d - d / 9) ** 2
    y = s.copy()
    y[3, 2] = x[3, 2]
    r = (y - full(y) / 9) ** 2
    assert top[3, 2] == pytest.approx(r[2:5, 1:4].sum())


def test_ten_cells_have_no_smooth_max(spark):
    xy = spark.createDataFrame([("i", "A", k, float(k), 1 / (k + 1)) for k in range(10)] + [("i", "B", k, float(k), 1 / (k + 1)) for k in range(30)], "image_id string, channel string, ObjectNumber int, x double, y double")
    got = {r["channel"]: r for r in scores.smooth_max(xy).collect()}
    assert got["A"]["x0"] is None and got["B"]["x0"] is not None


def test_lookup_has_each_offset_once():
    for n, r in ((8, 12), (8, 10), (16, 16)):
        lut = polar.lookup(n, r)
        assert len({(a, b) for a, b, _, _ in lut}) == len(lut) and (0, 0) not in {(a, b) for a, b, _, _ in lut}


def test_identity_transform_gives_plain_means(spark):
    m = np.zeros((12, 12), int)
    m[2:6, 2:7], m[7:11, 5:10] = 1, 2
    p, mask = _pixels(spark, np.arange(144).reshape(12, 12)), _mask(spark, m)
    same = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "tx double, ty double, rot double, sx double, sy double, shx double, shy double")
    want = {r["ObjectNumber"]: r["value"] for r in cells.cell_intensities(p, mask).collect()}
    got = {r["ObjectNumber"]: r["median"] for r in affine.direct_affine_medians(p, mask, same).collect()}
    assert got == pytest.approx(want)
    jitter = mask.where("label <> 0").selectExpr("image_id", "label as ObjectNumber", "0 as iter").distinct().crossJoin(same)
    assert affine.warped(mask, jitter).count() == 40


def test_empty_mask(spark):
    m, p = _mask(spark, np.zeros((3, 3))), _pixels(spark, np.ones((3, 3)))
    assert cells.cell_intensities(p, m).count() == 0 and cells.boxes(m).count() == 0 and stencil.perimeter(m).count() == 0
