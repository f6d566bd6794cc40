"""Wide kernels, H with either p, the smoother's widths and the incomplete gamma against plain numpy."""

import math

import numpy as np
import pytest

from cellweave.operators import hotspot, scores, stencil
from cellweave.sources import images


def _pixels(spark, a):
    rows = [("i", "A", r, c, float(v)) for r, line in enumerate(a) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double")


def _plane(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def _sum(x, kernel):
    h, w = x.shape
    r, c = np.mgrid[0:h, 0:w]
    return sum(k * x[np.clip(r + a, 0, h - 1), np.clip(c + b, 0, w - 1)] for a, b, k in kernel)


KERNELS = [stencil.circular_kernel(2.5, weight="exp"), stencil.circular_kernel(3, centre=False, unit_sum=True), [(0, -2, 1.0), (1, 1, 0.5), (-3, 0, 2.0)]]


@pytest.mark.parametrize("kernel", KERNELS)
def test_kernel_sums_and_g(spark, kernel):
    x = np.random.default_rng(4).integers(0, 30, (7, 9)).astype(float)
    p, near, w1 = _pixels(spark, x), _sum(x, kernel), sum(k for *_, k in kernel)
    assert _plane(stencil.kernel_sum(p, kernel), "xns", x.shape) == pytest.approx(near)
    inner = 0 if any(a == b == 0 for a, b, _ in kernel) else 1
    n = x.size - inner
    m = (x.sum() - x * inner) / n
    spread = (((x * x).sum() - x * x * inner) / n - m * m) * (n * w1 - w1 * w1) / (n - 1)
    assert _plane(hotspot.g_classical(p, kernel=kernel), "g", x.shape) == pytest.approx((near - m * w1) / np.sqrt(spread))


def test_h_with_either_p(spark):
    x = np.random.default_rng(8).normal(size=(8, 8))
    p = _pixels(spark, x)
    chi, drawn = hotspot.h_statistic(p, 0), hotspot.h_statistic(p, 19)
    assert _plane(chi, "hz", x.shape) == pytest.approx(_plane(drawn, "hz", x.shape))
    assert _plane(drawn, "p", x.shape) == pytest.approx(_plane(hotspot.h_permutation(p, 19), "p", x.shape))


def test_incomplete_gamma():
    # whole a: exp(-x) * sum of x^k / k! below a
    for a in (1, 2, 7, 40):
        x = np.array([0.0, 0.3, a / 2, float(a), a + 0.9, a + 1.1, 3.0 * a + 5])
        want = [math.exp(-v) * sum(v**k / math.factorial(k) for k in range(a)) for v in x]
        assert hotspot._gammaincc(np.full(len(x), float(a)), x) == pytest.approx(want, abs=1e-12)
    odd = hotspot._gammaincc(np.array([np.nan, -1.0, 2.0, 2.0]), np.array([1.0, 1.0, -1.0, np.inf]))
    assert np.isnan(odd[:3]).all() and odd[3] == 0


def test_smoother_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    x, y = np.round(rng.gamma(2, 10, 300), 1), rng.random(300)  # ties among x
    xy = spark.createDataFrame([("i", "A", k, float(x[k]), float(y[k])) for k in range(300)], "image_id string, channel string, ObjectNumber int, x double, y double")
    d = np.abs(x[:, None] - x[None, :])
    q = np.quantile(x, 0.99)
    for minp in (0.01, 0.05):
        width = np.maximum(np.minimum(np.quantile(d, minp, axis=1), q / 10), q / 25)
        w = np.maximum(0, 1 - d / width[:, None])
        got = {r["ObjectNumber"]: r["ys"] for r in scores.smoothed(xy, minp=minp).collect()}
        assert [got[k] for k in range(300)] == pytest.approx((w @ y / w.sum(axis=1)).tolist())


def test_channels_and_metadata(spark):
    p = _pixels(spark, np.ones((2, 2)))
    assert images.chosen_channels(p, ["A"]).count() == 4
    with pytest.raises(ValueError, match="B"):
        images.chosen_channels(p, ["A", "B"])
    cells = spark.createDataFrame([("i", 1, "A"), ("i", 2, "A")], "image_id string, ObjectNumber int, channel string")
    info = spark.createDataFrame([("i", 2, "x"), ("i", 3, "y")], "image_id string, ObjectNumber int, kind string")
    assert [(r["ObjectNumber"], r["kind"]) for r in images.with_metadata(cells, info).collect()] == [(2, "x")]
