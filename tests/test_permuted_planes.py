"""Keyed shuffles: permutations and draws by themselves, tests against brute force, tiles against whole planes."""

import numpy as np
import pytest

from cellweave.functions.keyed import draw, key, permuted
from cellweave.operators import hotspot

SEED, N_ITER = 42, 12


def _frame(spark, planes):
    rows = [("i", n, r, c, float(v)) for n, x in planes.items() for (r, c), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double")


def _near(x, queen):
    p = np.pad(x, 1, mode="edge")
    h, w = x.shape
    return sum(p[a : a + h, b : b + w] for a in range(3) for b in range(3) if (a, b) != (1, 1) and (queen or 1 in (a, b)))


def _shuffles(x, channel, tag):
    for b in range(N_ITER):
        s = np.empty(x.size)
        for i in range(x.size):
            s[permuted(key(SEED, "i", channel, tag, b), np.array([i]), x.size)[0]] = x.ravel()[i]
        yield s.reshape(x.shape)


def _p(gi, gps):
    hit = [sum(f(g, gi) for g in gps) for f in (lambda g, o: np.abs(g) > np.abs(o), lambda g, o: g < o, lambda g, o: g > o)]
    return [(1 + h) / (1 + len(gps)) for h in hit]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 144, 1000, 65537])
def test_permutations_and_draws(n):
    for k in (key(1, "a"), key(2, "a")):
        assert np.array_equal(np.sort(permuted(k, np.arange(n), n)), np.arange(n))
    if n > 100:
        assert not np.array_equal(permuted(key(1, "a"), np.arange(n), n), permuted(key(2, "a"), np.arange(n), n))
        seen = draw(key(3), np.arange(200 * 50), 50)
        assert seen.min() == 0 and seen.max() == 49 and np.bincount(seen).std() < 40


def test_permuted_places_are_even():
    """Over many keys every place gets every value about as often, and neighbours part."""
    got = np.array([permuted(key(b, "even"), np.arange(9), 9) for b in range(3000)])
    counts = np.array([np.bincount(got[:, i], minlength=9) for i in range(9)])
    assert abs(counts - 3000 / 9).max() < 85
    assert abs(np.mean(np.abs(got[:, 0] - got[:, 1]) == 1) - 2 / 9) < 0.03


@pytest.mark.parametrize("queen,centre", [(True, True), (False, False)])
def test_g_and_drawn_neighbours_against_brute_force(spark, queen, centre):
    planes = {c: np.random.default_rng(k).integers(0, 9, (12, 12)).astype(float) for k, c in enumerate("AB")}
    pixels = _frame(spark, planes)
    for whole_image in (True, False):
        got = [hotspot.g_permutation(pixels, N_ITER, queen, centre, whole_image, block=5, whole=w).collect() for w in (hotspot.WHOLE, 0)]
        for rows in got:
            assert len(rows) == 288
            for channel, x in planes.items():
                mid, k = (x if centre else 0), 8 if queen else 4
                gi = (_near(x, queen) + mid) / (x.sum() if centre else x.sum() - x)
                if whole_image:
                    gps = [(mid + _near(s, queen)) / (x.sum() - x) for s in _shuffles(x, channel, "g")]
                else:
                    place = np.arange(144)[:, None] * k + np.arange(k)
                    gps = [(mid + x.ravel()[draw(key(SEED, "i", channel, "drawn", b), place, 144)].sum(axis=1).reshape(x.shape)) / (x.sum() - x) for b in range(N_ITER)]
                want = _p(gi, gps)
                for r in (r for r in rows if r["channel"] == channel):
                    at = r["row"], r["col"]
                    assert r["g"] == pytest.approx(gi[at]) and [r["p_both"], r["p_cold"], r["p_hot"]] == pytest.approx([p[at] for p in want])


def test_h_against_brute_force(spark):
    x = np.random.default_rng(3).random((12, 12)) * 9
    wide = _frame(spark, {"A": x})
    residual = lambda v: v - (_near(v, True) + v) / 9
    local = lambda e: (_near(e * e, True) + e * e) / ((e * e).mean() * 9)
    h, more = local(residual(x)), np.zeros((12, 12))
    for s in _shuffles(x, "A", "h"):
        mean = (residual(s) ** 2).mean()
        for at in np.ndindex(12, 12):
            back = s.copy()
            back[at] = x[at]
            if 0 < min(at) and max(at) < 11:  # at the border the put-back value counts more than once, which the definition's short form leaves out
                e = residual(back)
                more[at] += (_near(e * e, True) + e * e)[at] / (mean * 9) > h[at]
    for whole in (hotspot.WHOLE, 0):
        for r in hotspot.h_permutation(wide, N_ITER, block=5, whole=whole).collect():
            at = r["row"], r["col"]
            assert r["h"] == pytest.approx(h[at])
            if 1 < min(at) and max(at) < 10:
                assert r["p"] == pytest.approx((1 + more[at]) / (1 + N_ITER))


def test_tiles_equal_whole_planes(spark):
    """A plane of several tiles, cut and whole."""
    x = np.random.default_rng(5).integers(0, 50, (300, 270)).astype(float)
    pixels = _frame(spark, {"A": x}).repartition(8).cache()
    for f in (lambda w: hotspot.g_permutation(pixels, 3, block=2, whole=w), lambda w: hotspot.h_permutation(pixels, 3, block=2, whole=w)):
        cut, whole = ({(r["row"], r["col"]): r for r in f(w).collect()} for w in (0, hotspot.WHOLE))
        assert len(cut) == len(whole) == x.size
        for k, r in whole.items():
            assert all(v == pytest.approx(cut[k][c]) for c, v in r.asDict().items() if isinstance(v, float))
