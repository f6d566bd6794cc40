"""Targets of a cell by corner codes are those of all bilinear weights, and few weights are made."""

import numpy as np
import pytest

from cellweave.operators import affine


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (8, 8)])
def test_same_targets(shape):
    rng = np.random.default_rng(3)
    own = np.pad((rng.random(shape) < 0.7).astype(float), 1)
    own[1, 1] = 1
    n, side = 400, 20
    p = np.stack([rng.uniform(*affine.RANGES[k], n) for k in affine.RANGES], axis=1)
    p[0] = [0, 0, 0, 1, 1, 0, 0]
    p[1] = [0.5, 0, 0, 1, 1, 0, 0]
    a, b, d, e = (m[:, None, None] for m in affine._linear(p))
    dx, dy, det = np.arange(side) - 9.5 - p[:, 0, None, None], np.arange(side)[:, None] - 9.0 - p[:, 1, None, None], a * e - b * d
    x, y = (e * dx - b * dy) / det + 2.5, (a * dy - d * dx) / det + 3
    want = affine._inside(own, x, y)
    got = affine._inside_of(affine._corner_codes(own), x, y)
    assert want.any() and (got == want).all()
