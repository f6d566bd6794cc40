"""Affine jitter of cells of any shape and place against a plain version of its definition."""

import math

import numpy as np
import pytest

from cellweave.operators import affine

NAMES = "tx double, ty double, rot double, sx double, sy double, shx double, shy double"
TURNED = [(1.0, -1.0, math.pi / 12, 1.2, 1.2, 0.1, -0.1), (-1.0, 0.5, -math.pi / 12, 0.8, 1.15, -0.1, 0.1), (0.0, 0.0, 0.0, 1.2, 0.8, 0.0, 0.0), (0.3, 0.2, 0.1, 1.0, 1.0, 0.05, 0.0)]
CELLS = {"wide": (40, 60, 20, 60), "tall": (64, 70, 60, 20), "thin": (62, 90, 100, 12), "corner": (0, 3, 60, 20), "border": (60, 1, 50, 90), "far": (209, 120, 21, 40)}
H, W = 230, 200


def _plane(cell):
    r, c, h, w = cell
    m = np.zeros((H, W), int)
    m[r : r + h, c : c + w] = 1
    m[r, c] = m[r + h // 3 : r + h // 2, c + w // 4 : c + w // 3] = 0  # a hole and a missing corner
    return m


def _matrix(t):
    tx, ty, rot, sx, sy, shx, shy = t
    co, si = math.cos(rot), math.sin(rot)
    return np.array([[co, -si], [si, co]]) @ np.array([[1, shx], [shy, 1]]) @ np.array([[sx, 0], [0, sy]]), np.array([tx, ty])


def _pad(h, w, transforms):
    c, most = np.array([(w - 1) / 2, (h - 1) / 2]), 0.0
    for t in transforms:
        a, shift = _matrix(t)
        for p in ((0, 0), (0, w), (h, 0), (h, w)):
            x, y = a @ (np.array(p) - c) + c + shift
            most = max(most, -x, x - h, -y, y - w)
    return math.ceil(round(most, 9)) + 1


def _warp(m, t, pad, less, clip):
    """The definition in the window of the padded box; `clip` says whether the window's own edge cuts."""
    rows, cols = np.nonzero(m)
    r0, r1, c0, c1 = rows.min(), rows.max() + 1, cols.min(), cols.max() + 1
    wr, wc = max(r0 - pad, 0), max(c0 - pad, 0)
    c = np.array([(r1 - r0 - less) / 2 + r0 - wr, (c1 - c0 - less) / 2 + c0 - wc])
    a, shift = _matrix(t)
    back, own = np.linalg.inv(a), np.pad(m, 400)
    q, r = np.meshgrid(np.arange(W), np.arange(H))
    x, y = np.einsum("ij,jrq->irq", back, np.stack([q - wc - c[0] - shift[0], r - wr - c[1] - shift[1]])) + c[:, None, None] + np.array([wc, wr])[:, None, None]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    weight = sum(own[y0 + i + 400, x0 + j + 400] * (1 - abs(y - y0 - i)) * (1 - abs(x - x0 - j)) for i in (0, 1) for j in (0, 1))
    inside = (r >= r0 - pad) & (r < r1 + pad) & (q >= c0 - pad) & (q < c1 + pad)
    return (weight >= 0.5 - 1e-9) & (inside if clip else True)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(n, r, c, int(v)) for n, cell in CELLS.items() for (r, c), v in np.ndenumerate(_plane(cell))]
    return spark.createDataFrame(rows, "image_id string, row int, col int, label int").repartition(8).cache()


def _jitter(spark, table):
    t = spark.createDataFrame([(i, *t) for i, t in enumerate(TURNED)], f"iter int, {NAMES}")
    return table.where("label <> 0").selectExpr("image_id", "label as ObjectNumber").distinct().crossJoin(t)


def _rows(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["image_id"], r["iter"]), set()).add((r["row"], r["col"]))
    return out


@pytest.mark.parametrize("pad", [None, 60, 4])
def test_cells_of_any_shape_and_place(spark, table, pad):
    grid = [tuple(r[n] for n in affine.RANGES) for r in affine.transform_grid(spark, 2).collect()]
    got = _rows(affine.warped(table, _jitter(spark, table), pad))
    for name, cell in CELLS.items():
        for i, t in enumerate(TURNED[:2] if pad else TURNED):
            want = _warp(_plane(cell), t, pad or _pad(*cell[2:], grid), 0, pad is not None)
            assert got.get((name, i), set()) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)))), (name, i)


def test_elongated_cells_equal_a_wide_pad(spark, table):
    """Windows come from the transforms: cells away from the border lose nothing."""
    inner = table.where("image_id in ('tall', 'thin')")
    exact, wide = (_rows(affine.warped(inner, _jitter(spark, inner), p)) for p in (None, 60))
    assert exact == wide and len(exact) == 8


def test_pad_of_the_definition(spark, table):
    pads = {r["image_id"]: r["pad"] for r in affine.padding(table, affine.transform_grid(spark, 2)).collect()}
    grid = [tuple(r[n] for n in affine.RANGES) for r in affine.transform_grid(spark, 2).collect()]
    assert pads == {n: _pad(*cell[2:], grid) for n, cell in CELLS.items()}


def test_direct_medians_of_any_shape_and_place(spark, table):
    turned = spark.createDataFrame(TURNED, NAMES)
    pixels = table.selectExpr("image_id", "'A' as channel", "row", "col", "cast(row * row + 3 * col as double) as value")
    got = {r["image_id"]: r["median"] for r in affine.direct_affine_medians(pixels, table, turned).collect()}
    r, c = np.mgrid[0:H, 0:W]
    for name, cell in CELLS.items():
        pad = _pad(*cell[2:], TURNED)
        means = [(r * r + 3 * c)[_warp(_plane(cell), t, pad, 1, False) == 1].mean() for t in TURNED]
        assert got[name] == pytest.approx(np.median(means)), name
