"""Stencils on dense grids: kernels, neighbourhood sums, disc sums, perimeters and closing.

Small stencils are two window passes (along rows, then along columns); a row or a column of one plane is the partition,
so partitions stay even however large an image is.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLANE = ["image_id", "channel"]
#: (drow, dcol, weight) of each offset
Kernel = list[tuple[int, int, float]]


def along_rows(keys: list[str]):
    return Window.partitionBy(*keys, "row").orderBy("col")


def along_cols(keys: list[str]):
    return Window.partitionBy(*keys, "col").orderBy("row")


def circular_kernel(distance: float, centre: bool = True, weight: str = "none", unit_sum: bool = False) -> Kernel:
    """All offsets within the distance; weight none (1) or exp (exp(-distance))."""
    r = math.floor(distance)
    at = [(a, b, math.hypot(a, b)) for a in range(-r, r + 1) for b in range(-r, r + 1) if math.hypot(a, b) <= distance and (centre or a or b)]
    w = [math.exp(-d) if weight == "exp" else 1.0 for _, _, d in at]
    total = sum(w) if unit_sum else 1.0
    return [(a, b, x / total) for (a, b, _), x in zip(at, w)]


def neighbourhood_sum(grid: DataFrame, value: str = "value", out: str = "xns", queen: bool = True, centre: bool = True, keys: list[str] = PLANE) -> DataFrame:
    """grid with the sum over the 8 (queen) or 4 neighbours, and the pixel itself if centre; edges repeat the border."""
    v, h = F.col(value), F.col("__h")
    rows, cols = along_rows(keys), along_cols(keys)
    three = lambda x, w: F.coalesce(F.lag(x).over(w), x) + x + F.coalesce(F.lead(x).over(w), x)
    g = grid.withColumn("__h", three(v, rows))
    total = three(h, cols) if queen else h + three(v, cols) - v
    return g.withColumn(out, total if centre else total - v).drop("__h")


def kernel_sum(grid: DataFrame, kernel: Kernel, value: str = "value", out: str = "xns", keys: list[str] = PLANE) -> DataFrame:
    """grid with the kernel-weighted sum; edges repeat the border.

    Each different line of the kernel is summed along the rows, then the lines are added along the columns: two window
    passes whatever the kernel, and rows are never multiplied. Cost goes with the number of offsets.
    """
    rows, cols = along_rows(keys), along_cols(keys)

    def shifted(x: str, by: int, w) -> Column:
        if by == 0:
            return F.col(x)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        step, border = (F.lead, F.last) if by > 0 else (F.lag, F.first)
        return F.coalesce(step(x, abs(by)).over(w), border(x).over(whole))

    lines = {a: tuple((b, w) for r, b, w in kernel if r == a) for a in sorted({r for r, _, _ in kernel})}
    names = {line: f"__line{i}" for i, line in enumerate(dict.fromkeys(lines.values()))}
    g = grid.withColumns({n: reduce(add, [w * shifted(value, b, rows) for b, w in line]) for line, n in names.items()})
    return g.withColumn(out, reduce(add, [shifted(names[line], a, cols) for a, line in lines.items()])).drop(*names.values())


def disc_totals(x: np.ndarray, r2: float) -> np.ndarray:
    """Sum of x over the disc around each element, in rows of running sums; what lies outside x counts as 0."""
    h, w = x.shape
    run = np.concatenate([np.zeros((h, 1)), np.cumsum(x, axis=1)], axis=1)
    out, cols = np.zeros(x.shape), np.arange(w)
    reach = int(np.floor(np.sqrt(r2)))
    for a in range(-min(reach, h - 1), min(reach, h - 1) + 1):
        b = int(np.floor(np.sqrt(r2 - a * a)))
        rows = run[max(a, 0) : h + min(a, 0)]
        out[max(-a, 0) : h + min(-a, 0)] += rows[:, np.minimum(cols + b, w - 1) + 1] - rows[:, np.maximum(cols - b, 0)]
    return out


def disc_sums(grid: DataFrame, values: dict[str, Column], radius: float, keys: list[str] = PLANE) -> DataFrame:
    """grid with, for each name, the sum of its expression over the pixels of the image within the radius.

    The grid is cut into tiles with a halo, so a group is bounded whatever the image's size; with tiles of four radii at
    least, 2.25 rows are shuffled for each pixel at most. Inside, a disc is one run of each of its rows, a difference of two
    running sums. NULL counts as 0.
    """
    r = math.floor(radius)
    side = max(64, 4 * r)
    near = lambda at: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - r) / side)), F.floor((F.col(at) + r) / side)))
    at = grid.withColumns({f"__{k}": v.cast("double") for k, v in values.items()}).withColumn("__tr", near("row")).withColumn("__tc", near("col"))

    columns, names = grid.columns, list(values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = row.min(), col.min()
        own = (row // side == pdf["__tr"].iloc[0]) & (col // side == pdf["__tc"].iloc[0])
        out = pdf.loc[own, columns].copy()
        for name in names:
            plane = np.zeros((np.ptp(row) + 1, np.ptp(col) + 1))
            plane[row - r0, col - c0] = np.nan_to_num(pdf[f"__{name}"].to_numpy(float))
            out[name] = disc_totals(plane, radius * radius)[row[own] - r0, col[own] - c0]
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema)
    return at.groupBy(*keys, "__tr", "__tc").applyInPandas(run, f"{fields}, " + ", ".join(f"`{name}` double" for name in values))


def perimeter(mask: DataFrame) -> DataFrame:
    """Cells' pixels with is_edge: fewer than four rook neighbours with the same label; outside the image counts as other."""
    rows, cols = along_rows(["image_id"]), along_cols(["image_id"])

    def same(step, w, at: str) -> Column:
        near = step(at).over(w)
        return F.coalesce((step("label").over(w) == F.col("label")) & (F.abs(near - F.col(at)) == 1), F.lit(False)).cast("int")

    g = mask.withColumn("__n", same(F.lag, rows, "col") + same(F.lead, rows, "col"))
    g = g.withColumn("__n", F.col("__n") + same(F.lag, cols, "row") + same(F.lead, cols, "row"))
    return g.where("label <> 0").withColumn("is_edge", F.col("__n") < 4).drop("__n")


def closing(mask: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """3 x 3 closing of a dense label image: a maximum, then a minimum; outside the image counts for nothing."""
    rows, cols = along_rows(keys).rowsBetween(-1, 1), along_cols(keys).rowsBetween(-1, 1)
    g = mask
    for f in (F.max, F.min):
        g = g.withColumn("label", f("label").over(rows)).withColumn("label", f("label").over(cols))
    return g
