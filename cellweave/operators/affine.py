"""Affine jitter: transforms, randomly warped masks, and medians that are robust to small shifts of the mask."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.sources.images import PIXEL
from cellweave.sources.lineage import cut

CELL = ["image_id", "ObjectNumber"]
#: (low, high) of each parameter: shifts in pixels, rotation in radians, scales and shears.
RANGES = {"tx": (-1.0, 1.0), "ty": (-1.0, 1.0), "rot": (-math.pi / 12, math.pi / 12), "sx": (0.8, 1.2), "sy": (0.8, 1.2), "shx": (-0.1, 0.1), "shy": (-0.1, 0.1)}


def transform_grid(spark: SparkSession, steps: int = 3, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """(transform_id, tx .. shy): steps^7 transforms, ids as numbers with one digit for each parameter."""
    names = list(ranges)
    g = spark.range(steps ** len(names)).withColumnRenamed("id", "transform_id")
    for i, n in enumerate(names):
        lo, hi = ranges[n]
        digit = F.expr(f"transform_id div {steps ** (len(names) - 1 - i)}") % steps
        g = g.withColumn(n, F.lit(lo) + digit * ((hi - lo) / max(steps - 1, 1)) if steps > 1 else F.lit((lo + hi) / 2))
    return g


def _hashed(*parts: Column | str) -> Column:
    """Hex md5 of the parts as text, joined by bars."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def random_transforms(ids: DataFrame, seed: int = 42, normal: bool = False, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """ids with random tx .. shy: uniform, or normal about the middle with a quarter of the range as sd.

    Numbers are hashes of the row's own columns and the seed, so they do not depend on how rows are partitioned, and any
    engine with md5 makes the same.
    """

    def unit(name: str) -> Column:
        return (F.conv(F.substring(_hashed(*ids.columns, F.lit(f"{seed}:{name}")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    out = {}
    for n, (lo, hi) in ranges.items():
        z = F.sqrt(-2 * F.log(unit(n))) * F.cos(2 * math.pi * unit(n + "'"))
        out[n] = F.lit((lo + hi) / 2) + z * ((hi - lo) / 4) if normal else F.lit(lo) + unit(n) * (hi - lo)
    return ids.withColumns(out)


def with_matrix(transforms: DataFrame, cx: Column | float = 0.0, cy: Column | float = 0.0) -> DataFrame:
    """transforms with m00 .. m12: A = rotation x shear x scale, and the offset c - A c + t that keeps the centre c."""
    cx, cy = (c if isinstance(c, Column) else F.lit(float(c)) for c in (cx, cy))
    co, si = F.cos("rot"), F.sin("rot")
    a, b = F.col("sx"), F.col("shx") * F.col("sy")
    c, d = F.col("shy") * F.col("sx"), F.col("sy")
    m = {"m00": co * a - si * c, "m01": co * b - si * d, "m10": si * a + co * c, "m11": si * b + co * d}
    out = transforms.withColumns(m)
    return out.withColumns({"m02": cx - (F.col("m00") * cx + F.col("m01") * cy) + F.col("tx"), "m12": cy - (F.col("m10") * cx + F.col("m11") * cy) + F.col("ty")})


def _measured(mask: DataFrame) -> DataFrame:
    """(image_id, label, r0, c0, r1, c1, area) of all labels, background included: one pass over the mask, a row for each cell."""
    ends = {"r0": F.min("row"), "c0": F.min("col"), "r1": F.max("row") + 1, "c1": F.max("col") + 1, "area": F.count(F.lit(1))}
    return mask.groupBy("image_id", "label").agg(*[v.alias(k) for k, v in ends.items()])


def largest_cells(mask: DataFrame, share: float = 0.1) -> DataFrame:
    """Boxes of the cells in the top share of an image by height and by width and by area; all where there are fewer than 10."""
    return _largest(_measured(mask), share)


def _largest(measured: DataFrame, share: float) -> DataFrame:
    b = measured.where("label <> 0").select("image_id", F.col("label").alias("ObjectNumber"), (F.col("r1") - F.col("r0")).alias("height"), (F.col("c1") - F.col("c0")).alias("width"), "area")
    w = Window.partitionBy("image_id")
    for c in ("height", "width", "area"):
        b = b.withColumn(f"rank_{c}", F.row_number().over(w.orderBy(F.col(c).desc(), "ObjectNumber")))
    b = b.withColumn("n", F.count(F.lit(1)).over(w))
    top = [F.col(f"rank_{c}") <= F.floor(F.col("n") * share) for c in ("height", "width", "area")]
    return b.where((F.col("n") < 10) | (top[0] & top[1] & top[2])).select(*CELL, "height", "width", "area")


def _linear(params: np.ndarray) -> tuple[np.ndarray, ...]:
    """(m00, m01, m10, m11) of transforms tx .. shy, one in each row."""
    _, _, rot, sx, sy, shx, shy = params.T
    co, si = np.cos(rot), np.sin(rot)
    return co * sx - si * shy * sx, co * shx * sy - si * sy, si * sx + co * shy * sx, si * shx * sy + co * sy


def _corners(params: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(least x, greatest x, least y, greatest y) that boxes reach under any of the transforms about their centres."""
    a, b, d, e = (m[:, None] for m in _linear(params))
    tx, ty = params[:, 0, None], params[:, 1, None]
    xs, ys = zip(*[(cx + tx + a * (i - cx) + b * (j - cy), cy + ty + d * (i - cx) + e * (j - cy)) for i in x for j in y])
    return np.min(xs, axis=(0, 1)), np.max(xs, axis=(0, 1)), np.min(ys, axis=(0, 1)), np.max(ys, axis=(0, 1))


def _listed(transforms: DataFrame) -> np.ndarray:
    """A bounded table of transforms as rows of numbers, which travel with the tasks."""
    return np.array([[float(r[n]) for n in RANGES] for r in transforms.select(*RANGES).collect()]).reshape(-1, len(RANGES))


def padding(mask: DataFrame, transforms: DataFrame) -> DataFrame:
    """(image_id, pad): how far the corners of large cells' boxes get under any of the transforms, rounded up, + 1.

    As the definition has it, corners are (row, column) used as (x, y) while the centre is ((width - 1) / 2, (height - 1)
    / 2); so pads of elongated cells are wide. Without a cell large in all three ways the pad is 1. The transforms are a
    bounded table.
    """
    return _pads(_measured(mask), transforms)


def _pads(measured: DataFrame, transforms: DataFrame) -> DataFrame:
    params = _listed(transforms)
    big = _largest(measured, 0.1).select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, w = pdf["height"].to_numpy(float), pdf["width"].to_numpy(float)
            low_x, high_x, low_y, high_y = _corners(params, (0 * h, h), (0 * w, w), (w - 1) / 2, (h - 1) / 2)
            most = np.max([-low_x, high_x - h, -low_y, high_y - w, 0 * h], axis=0)
            yield pd.DataFrame({"image_id": pdf["image_id"], "pad": np.ceil(np.round(most, 9)).astype(int) + 1})

    pads = big.mapInPandas(run, "image_id string, pad int").groupBy("image_id").agg(F.max("pad").alias("pad")) if len(params) else None
    images = measured.select("image_id").distinct()
    return images.withColumn("pad", F.lit(1)) if pads is None else images.join(pads, "image_id", "left").fillna(1, ["pad"])


def chosen_transforms(spark: SparkSession, n_iter: int = -1, sample_fraction: float = 1.0, steps: int = 3, seed: int = 42, normal: bool = False, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """(transform_id, tx .. shy): n_iter random transforms, or all of the grid if it is negative; of these a fraction, rounded down.

    The fraction keeps the transforms with the smallest hashes of their number.
    """
    made = transform_grid(spark, steps, ranges) if n_iter < 0 else random_transforms(spark.range(n_iter).withColumnRenamed("id", "transform_id"), seed, normal, ranges)
    if sample_fraction >= 1:
        return made
    return made.orderBy(F.xxhash64("transform_id", F.lit(seed))).limit(int((steps ** len(ranges) if n_iter < 0 else n_iter) * sample_fraction))


def _centred(mask: DataFrame, pad: int | None, transforms: DataFrame | None, swapped: bool, less: int) -> DataFrame:
    """(image_id, ObjectNumber, r0 .. c1, the centre cx, cy of transforms, and lr .. hc, the pixels that may be painted).

    The centre of a box is ((height - less) / 2, (width - less) / 2) from the corner of its padded window, plus the margins
    that the image leaves to the box, in the order (row, column) used as (x, y) when swapped: where a cell is nearer to the
    border than the pad, margins differ and so the swapped centre moves. Without a pad that of the image under the transforms
    counts for the centre alone, and whatever a transform reaches inside the image may be painted; a given pad clips.
    """
    measured = cut(_measured(mask))  # boxes, image sizes and pads read it
    b = measured.where("label <> 0").withColumnRenamed("label", "ObjectNumber").join(measured.groupBy("image_id").agg(F.max("r1").alias("rows"), F.max("c1").alias("cols")), "image_id")
    if pad is None:
        b = b.join(_pads(measured, transform_grid(mask.sparkSession, 2) if transforms is None else transforms), "image_id")
    else:
        b = b.withColumn("pad", F.lit(pad))
    h, w, top, left = F.col("r1") - F.col("r0") - less, F.col("c1") - F.col("c0") - less, F.least("r0", "pad"), F.least("c0", "pad")
    x, y = (h / 2 + top - left, w / 2 + left - top) if swapped else (w / 2, h / 2)
    box = [F.lit(0), F.lit(0), F.col("rows"), F.col("cols")]
    if pad is not None:
        box = [F.greatest(F.lit(0), F.col("r0") - pad), F.greatest(F.lit(0), F.col("c0") - pad), F.least("rows", F.col("r1") + pad), F.least("cols", F.col("c1") + pad)]
    return b.select(*CELL, "r0", "c0", "r1", "c1", (F.col("c0") + x).alias("cx"), (F.col("r0") + y).alias("cy"), *[c.cast("int").alias(n) for c, n in zip(box, ("lr", "lc", "hr", "hc"))], "rows", "cols")


TILE = 64  # side of the tiles in which cells are painted
BATCH = 1 << 15  # places that are looked up at once: what is made for each stays in a core's cache
HALF = 0.5 - 1e-9  # a weight of a half counts, whatever the rounding of its terms


def _inside(own: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the bilinear weight of own (a plane with a border of zeros, whose first inner pixel is 0, 0) is a half or more."""
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = x - x0, y - y0
    r, c = np.clip(y0.astype(int) + 1, 0, own.shape[0] - 2), np.clip(x0.astype(int) + 1, 0, own.shape[1] - 2)
    reach = (x > -1) & (y > -1) & (x < own.shape[1] - 2) & (y < own.shape[0] - 2)
    weight = (1 - fy) * ((1 - fx) * own[r, c] + fx * own[r, c + 1]) + fy * ((1 - fx) * own[r + 1, c] + fx * own[r + 1, c + 1])
    return reach & (weight >= HALF)


def _corner_codes(own: np.ndarray) -> np.ndarray:
    """Which of the four pixels around a place are the cell's, a bit for each, by its upper left pixel in own (0 beyond it)."""
    on = np.pad(own > 0, ((1, 2), (1, 2))).astype(np.uint8)
    return on[:-1, :-1] | on[:-1, 1:] << 1 | on[1:, :-1] << 2 | on[1:, 1:] << 3


def _inside_of(codes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As _inside, from _corner_codes: places with none or all four of them need no weight."""
    h, w = codes.shape
    x0, y0 = np.floor(x), np.floor(y)
    place = np.clip(y0 + 2, 0, h - 1) * w + np.clip(x0 + 2, 0, w - 1)
    code = codes.ravel().take(place.astype(np.int32))
    inside = code == 15
    at = np.flatnonzero((code > 0) & ~inside)
    some, fx, fy = code.ravel()[at], (x - x0).ravel()[at], (y - y0).ravel()[at]
    on = [(some >> k & 1).astype(float) for k in range(4)]
    weight = (1 - fy) * ((1 - fx) * on[0] + fx * on[1]) + fy * ((1 - fx) * on[2] + fx * on[3])
    inside.ravel()[at] = weight >= HALF
    return inside


def _target(own: np.ndarray, m: np.ndarray, lr: int, lc: int, hr: int, hc: int) -> tuple[np.ndarray, int, int]:
    """Target (transforms, rows, columns) in a window, with its first row and column, of a cell's pixels (row in the upper 32 bits) under each row of m."""
    m00, m01, m02, m10, m11, m12 = m.T[:, :, None, None]
    r, c = own >> 32, own & 0xFFFFFFFF
    r0, c0, r1, c1 = r.min(), c.min(), r.max(), c.max()
    # the target of these pixels' box and one pixel around it
    edge_x, edge_y = np.array([c0 - 1, c1 + 1]), np.array([[r0 - 1], [r1 + 1]])
    to_x, to_y = m00 * edge_x + m01 * edge_y + m02, m10 * edge_x + m11 * edge_y + m12
    top, left = max(lr, math.floor(to_y.min())), max(lc, math.floor(to_x.min()))
    below, right = max(top, min(hr, math.ceil(to_y.max()) + 1)), max(left, min(hc, math.ceil(to_x.max()) + 1))
    plane = np.zeros((r1 - r0 + 3, c1 - c0 + 3))
    plane[r - r0 + 1, c - c0 + 1] = 1
    dx, dy, det = np.arange(left, right) - m02, np.arange(top, below)[:, None] - m12, m00 * m11 - m01 * m10
    return _inside(plane, (m11 * dx - m01 * dy) / det - c0, (m00 * dy - m10 * dx) / det - r0), top, left


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Target pixels of one cell, transform and tile in each row."""
    for batch in batches:
        col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*_M, "tr", "tc", *_LIMITS)}
        lists = batch.column("own")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        which, rows, cols = [], [], []
        for k in range(batch.num_rows):
            *m, tr, tc, lr, lc, hr, hc = (v[k] for v in col.values())
            inside, top, left = _target(flat[ends[k] : ends[k + 1]], np.array([m]), max(lr, tr * TILE), max(lc, tc * TILE), min(hr, tr * TILE + TILE), min(hc, tc * TILE + TILE))
            r, c = np.nonzero(inside[0])
            which.append(np.full(len(r), k))
            rows.append(r + top)
            cols.append(c + left)
        if which:
            at = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in ("image_id", "iter", "ObjectNumber")], pa.array(np.concatenate(rows).astype(np.int32)), pa.array(np.concatenate(cols).astype(np.int32))], names=["image_id", "iter", "ObjectNumber", "row", "col"])


_M = ["m00", "m01", "m02", "m10", "m11", "m12"]
_LIMITS = ["lr", "lc", "hr", "hc"]


def _reached(mask: DataFrame, jitter: DataFrame, pad: int | None, swapped_centre: bool, halo: int = 0) -> DataFrame:
    """Tiles of cells (their pixels as `own`) with matrix and limits, a row for each target tile they reach or come within the halo of."""
    cells = mask.where("label <> 0").withColumnRenamed("label", "ObjectNumber")
    pieces = cells.groupBy(*CELL, F.expr(f"row div {TILE}"), F.expr(f"col div {TILE}")).agg(
        F.collect_list(F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")).alias("own"), (F.min("row") - 1).alias("y0"), (F.max("row") + 1).alias("y1"), (F.min("col") - 1).alias("x0"), (F.max("col") + 1).alias("x1")
    ).select(*CELL, "own", "y0", "y1", "x0", "x1")
    at = with_matrix(jitter.join(_centred(mask, pad, None, swapped_centre, 0), CELL), F.col("cx"), F.col("cy"))
    at = at.select(*CELL, "iter", *_M, *_LIMITS, "rows", "cols").join(pieces, CELL)
    to = lambda a, b, o: [F.col(a) * F.col(x) + F.col(b) * F.col(y) + F.col(o) for x in ("x0", "x1") for y in ("y0", "y1")]
    tiles = lambda ends, low, high: F.sequence(F.floor((F.greatest(low, F.least(*ends)) - halo) / TILE).cast("int"), F.floor((F.least(high, F.greatest(*ends)) + halo) / TILE).cast("int"))
    x, y = to("m00", "m01", "m02"), to("m10", "m11", "m12")
    seen = (F.greatest(*y) >= F.col("lr")) & (F.least(*y) <= F.col("hr") - 1) & (F.greatest(*x) >= F.col("lc")) & (F.least(*x) <= F.col("hc") - 1)
    return at.where(seen).withColumn("tr", F.explode(tiles(y, F.col("lr"), F.col("hr") - 1))).withColumn("tc", F.explode(tiles(x, F.col("lc"), F.col("hc") - 1)))


def _kinds(mask: DataFrame, jitter: DataFrame) -> str:
    return f"image_id {mask.schema['image_id'].dataType.simpleString()}, iter {jitter.schema['iter'].dataType.simpleString()}, ObjectNumber {mask.schema['label'].dataType.simpleString()}"


def warped(mask: DataFrame, jitter: DataFrame, pad: int | None = None, swapped_centre: bool = True) -> DataFrame:
    """(image_id, iter, ObjectNumber, row, col): each cell's pixels after its own transform in each iteration.

    jitter: (image_id, ObjectNumber, iter, tx .. shy). A target pixel belongs to the cell if the bilinear weight of the
    cell's own pixels at its source is at least a half. For centre and pad see `_centred`. Cells are cut into tiles; each
    tile goes to the target tiles that its box reaches under the transform, where one task paints it, so memory follows
    the tile and not the cell.
    """
    met = _reached(mask, jitter, pad, swapped_centre).groupBy(*CELL, "iter", "tr", "tc").agg(F.flatten(F.collect_list("own")).alias("own"), *[F.first(c).alias(c) for c in (*_M, *_LIMITS)])
    return met.mapInArrow(_painted, f"{_kinds(mask, jitter)}, row int, col int")


BLOCK = 16  # iterations of a tile that one group holds
HALO = 2  # how far a closing sees


def _closed(x: np.ndarray) -> np.ndarray:
    """`stencil.closing` of the last two axes."""
    ends = np.iinfo(x.dtype)
    for f, beyond in ((np.maximum, ends.min), (np.minimum, ends.max)):
        p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)], constant_values=beyond)
        p = f(f(p[..., :-2, :], p[..., 1:-1, :]), p[..., 2:, :])
        x = f(f(p[..., :-2], p[..., 1:-1]), p[..., 2:])
    return x


def _in_masks(mask: DataFrame, places: DataFrame, n_iter: int, seed: int, pad: int | None, work, schema: str, swapped_centre: bool = True) -> DataFrame:
    """What work(places of a tile, iterations, their labels there (iterations, places)) makes of random masks.

    places: image_id, row, col and any more. A group holds a tile with what its closing sees, for a block of iterations: all
    cells that reach it are painted in random order (the later wins), then it is closed, so no pixel of a mask is shuffled.
    The groups are dealt out to as many tasks as a shuffle has, however few bytes they are.
    """
    cells = mask.where("label <> 0").select("image_id", F.col("label").alias("ObjectNumber")).distinct()
    jitter = random_transforms(cells.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))), seed)
    keys = ["image_id", "block", "tr", "tc"]
    tasks = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    painted = _reached(mask, jitter, pad, swapped_centre, HALO).withColumn("block", F.expr(f"int(iter div {BLOCK})")).withColumn("order", _hashed("image_id", "iter", "ObjectNumber", F.lit(f"{seed}:paint")))
    painted = painted.select(*keys, "iter", "order", "ObjectNumber", *_M, *_LIMITS, "rows", "cols", "own").repartition(tasks, *keys)
    tile = lambda at: F.expr(f"int({at} div {TILE})")
    at = places.select(*[F.col(c).alias(c) for c in places.columns], tile("row").alias("tr"), tile("col").alias("tc")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_iter - 1) // BLOCK)))).repartition(tasks, *keys)

    def run(key: tuple, cells: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        _, block, tr, tc = key
        steps = np.arange(block * BLOCK, min(n_iter, (block + 1) * BLOCK))
        if not len(own) or not len(cells):
            return work(own, steps, np.zeros((len(steps), len(own)), np.int64))
        rows, cols = int(cells["rows"].iloc[0]), int(cells["cols"].iloc[0])
        top, left, below, right = max(tr * TILE - HALO, 0), max(tc * TILE - HALO, 0), min(tr * TILE + TILE + HALO, rows), min(tc * TILE + TILE + HALO, cols)
        own = own[(own["row"] < rows) & (own["col"] < cols)]
        cells = cells.sort_values("ObjectNumber")
        b, label, parts = cells["iter"].to_numpy() - steps[0], cells["ObjectNumber"].to_numpy(), cells["own"].to_numpy()
        m, limits = cells[_M].to_numpy(), cells[_LIMITS].to_numpy().tolist()
        order = np.lexsort((label, cells["order"].to_numpy(str)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        best = np.zeros((len(steps), max(below - top, 0), max(right - left, 0)), np.int64)
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(b)]):  # a cell in all of its iterations, all of its tiles that come here
            of, first = np.unique(b[lo:hi], return_index=True)
            lr, lc, hr, hc = limits[lo]
            inside, r, c = _target(np.concatenate(parts[lo:hi]), m[lo + first], max(lr, top), max(lc, left), min(hr, below), min(hc, right))
            seen = of[:, None, None], np.arange(r - top, r - top + inside.shape[1])[:, None], np.arange(c - left, c - left + inside.shape[2])
            best[seen] = np.maximum(best[seen], inside * rank[lo + first][:, None, None])
        labels = np.r_[0, label[order]][best]
        return work(own, steps, _closed(labels)[:, own["row"].to_numpy() - top, own["col"].to_numpy() - left])

    return painted.groupBy(*keys).cogroup(at.groupBy(*keys)).applyInPandas(run, schema)


def random_masks(mask: DataFrame, n_iter: int, seed: int = 42, pad: int | None = None, **options) -> DataFrame:
    """(image_id, iter, row, col, label), dense: all cells warped and painted in random order (the later wins), then closed."""

    def work(own: pd.DataFrame, steps: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
        n = len(steps)
        return pd.DataFrame({"image_id": np.tile(own["image_id"].to_numpy(), n), "iter": np.repeat(steps, len(own)), "row": np.tile(own["row"].to_numpy(), n), "col": np.tile(own["col"].to_numpy(), n), "label": labels.ravel()})

    kinds = {f.name: f.dataType.simpleString() for f in mask.schema}
    return _in_masks(mask, mask.select(*PIXEL), n_iter, seed, pad, work, f"image_id {kinds['image_id']}, iter int, row {kinds['row']}, col {kinds['col']}, label {kinds['label']}", **options)


def _medians(means: DataFrame, mask: DataFrame, pixels: DataFrame) -> DataFrame:
    area = mask.where("label <> 0").groupBy("image_id", F.col("label").alias("ObjectNumber")).agg(F.count(F.lit(1)).alias("area"))
    rows = area.join(pixels.select("image_id", "channel").distinct(), "image_id")
    return rows.join(means.groupBy(*CELL, "channel").agg(F.median("mean").alias("median")), [*CELL, "channel"], "left")


def affine_medians(pixels: DataFrame, mask: DataFrame, n_iter: int = 10, seed: int = 42, pad: int | None = None, **options) -> DataFrame:
    """(image_id, ObjectNumber, area, channel, median): the median over random masks of each cell's mean.

    A cell that vanishes from a mask is skipped there; NULL where it vanishes from all.
    """

    def work(own: pd.DataFrame, steps: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
        names, channel = np.unique(own["channel"].to_numpy(str), return_inverse=True)
        b, at = np.nonzero(labels)
        some, which = np.unique(labels[b, at], return_inverse=True)
        place = (b * len(some) + which) * len(names) + channel[at]
        n = np.bincount(place, minlength=len(steps) * len(some) * len(names))
        total = np.bincount(place, own["value"].to_numpy(float)[at], len(n))
        met = np.flatnonzero(n)
        return pd.DataFrame({"image_id": np.repeat(own["image_id"].to_numpy()[:1], len(met)), "ObjectNumber": some[met // len(names) % max(len(some), 1)], "iter": steps[met // max(len(names) * len(some), 1)], "channel": names[met % max(len(names), 1)], "total": total[met], "n": n[met]})

    kinds = f"image_id {mask.schema['image_id'].dataType.simpleString()}, ObjectNumber {mask.schema['label'].dataType.simpleString()}, iter int, channel {pixels.schema['channel'].dataType.simpleString()}"
    inside = pixels.where("value IS NOT NULL").select(*PIXEL, "channel", "value")
    sums = _in_masks(mask, inside, n_iter, seed, pad, work, f"{kinds}, total double, n long", **options)
    means = sums.groupBy(*CELL, "iter", "channel").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return _medians(means, mask, pixels)


def direct_affine_medians(pixels: DataFrame, mask: DataFrame, transforms: DataFrame, pad: int | None = None, swapped_centre: bool = True) -> DataFrame:
    """As affine_medians with every cell warped alone by every transform (cells may overlap), inside one group per cell.

    transforms (tx .. shy) is a bounded table: it is read once and travels with the tasks. A group holds the pixels that the
    cell reaches under any of them, inside the image (or inside the pad, where one is given).
    """
    params = _listed(transforms)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                b = pdf.iloc[lo : lo + 256].copy()
                low_x, high_x, low_y, high_y = _corners(params, (b["c0"].to_numpy(float) - 1, b["c1"].to_numpy(float)), (b["r0"].to_numpy(float) - 1, b["r1"].to_numpy(float)), b["cx"].to_numpy(), b["cy"].to_numpy())
                b["lr"], b["lc"] = np.maximum(b["lr"], np.floor(low_y).astype(int)), np.maximum(b["lc"], np.floor(low_x).astype(int))
                b["hr"], b["hc"] = np.minimum(b["hr"], np.ceil(high_y).astype(int) + 1), np.minimum(b["hc"], np.ceil(high_x).astype(int) + 1)
                yield b

    b = _centred(mask, pad, transforms, swapped_centre, 1)
    b = b.mapInPandas(windows, b.schema).where("hr > lr and hc > lc")
    own = mask.where("label <> 0").withColumnRenamed("label", "ObjectNumber").join(b, CELL).select(*CELL, F.lit(None).cast("string").alias("channel"), "row", "col", F.lit(0.0).alias("value"), "cx", "cy")
    tile = 32
    tiles = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile), F.floor((F.col(high) - 1) / tile)))
    near = b.withColumn("tr", tiles("lr", "hr")).withColumn("tc", tiles("lc", "hc"))
    px = pixels.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    at = px.join(near, ["image_id", "tr", "tc"]).where("row >= lr and row < hr and col >= lc and col < hc").select(*CELL, "channel", "row", "col", "value", "cx", "cy")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["channel"].isna().to_numpy()
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        cell_r, cell_c, r, c = r[mine], c[mine], r[~mine], c[~mine]
        names, channel = np.unique(pdf["channel"][~mine].to_numpy(str), return_inverse=True)
        if not len(names):
            return pd.DataFrame({"image_id": [], "ObjectNumber": [], "channel": [], "mean": []})
        cy, cx = pdf["cy"].iloc[0] - cell_r.min(), pdf["cx"].iloc[0] - cell_c.min()
        own = np.zeros((np.ptp(cell_r) + 3, np.ptp(cell_c) + 3))
        own[cell_r - cell_r.min() + 1, cell_c - cell_c.min() + 1] = 1
        top, left = r.min(), c.min()
        h, w = np.ptp(r) + 1, np.ptp(c) + 1
        data, ok = np.zeros((len(names), h * w)), np.zeros((len(names), h * w))
        data[channel, (r - top) * w + c - left] = pdf["value"].to_numpy()[~mine]
        ok[channel, (r - top) * w + c - left] = 1
        x, y = np.arange(left, left + w) - cell_c.min(), np.arange(top, top + h)[:, None] - cell_r.min()
        both, codes = np.concatenate([data, ok]).T, _corner_codes(own)
        means, some = [], max(1, BATCH // (h * w))
        for lo in range(0, len(params), some):
            part = params[lo : lo + some]
            a, b, d, e = (m[:, None, None] for m in _linear(part))
            dx, dy = x - cx - part[:, 0, None, None], y - cy - part[:, 1, None, None]
            det = a * e - b * d
            inside = _inside_of(codes, e / det * dx + cx - b / det * dy, a / det * dy + cy - d / det * dx).reshape(len(part), -1)
            total, n = np.split(inside.astype(float) @ both, 2, axis=1)
            means.append(np.divide(total, n, out=np.full(n.shape, np.nan), where=n > 0))
        med = [float(np.median(v[~np.isnan(v)])) if (~np.isnan(v)).any() else None for v in np.concatenate(means).T]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "ObjectNumber": pdf["ObjectNumber"].iloc[0], "channel": names, "mean": med})

    got = at.unionByName(own).groupBy(*CELL).applyInPandas(run, "image_id string, ObjectNumber int, channel string, mean double")
    return _medians(got, mask, pixels)
