"""Per-cell aggregates and features, in long form: one row for each image, cell and channel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources.images import PIXEL, foreground

CELL = ["image_id", "ObjectNumber"]
KEY = [*CELL, "channel"]
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _cells(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return foreground(pixels, mask).withColumnRenamed("label", "ObjectNumber")


def cell_intensities(pixels: DataFrame, mask: DataFrame, kind: str = "mean") -> DataFrame:
    """(image_id, ObjectNumber, channel, value, area, x, y): mean, max or (population) std; x, y: mean row and column."""
    f = {"mean": F.avg, "max": F.max, "std": F.stddev_pop}[kind]
    return _cells(pixels, mask).groupBy(*KEY).agg(f("value").alias("value"), F.count(F.lit(1)).alias("area"), F.avg("row").alias("x"), F.avg("col").alias("y"))


def listed_intensities(pixels: DataFrame, mask: DataFrame, cells: DataFrame, kind: str = "mean") -> DataFrame:
    """The mean, or the area, of the cells listed (image_id, ObjectNumber); those without a pixel get NULL, or 0."""
    wanted = _cells(pixels, mask).join(cells.select(*CELL).distinct(), CELL, "left_semi")
    agg = wanted.groupBy(*KEY).agg((F.avg("value") if kind == "mean" else F.count(F.lit(1)).cast("double")).alias("value"))
    planes = pixels.select("image_id", "channel").distinct()
    out = cells.select(*CELL).distinct().join(planes, "image_id").join(agg, KEY, "left")
    return out if kind == "mean" else out.fillna(0.0, ["value"])


def boxes(mask: DataFrame) -> DataFrame:
    """(image_id, ObjectNumber, x, y, r0, c0, r1, c1): centroid and half-open bounding box of each cell."""
    cells = mask.where("label <> 0").withColumnRenamed("label", "ObjectNumber")
    return cells.groupBy(*CELL).agg(F.avg("row").alias("x"), F.avg("col").alias("y"), F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"))


def edge_core_pixels(pixels: DataFrame, perimeter: DataFrame) -> DataFrame:
    """Cells' pixels with is_edge."""
    return pixels.join(perimeter.withColumnRenamed("label", "ObjectNumber"), PIXEL)


def _core(total: Column, edge: Column) -> Column:
    return total - edge


def _quantile(e: Column, q: float) -> Column:
    """The linear quantile of a sorted array: a (1 - d) + b d, where a (1 - d) of a quartile is not rounded on its own.

    With whole tenths the fence of EDGE_IQMEAN often meets a value, so its last bit counts; engines that fuse the
    multiplication and the sum, as DuckDB does, then agree.
    """
    at = F.lit(q) * (F.size(e) - 1)
    low = F.floor(at).cast("int")
    d, a = at - low, F.get(e, low)
    b = F.coalesce(F.get(e, low + 1), a)
    left, right = a * (1 - d), b * d
    total = left + right
    back = total - left
    lost = (left - (total - back)) + (right - back) + F.when(d == 0.25, a * 0.5 - left + a * 0.25).otherwise(0.0)
    return F.when(a == b, a).otherwise(total + lost)


def features(pixels: DataFrame, perimeter: DataFrame, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Whole, edge and core features of each cell and channel.

    EDGE_IQMEAN is the mean of the edge values up to q3 + 1.5 (q3 - q1); there is no lower fence. CORE_MEAN is 0 for a
    cell without a core.
    """
    at = edge_core_pixels(pixels, perimeter)
    edge = F.when(F.col("is_edge"), F.col("value"))
    got = at.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("AREA"), F.count_if("is_edge").alias("AREA_EDGE"), F.sum("value").alias("__sum"), F.sum(edge).alias("__edge"),
        F.array_sort(F.collect_list(edge)).alias("__e"),
    )
    # the edge values of one cell travel as an array, so that pixels are grouped once
    e = F.col("__e")
    got = got.withColumn("__f", F.array(_quantile(e, 0.25), _quantile(e, 0.75)))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), (F.col("__f")[1] + 1.5 * (F.col("__f")[1] - F.col("__f")[0])).alias("fence"))
    within = F.aggregate(e, start, lambda a, v: F.when(v <= a["fence"], F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n"), a["fence"].alias("fence"))).otherwise(a))
    got = got.withColumn("AREA_CORE", _core(F.col("AREA"), F.col("AREA_EDGE"))).withColumn("__w", within).withColumn("EDGE_IQMEAN", F.try_divide("__w.s", "__w.n"))
    return got.select(
        *KEY, "AREA", "AREA_EDGE", "AREA_CORE", F.try_divide("__sum", "AREA").alias("MEAN"), F.try_divide("__edge", "AREA_EDGE").alias("EDGE_MEAN"),
        F.coalesce(F.try_divide(_core(F.col("__sum"), F.coalesce("__edge", F.lit(0.0))), F.col("AREA_CORE")), F.lit(0.0)).alias("CORE_MEAN"),
        *[_quantile(e, q).alias(f"EDGE_Q{int(q * 100)}") for q in qs], "EDGE_IQMEAN",
    )


def p_weights(stat: DataFrame, p: str = "p_hot", min_p: float = 0.1, offset: float = 0.1) -> DataFrame:
    """stat with weight: 1 - p / min_p, cut to offset..1."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(offset), 1 - F.least(F.col(p), F.lit(min_p)) / min_p))
    return stat.withColumn("weight", F.when(F.col(p).isNotNull(), w))


def hodges_lehmann(pixels: DataFrame, perimeter: DataFrame, pairs: int = 1 << 22) -> DataFrame:
    """(image_id, ObjectNumber, channel, hl): the median of all core - edge differences, NULL without a core. Pixels without a value have none.

    A cell with more pairs than `pairs` is solved by bisection on the number of differences at or below a value, so that
    no table of pairs is held; the result is the same.
    """

    def middle(core: np.ndarray, edge: np.ndarray, k: int) -> float:
        edge, lo, hi = np.sort(edge), core.min() - edge.max(), core.max() - edge.min()
        for _ in range(200):  # until lo and hi are neighbours
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            if len(edge) * len(core) - np.searchsorted(edge, core - mid, "left").sum() > k:
                hi = mid
            else:
                lo = mid
        at = np.searchsorted(edge, core - hi, "left")  # the same comparison as in the count, so rounding cannot part them
        ok = at < len(edge)
        return float((core[ok] - edge[at[ok]]).max())

    def shift(core: np.ndarray, edge: np.ndarray) -> float | None:
        core, edge = core[~np.isnan(core)], edge[~np.isnan(edge)]
        n = len(edge) * len(core)
        if n > pairs:
            return (middle(core, edge, (n - 1) // 2) + middle(core, edge, n // 2)) / 2
        return float(np.median(core[:, None] - edge[None, :])) if n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the cell that may go on in the next batch

        def out(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for k in KEY:
                c = rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            at = np.append(np.flatnonzero(new), rows.num_rows)
            done = len(at) - 1 if last else len(at) - 2
            v, e = rows.column("value").to_numpy(), rows.column("is_edge").to_numpy()
            hl = [shift(v[lo:hi][~e[lo:hi]], v[lo:hi][e[lo:hi]]) for lo, hi in zip(at[:done], at[1 : done + 1])]
            if done:
                first = rows.select(KEY).take(pa.array(at[:done]))
                yield from first.append_column("hl", pa.array(hl, pa.float64())).combine_chunks().to_batches()
            held[:] = rows.slice(at[done]).to_batches() if not last else []

        for batch in batches:
            if not batch.num_rows:
                continue
            # a cell that fills whole batches is put together once, at its end
            same = held and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in KEY)
            held.append(batch)
            if not same:
                yield from out(pa.Table.from_batches(held), False)
        if held:
            yield from out(pa.Table.from_batches(held), True)

    at = edge_core_pixels(pixels, perimeter).select(*KEY, F.col("value").cast("double").alias("value"), "is_edge")
    kinds = ", ".join(f"{k} {at.schema[k].dataType.simpleString()}" for k in KEY)
    # a row is a pixel, a group a run of rows of a task: cells cost no call each
    return at.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, f"{kinds}, hl double")


def _hash_order(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """For each start (a row) the order of the ends by md5(start + end): by its first 8 bytes, by all 16 in a row where these tie."""
    digests = np.frombuffer(b"".join([hashlib.md5(s + x).digest() for s in starts for x in ends]), ">u8").astype(np.uint64).reshape(len(starts), len(ends), 2)
    order = np.argsort(digests[..., 0], axis=1)
    top = np.take_along_axis(digests[..., 0], order, axis=1)
    for k in np.flatnonzero((top[:, 1:] == top[:, :-1]).any(axis=1)):
        order[k] = np.lexsort((digests[k, :, 1], digests[k, :, 0]))
    return order


def core_edge_difference(pixels: DataFrame, perimeter: DataFrame, n_iter: int = 99, seed: int = 42) -> DataFrame:
    """(image_id, ObjectNumber, channel, diff, p): core mean - edge mean and its two-sided permutation p; NULL without a core.

    In each iteration the pixels of a cell come in the order of md5(seed|image|cell|channel|iteration|row|column), and as
    many as the cell has edge pixels count as edge.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, e = pdf["value"].to_numpy(), pdf["is_edge"].to_numpy()
        out = pdf[KEY].head(1)
        if e.all() or not e.any():
            return out.assign(diff=None, p=None)
        n_edge, total = e.sum(), v.sum()
        prefix = "|".join(map(str, (seed, *out.iloc[0])))
        ends = [f"|{r}|{c}".encode() for r, c in zip(pdf["row"], pdf["col"])]

        def apart(edge: float | np.ndarray) -> float | np.ndarray:
            return (total - edge) / (len(v) - n_edge) - edge / n_edge

        diff, far = apart(v[e].sum()), 0
        step = max(1, (1 << 20) // len(v))
        for lo in range(0, n_iter, step):
            order = _hash_order([f"{prefix}|{b}".encode() for b in range(lo, min(n_iter, lo + step))], ends)
            far += int((np.abs(apart(v[order[:, :n_edge]].sum(axis=1))) > abs(diff)).sum())
        return out.assign(diff=diff, p=(1 + far) / (1 + n_iter))

    at = edge_core_pixels(pixels, perimeter).select(*KEY, "value", "is_edge", "row", "col")
    return at.groupBy(*KEY).applyInPandas(run, "image_id string, ObjectNumber int, channel string, diff double, p double")
