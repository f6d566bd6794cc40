"""Boundary shapes and what-if intensities: how a cell's intensity changes when its nucleus boundary is moved."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = ["image_id", "ObjectNumber"]
PROFILE = [*CELL, "channel"]
PLANE = ["image_id", "channel"]
PARTS = 256  # of the cells of a plane, where all meet a row of their plane


def angle_subsets(spark: SparkSession, n: int) -> DataFrame:
    """(subset_id, size, angles): all subsets of n angles in order of size."""
    rows = [(i, len(s), list(s)) for i, s in enumerate(x for k in range(n + 1) for x in itertools.combinations(range(n), k))]
    return spark.createDataFrame(rows, "subset_id int, size int, angles array<int>")


def shapes(spark: SparkSession, n: int = 8, dmax: int = 2, minp: float = 0.0, maxp: float = 0.4) -> DataFrame:
    """(shape_id, angle, depth): runs of neighbouring angles (wrapping), each with its own depth 1..dmax.

    Widths go from int(n minp) to int(n maxp); a shape of width 0 is one row of depth 0 without an angle. Ids count width by
    width, start by start, depths as the digits of a number; duplicates of width 0 and of full width stay.
    """
    out, first = None, 0
    for width in range(int(n * minp), int(n * maxp) + 1):
        each = dmax**width
        if width == 0:
            out = spark.range(n).select(F.col("id").cast("int").alias("shape_id"), F.lit(None).cast("int").alias("angle"), F.lit(0).alias("depth"))
        else:
            ids = spark.range(n * each).withColumn("start", F.expr(f"id div {each}")).withColumn("code", F.col("id") % each)
            at = ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
            digit = F.expr(f"code div cast(pow({dmax}, i) as bigint)") % dmax + 1
            part = at.select((F.col("id") + first).cast("int").alias("shape_id"), ((F.col("start") + F.col("i")) % n).cast("int").alias("angle"), digit.cast("int").alias("depth"))
            out = part if out is None else out.unionByName(part)
        first += n * each
    return out if out is not None else spark.createDataFrame([], "shape_id int, angle int, depth int")


def n_shapes(n: int = 8, dmax: int = 2, minp: float = 0.0, maxp: float = 0.4) -> int:
    """Rows of shapes(), counted by its parameters."""
    return sum(n * dmax**width for width in range(int(n * minp), int(n * maxp) + 1))


def shape_stats(s: DataFrame) -> DataFrame:
    """(shape_id, mean_angle, sd_angle, max_depth, covered, mean_depth): circular mean and sd over covered cells, period 8."""
    t = F.col("angle") * (2 * 3.141592653589793 / (8 - 1e-12))
    got = s.groupBy("shape_id").agg(F.sum(F.sin(t) * F.col("depth")).alias("sn"), F.sum(F.cos(t) * F.col("depth")).alias("cs"), F.sum("depth").alias("covered"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"))
    k = (8 - 1e-12) / (2 * 3.141592653589793)
    mean = F.atan2("sn", "cs") * k
    r = F.least(F.lit(1.0), F.sqrt(F.col("sn") * F.col("sn") + F.col("cs") * F.col("cs")) / F.col("covered"))
    return got.select("shape_id", F.when(F.round(mean, 9) < 0, mean + (8 - 1e-12)).otherwise(mean).alias("mean_angle"), (F.sqrt(-2 * F.log(F.greatest(r, F.lit(1e-300)))) * k).alias("sd_angle"), "max_depth", "covered", "mean_depth")


def nucleus_boundary(profile: DataFrame, thr: float = 1.0, maxdist: int = 3, offset: int = 0) -> DataFrame:
    """(image_id, ObjectNumber, angle, inner, outer, outmost): first ring of the nucleus, the ring past its last, + maxdist.

    Without a nucleus at an angle both are 0. outer is moved by offset, but not below inner.
    """
    at = profile.where("channel = 'own_nucleus'")
    on = F.when(F.col("value") >= thr, F.col("ring"))
    got = at.groupBy(*CELL, "angle").agg(F.coalesce(F.min(on), F.lit(0)).cast("int").alias("inner"), F.coalesce(F.max(on) + 1, F.lit(0)).cast("int").alias("o"))
    outer = F.greatest(F.col("inner"), F.col("o") + offset).cast("int")
    return got.select(*CELL, "angle", "inner", outer.alias("outer"), (outer + maxdist).alias("outmost"))


def max_shrinkage(boundary: DataFrame) -> DataFrame:
    return boundary.groupBy(*CELL).agg(F.min(F.col("outer") - F.col("inner")).alias("shrinkage"))


def nucleus_sums(profile: DataFrame, boundary: DataFrame) -> DataFrame:
    """(image_id, ObjectNumber, channel, nuc_sum, nuc_n): rings inner..outer, both included."""
    at = profile.join(boundary, [*CELL, "angle"]).where((F.col("ring") >= F.col("inner")) & (F.col("ring") <= F.col("outer")))
    return at.groupBy(*PROFILE).agg(F.sum("value").alias("nuc_sum"), F.count(F.lit(1)).alias("nuc_n"))


def layers(profile: DataFrame, boundary: DataFrame, maxdist: int) -> DataFrame:
    """profile's rings at and past the boundary as layers 0..maxdist-1; for a negative maxdist, those before it, inward."""
    layer = F.col("ring") - F.col("outer") if maxdist >= 0 else F.col("outer") - 1 - F.col("ring")
    at = profile.join(boundary, [*CELL, "angle"]).withColumn("layer", layer.cast("int"))
    return at.where((F.col("layer") >= 0) & (F.col("layer") < abs(maxdist))).select(*PROFILE, "angle", "layer", "value", "ring")


def shape_sums(layered: DataFrame, s: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(image_id, ObjectNumber, channel, shape_id, shape_sum, shape_n): sums over the layers that a shape covers.

    own (image_id, ObjectNumber, angle, ring, value): the own-nucleus plane, multiplied in when given. Layers are summed
    up once for each angle; shapes, a table bounded by its parameters, then pick one running sum for each of their angles.
    """
    at = _owned(layered, own)
    w = Window.partitionBy(*PROFILE, "angle").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = at.select(*PROFILE, "angle", (F.col("layer") + 1).alias("depth"), F.sum("value").over(w).alias("s"))
    sums = cum.join(_sent(s), ["angle", "depth"]).groupBy(*PROFILE, "shape_id").agg(F.sum("s").alias("shape_sum"), F.sum("depth").alias("shape_n"))
    return sums.unionByName(layered.select(*PROFILE).distinct().join(_sent(_empty(s))).withColumn("shape_sum", F.lit(0.0)).withColumn("shape_n", F.lit(0).cast("long")))


def _owned(layered: DataFrame, own: DataFrame | None) -> DataFrame:
    if own is None:
        return layered
    return layered.join(own.select(*CELL, "angle", "ring", F.col("value").alias("__own")), [*CELL, "angle", "ring"]).withColumn("value", F.col("value") * F.col("__own")).drop("__own")


SMALL = 200_000  # rows of a table of shapes that is sent to every task


def _sent(s: DataFrame) -> DataFrame:
    """s marked for broadcast where it has few rows; a larger table is joined as any other."""
    return F.broadcast(s) if s.limit(SMALL + 1).count() <= SMALL else s


def _empty(s: DataFrame) -> DataFrame:
    return s.where("depth = 0").select("shape_id").distinct()


def sliding_sums(layered: DataFrame, s: DataFrame, maxdist: int) -> DataFrame:
    """As shape_sums for dmax 2, with the two-layer pattern moved outward by start = 0..maxdist-2.

    The layers before start are those of all angles, the layers from start on those of the shape's own angles.
    """
    starts = F.explode(F.sequence(F.lit(0), F.lit(max(maxdist - 2, 0))))
    own = s.where("depth > 0").withColumn("start", starts).withColumn("layer", F.explode(F.expr("sequence(start, start + depth - 1)")))
    own = layered.join(_sent(own.drop("depth")), ["angle", "layer"]).groupBy(*PROFILE, "shape_id", "start").agg(F.sum("value").alias("own_sum"), F.count(F.lit(1)).alias("own_n"))
    inner = layered.withColumn("start", starts).groupBy(*PROFILE, "start").agg(F.sum(F.when(F.col("layer") < F.col("start"), F.col("value")).otherwise(0.0)).alias("in_sum"), F.count(F.when(F.col("layer") < F.col("start"), 1)).alias("in_n"))
    every = inner.join(_sent(s.select("shape_id").distinct())).join(own, [*PROFILE, "shape_id", "start"], "left").fillna(0, ["own_sum", "own_n"])
    return every.select(*PROFILE, "shape_id", "start", (F.col("in_sum") + F.col("own_sum")).alias("shape_sum"), (F.col("in_n") + F.col("own_n")).alias("shape_n"))


def normalised(sums: DataFrame, nucleus: DataFrame, how: str = "all", inverted: bool = False) -> DataFrame:
    """sums with marker: all (nucleus and shape, per covered ring), sub (the shape alone), or none (the sum); n stays a column."""
    at = sums.join(nucleus, PROFILE)
    sign = -1 if inverted else 1
    made: dict[str, Column] = {
        "all": F.try_divide(F.col("nuc_sum") + sign * F.col("shape_sum"), F.col("nuc_n") + sign * F.col("shape_n")),
        "sub": F.try_divide(F.col("shape_sum"), F.col("shape_n")),
        "none": F.col("shape_sum"),
    }
    return at.withColumn("marker", made[how]).withColumnRenamed("shape_n", "n").drop("nuc_sum", "nuc_n", "shape_sum")


def slides(dmax: int, maxdist: int) -> bool:
    """Whether shapes of this largest depth are also moved outward over maxdist layers: two-layer patterns are, where there is room."""
    return dmax == 2 and abs(maxdist) > 2


def _status(profile: DataFrame, b: DataFrame, maxdist: int) -> DataFrame:
    last = profile.groupBy(*CELL).agg(F.max("ring").alias("last")).join(b.groupBy(*CELL).agg(F.max("outmost").alias("most"), F.min(F.col("outer") - F.col("inner")).alias("depth")), CELL)
    return last.select(*CELL, F.when(F.col("most") > F.col("last"), "past_last_ring").when(F.col("depth") < -maxdist, "nucleus_too_small").otherwise("ok").alias("status"))


def what_if(profile: DataFrame, s: DataFrame, maxdist: int | None = None, how: str = "all", thr: float = 1.0, offset: int = 0, only_own: bool = False) -> DataFrame:
    """(image_id, ObjectNumber, channel, shape_id, n, marker, status) for each cell and shape.

    status: past_last_ring for a cell whose boundary + maxdist reaches the number of rings, nucleus_too_small for one that
    is to shrink by more rings than its nucleus has at some angle (both have a NULL marker), else ok. maxdist is the shapes'
    largest depth where not given; where that depth is 2 and maxdist allows more, shapes are moved outward as well, and
    `start` says by how much.
    """
    deepest = s.agg(F.max("depth")).first()[0] or 0  # of a table bounded by its parameters
    maxdist = max(deepest, 1) if maxdist is None else maxdist
    b = nucleus_boundary(profile, thr, abs(maxdist), offset)
    data = profile.where("channel <> 'own_nucleus'")
    own = profile.where("channel = 'own_nucleus'") if only_own else None
    at = layers(data, b, maxdist)
    sums = sliding_sums(_owned(at, own), s, abs(maxdist)) if slides(deepest, maxdist) else shape_sums(at, s.where(F.col("depth") <= abs(maxdist)), own)
    out = normalised(sums, nucleus_sums(data, b), how, maxdist < 0)
    return out.join(_status(profile, b, maxdist), CELL).withColumn("marker", F.when(F.col("status") == "ok", F.col("marker")))


# --- all shapes of a cell without a table of them ----------------------------------------------------------------------

LISTED = 1 << 22  # markers that a task holds at once
SUMMARY = ("max", "min", "mean", "median", "sd")


class _Moves:
    """Markers of some rows (a cell and channel each) over all shapes: runs of angles, each with its own depth.

    terms[j][r, a, d]: what angle a adds at depth d + 1 when the pattern starts at layer j. The marker of a shape of total
    depth N and sum S is (top + sign * S) / (below + sign * N), with top and below of row and start; `none` divides by 1.
    """

    def __init__(self, grid: np.ndarray, nuc_sum: np.ndarray, nuc_n: np.ndarray, dmax: int, widths: range, how: str, inverted: bool):
        rows, self.n, deep = grid.shape
        self.dmax, self.widths, self.how = dmax, widths, how
        starts = range(max(deep - 1, 1) if slides(dmax, deep) else 1)
        cum = np.concatenate([np.zeros((rows, self.n, 1)), np.cumsum(grid, axis=2)], axis=2)
        self.terms = [cum[:, :, j + 1 : j + dmax + 1] - cum[:, :, j, None] for j in starts]
        inner = [cum[:, :, j].sum(axis=1) for j in starts]
        self.sign = -1 if inverted and how == "all" else 1
        add = [(nuc_sum, nuc_n) if how == "all" else (np.zeros(rows), np.zeros(rows))] * len(self.terms)
        self.top = [t + self.sign * i for (t, _), i in zip(add, inner)]
        self.below = [(b + self.sign * self.n * j) if how != "none" else np.ones(rows) for j, (_, b) in zip(starts, add)]

    def _divide(self, j: int, s: np.ndarray, depth: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
        """Markers less `less` of sums s (rows, k) at total depths (k); NaN where nothing is divided by."""
        den = self.below[j][:, None] + (self.sign * depth[None, :] if self.how != "none" else np.zeros((1, len(depth))))
        with np.errstate(all="ignore"):
            return np.where(den != 0, (self.top[j][:, None] - less * den + self.sign * s) / den, np.nan)

    def count(self) -> int:
        return len(self.terms) * self.n * sum(self.dmax**w for w in self.widths)

    def _runs(self):
        """(start layer, first angle, width) of each run of angles."""
        return ((j, a, w) for j in range(len(self.terms)) for a in range(self.n) for w in self.widths)

    def listed(self) -> np.ndarray:
        """(rows, shapes): every marker; sums of a run are outer sums over its angles."""
        out = []
        for j, term in enumerate(self.terms):
            for a in range(self.n):
                s, depth = np.zeros((len(term), 1)), np.zeros(1)
                for w in range(self.widths.stop):
                    if w in self.widths:
                        out.append(self._divide(j, s, depth))
                    if w + 1 < self.widths.stop:
                        s = (s[:, :, None] + term[:, (a + w) % self.n, None, :]).reshape(len(term), -1)
                        depth = (depth[:, None] + np.arange(1, self.dmax + 1)).ravel()
        return np.concatenate(out, axis=1)

    def moments(self) -> tuple[np.ndarray, ...]:
        """(least, greatest, mean, sd, number) by dynamic programming: of all shapes of a run and a total depth, the count, the
        least and greatest sum, the sum of sums and of squares follow from the run without its last angle."""
        rows = len(self.terms[0])
        centre = self._divide(0, np.zeros((rows, 1)), np.zeros(1))[:, 0]
        centre = np.nan_to_num(centre)[:, None]  # squares are taken about it
        low, high, total, square, number = np.full(rows, np.inf), np.full(rows, -np.inf), np.zeros(rows), np.zeros(rows), np.zeros(rows)
        for j, term in enumerate(self.terms):
            for a in range(self.n):
                size = (self.widths.stop - 1) * self.dmax + 1
                depth = np.arange(size)
                count = np.zeros(size)
                count[0] = 1
                least, most, s1, s2 = (np.full((rows, size), x) for x in (np.inf, -np.inf, 0.0, 0.0))
                least[:, 0] = most[:, 0] = 0
                for w in range(self.widths.stop):
                    if w in self.widths:
                        at = count > 0
                        ends = [self._divide(j, e[:, at], depth[at]) for e in (least, most)]
                        ok = ~np.isnan(ends[0])
                        low, high = np.fmin(low, np.fmin.reduce(np.minimum(*ends), axis=1)), np.fmax(high, np.fmax.reduce(np.maximum(*ends), axis=1))
                        zero = self._divide(j, np.zeros((rows, at.sum())), depth[at], centre)
                        unit = np.where(ok, self._divide(j, np.ones((rows, at.sum())), depth[at], centre) - zero, 0.0)  # of one more in the sum
                        zero = np.where(ok, zero, 0.0)
                        total += (count[at] * zero + unit * s1[:, at]).sum(axis=1)
                        square += (count[at] * zero**2 + 2 * zero * unit * s1[:, at] + unit**2 * s2[:, at]).sum(axis=1)
                        number += (count[at] * ok).sum(axis=1)
                    if w + 1 == self.widths.stop:
                        break
                    now = np.zeros(size), *(np.full((rows, size), x) for x in (np.inf, -np.inf, 0.0, 0.0))
                    for d in range(1, self.dmax + 1):
                        t = term[:, (a + w) % self.n, d - 1, None]
                        to, of = slice(d, size), slice(0, size - d)
                        now[0][to] += count[of]
                        now[1][:, to] = np.minimum(now[1][:, to], least[:, of] + t)
                        now[2][:, to] = np.maximum(now[2][:, to], most[:, of] + t)
                        now[3][:, to] += s1[:, of] + count[of] * t
                        now[4][:, to] += s2[:, of] + 2 * t * s1[:, of] + count[of] * t * t
                    count, least, most, s1, s2 = now
        with np.errstate(all="ignore"):
            mean = total / number
            return low, high, mean + centre[:, 0], np.sqrt(np.maximum(square / number - mean**2, 0)), number

    def medians(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Medians of the markers: listed where a row's fit in memory, otherwise found by counting."""
        rows = len(self.terms[0])
        if self.count() > LISTED:
            return np.array([self._counted_median(r, low[r], high[r], int(number[r])) for r in range(rows)])
        out, some = np.empty(rows), max(1, LISTED // max(self.count(), 1))
        for lo in range(0, rows, some):
            m = self.part(slice(lo, lo + some)).listed()
            out[lo : lo + some] = np.nanmedian(m, axis=1) if np.isnan(m).any() else np.median(m, axis=1)
        return out

    def part(self, rows: slice) -> _Moves:
        made = copy(self)
        made.terms, made.top, made.below = ([x[rows] for x in each] for each in (self.terms, self.top, self.below))
        return made

    def _counted_median(self, row: int, low: float, high: float, number: int) -> float:
        """By bisection: a run's shapes are pairs of those of its halves, and pairs up to a value are counted in sorted halves."""

        def half(j: int, angles: list[int]) -> tuple[np.ndarray, np.ndarray]:
            s, depth = np.zeros(1), np.zeros(1)
            for a in angles:
                s, depth = (s[:, None] + self.terms[j][row, a]).ravel(), (depth[:, None] + np.arange(1, self.dmax + 1)).ravel()
            return s, depth

        runs = []
        for j, a, w in self._runs():
            angles = [(a + i) % self.n for i in range(w)]
            runs.append((j, *half(j, angles[: w // 2]), *half(j, angles[w // 2 :])))

        def up_to(t: float) -> int:
            """Markers of at most t, where what they are divided by is positive."""
            found = 0
            for j, sa, na, sb, nb in runs:
                by = t * self.sign if self.how != "none" else 0.0
                x, y = self.sign * sa - by * na, np.sort(self.sign * sb - by * nb)
                found += int(np.searchsorted(y, t * self.below[j][row] - self.top[j][row] - x, "right").sum())
            return found

        def nth(k: int) -> float:
            a, b = low, high
            for _ in range(100):
                mid = (a + b) / 2
                if mid in (a, b):
                    break
                a, b = (a, mid) if up_to(mid) >= k else (mid, b)
            return b

        return (nth((number + 1) // 2) + nth(number // 2 + 1)) / 2 if number else math.nan


def _grids(profile: DataFrame, n: int, dmax: int, maxdist: int, thr: float, offset: int, only_own: bool) -> DataFrame:
    """(PROFILE, layers (angle, layer, value), nuc_sum, nuc_n) of each cell that has room for the shapes."""
    if not 0 < dmax <= abs(maxdist):
        raise ValueError("shapes are as deep as maxdist at most")
    b = nucleus_boundary(profile, thr, abs(maxdist), offset)
    data = profile.where("channel <> 'own_nucleus'")
    own = profile.where("channel = 'own_nucleus'") if only_own else None
    ok = _status(profile, b, maxdist).where("status = 'ok'").select(*CELL)
    at = _owned(layers(data, b, maxdist), own).groupBy(*PROFILE).agg(F.collect_list(F.struct(F.col("angle").cast("int").alias("angle"), F.col("layer").cast("int").alias("layer"), F.col("value").cast("double").alias("value"))).alias("layers"))
    return at.join(ok, CELL).join(nucleus_sums(data, b), PROFILE).select(*PROFILE, "layers", F.col("nuc_sum").cast("double").alias("nuc_sum"), F.col("nuc_n").cast("double").alias("nuc_n"))


def _moves(batch: pa.RecordBatch, n: int, dmax: int, widths: range, maxdist: int, how: str) -> _Moves:
    lists = batch.column("layers")
    ends, flat = lists.offsets.to_numpy(), lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    grid = np.zeros((batch.num_rows, n, abs(maxdist)))
    grid[row, flat.field("angle").to_numpy(), flat.field("layer").to_numpy()] = flat.field("value").to_numpy()
    return _Moves(grid, batch.column("nuc_sum").to_numpy(), batch.column("nuc_n").to_numpy(), dmax, widths, how, maxdist < 0)


def what_if_summaries(profile: DataFrame, n: int = 8, dmax: int = 3, minp: float = 0.0, maxp: float = 0.4, maxdist: int | None = None, how: str = "all", thr: float = 1.0, offset: int = 0, only_own: bool = False) -> DataFrame:
    """marker_summaries over all shapes(n, dmax, minp, maxp) of every cell with room for them, without listing shapes as rows.

    Depths of a run of angles are independent, so counts, extremes and moments follow angle by angle, and what a task holds
    does not grow with the number of shapes. maxdist is dmax where not given. Cells without room have no row.
    """
    maxdist = dmax if maxdist is None else maxdist
    widths = range(int(n * minp), int(n * maxp) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                moves = _moves(part, n, dmax, widths, maxdist, how)
                low, high, mean, sd, number = moves.moments()
                found = [high, low, mean, moves.medians(low, high, number), sd]
                some = pa.array(number > 0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in PROFILE], *map(pa.array, found)], names=[*PROFILE, *SUMMARY]).filter(some)

    at = _grids(profile, n, dmax, maxdist, thr, offset, only_own)
    kinds = ", ".join(f"{c} {at.schema[c].dataType.simpleString()}" for c in PROFILE)
    got = at.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in SUMMARY))
    return got.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.try_divide("sd", "mean"))


def what_if_histogram(profile: DataFrame, means: DataFrame, n: int = 8, dmax: int = 3, minp: float = 0.0, maxp: float = 0.4, maxdist: int | None = None, how: str = "all", thr: float = 1.0, offset: int = 0, only_own: bool = False) -> DataFrame:
    """histogram over all shapes of every cell with room for them; a cell's markers are counted where they are made.

    At most LISTED shapes: beyond that a ValueError.
    """
    maxdist = dmax if maxdist is None else maxdist
    widths = range(int(n * minp), int(n * maxp) + 1)
    bins = _bins(n_shapes(n, dmax, minp, maxp))
    fine = bins * 10
    if n_shapes(n, dmax, minp, maxp) * (abs(maxdist) - 1 if slides(dmax, maxdist) else 1) > LISTED:
        raise ValueError(f"a histogram takes {LISTED} shapes at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = max(1, LISTED // max(_moves(batch.slice(0, 1), n, dmax, widths, maxdist, how).count(), 1))
            for lo in range(0, batch.num_rows, some):
                part = batch.slice(lo, some)
                m = _moves(part, n, dmax, widths, maxdist, how).listed()
                low, high = np.fmin.reduce(m, axis=1)[:, None], np.fmax.reduce(m, axis=1)[:, None]
                spread = high - low
                with np.errstate(all="ignore"):
                    j = np.where(spread > 0, np.minimum(fine - 1, np.floor((m - low) * (fine / spread))), fine // 2)
                row, col = np.nonzero(~np.isnan(m))
                at, c = np.unique(row * fine + j[row, col].astype(np.int64), return_counts=True)
                of = pa.array(at // fine)
                yield pa.RecordBatch.from_arrays([*[part.column(x).take(of) for x in PROFILE], pa.array(at % fine), pa.array(low[at // fine, 0]), pa.array(high[at // fine, 0]), pa.array(c)], names=[*PROFILE, "j", "lo", "hi", "c"])

    at = _grids(profile, n, dmax, maxdist, thr, offset, only_own)
    kinds = ", ".join(f"{c} {at.schema[c].dataType.simpleString()}" for c in PROFILE)
    counted = at.mapInArrow(run, f"{kinds}, j long, lo double, hi double, c long")
    return _binned(counted.join(means.select(*PROFILE, F.col("value").alias("mean")), PROFILE), bins)


def histogram(markers: DataFrame, means: DataFrame, n_shapes: int) -> DataFrame:
    """(image_id, ObjectNumber, channel, bin, grid, n): markers less the cell's mean, counted on one grid for all cells.

    There are max(100, n_shapes // 200) bins. A cell's markers are counted first in ten times as many equal bins between
    its own least and greatest marker; each of these stands for a point of as many evenly spaced ones over that range,
    which then falls into one of the common bins. Those are closed on the right; a point on the lower end of the range is
    counted in the last bin. grid: evenly spaced points over the range, both ends included. Only the ends are gathered.
    """
    bins = _bins(n_shapes)
    fine = bins * 10
    own = markers.where("marker is not null").groupBy(*PROFILE).agg(F.min("marker").alias("lo"), F.max("marker").alias("hi")).join(means.select(*PROFILE, F.col("value").alias("mean")), PROFILE)
    spread = F.col("hi") - F.col("lo")
    j = F.when(spread > 0, F.least(F.lit(fine - 1), F.floor((F.col("marker") - F.col("lo")) * (fine / spread)))).otherwise(fine // 2)
    return _binned(markers.where("marker is not null").join(own, PROFILE).withColumn("j", j).groupBy(*PROFILE, "j", "lo", "hi", "mean").agg(F.count(F.lit(1)).alias("c")), bins)


def _bins(n_shapes: int) -> int:
    return max(100, n_shapes // 200)


def _binned(at: DataFrame, bins: int) -> DataFrame:
    """(PROFILE, bin, grid, n) from counts c of each cell's own fine bins j between lo and hi."""
    fine = bins * 10
    spread = F.col("hi") - F.col("lo")
    # a channel of an image may have any share of the cells: rows meet its ends part by part, and the ends of parts are few
    part, plane = [*PLANE, "__part"], Window.partitionBy(*PLANE)
    at = at.withColumn("__part", F.pmod(F.hash("ObjectNumber"), F.lit(PARTS)))
    ends = at.groupBy(*part).agg(F.min(F.col("lo") - F.col("mean")).alias("first"), F.max(F.col("hi") - F.col("mean")).alias("last"))
    at = at.join(ends.select(*part, F.min("first").over(plane).alias("first"), F.max("last").over(plane).alias("last")), part)
    point = (F.col("lo") - F.col("mean")) + F.col("j") * (spread / (fine - 1))
    width = (F.col("last") - F.col("first")) / bins
    b = F.when(width > 0, F.least(F.lit(bins), F.ceil(F.round((point - F.col("first")) / width, 9))) - 1).otherwise(-1)
    at = at.withColumn("bin", F.when(b < 0, bins - 1).otherwise(b).cast("int")).withColumn("grid", F.col("first") + F.col("bin") * ((F.col("last") - F.col("first")) / (bins - 1)))
    return at.groupBy(*PROFILE, "bin").agg(F.first("grid").alias("grid"), F.sum("c").alias("n"))


def histogram_mean(hist: DataFrame) -> DataFrame:
    return hist.groupBy(*PROFILE).agg(F.try_divide(F.sum(F.col("n") * F.col("grid")), F.sum("n")).alias("mean"))


def marker_summaries(markers: DataFrame) -> DataFrame:
    """max, min, range, mean, median, sd (population) and CV of the markers of each cell and channel."""
    m = F.col("marker")
    got = markers.where("marker is not null").groupBy(*PROFILE).agg(F.max(m).alias("max"), F.min(m).alias("min"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.stddev_pop(m).alias("sd"))
    return got.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.try_divide("sd", "mean"))


def widest(summaries: DataFrame) -> DataFrame:
    """The cell of the largest sd in each image and channel; the smallest number on ties."""
    return summaries.groupBy("image_id", "channel").agg(F.max(F.struct(F.col("sd"), -F.col("ObjectNumber"))).alias("m")).select("image_id", "channel", (-F.col("m")["col2"]).alias("ObjectNumber"), F.col("m.sd").alias("sd"))
