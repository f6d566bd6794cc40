"""Hot-spot (G) and heteroscedasticity (H) statistics, their p-values and false-discovery control.

A constant plane has no spread: G, H and p are NULL there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellweave.functions.keyed import draw, key, permuted
from cellweave.functions.special import phi
from cellweave.operators.ordered import running
from cellweave.operators.stencil import PLANE, Kernel, disc_sums, kernel_sum, neighbourhood_sum
from cellweave.operators.stencil import disc_totals as _disc_totals
from cellweave.sources.lineage import cut

HOT, COLD, BOTH = 1, 2, 4


def split_types(types: int) -> list[str]:
    """p-value columns asked for by a sum of HOT, COLD and BOTH, in the order both, cold, hot."""
    return [name for bit, name in ((BOTH, "p_both"), (COLD, "p_cold"), (HOT, "p_hot")) if types & bit]


def _with_plane_sums(grid: DataFrame, **aggs) -> DataFrame:
    """Sums of each plane on its pixels: a small aggregate joined back, not a window over the image. NULL without a channel."""
    return grid.join(grid.groupBy(*PLANE).agg(*[a.alias(n) for n, a in aggs.items()]), PLANE, "left")


def _z(xns, x, n, sx, sx2, w1, inner) -> Column:
    m = F.try_divide(sx - x * inner, n)
    s2 = F.try_divide(sx2, n) - m * m
    spread = s2 * F.try_divide(n * w1 - w1 * w1, n - 1)
    return F.when(spread > 1e-12, (xns - m * w1) / F.sqrt(spread))


def _around(grid: DataFrame, queen: bool, centre: bool, kernel: Kernel | None, value: str = "value", out: str = "xns") -> DataFrame:
    return neighbourhood_sum(grid, value, out, queen, centre) if kernel is None else kernel_sum(grid, kernel, value, out)


def _weight(queen: bool, centre: bool, kernel: Kernel | None) -> tuple[float, float]:
    """(sum of the weights, 1 if the centre is left out)."""
    if kernel is None:
        return float((8 if queen else 4) + centre), 0.0 if centre else 1.0
    return sum(w for _, _, w in kernel), 0.0 if any(a == b == 0 for a, b, _ in kernel) else 1.0


def g_classical(pixels: DataFrame, queen: bool = True, centre: bool = True, normalize: bool = True, kernel: Kernel | None = None) -> DataFrame:
    """pixels with g: the Getis-Ord statistic against the whole plane (z-score, or the raw share).

    A kernel takes the place of queen (or rook) and centre.
    """
    w1, inner = _weight(queen, centre, kernel)
    x = F.col("value")
    g = _with_plane_sums(_around(pixels, queen, centre, kernel), sx=F.sum("value"), sx2=F.sum(x * x), nn=F.count(F.lit(1)).cast("double"))
    z = _z(F.col("xns"), x, F.col("nn") - inner, F.col("sx"), F.col("sx2") - x * x * inner, F.lit(w1), inner)
    out = z if normalize else F.try_divide(F.col("xns"), F.col("sx") - x * inner)
    return g.withColumn("g", out).drop("xns", "sx", "sx2", "nn")


def g_radius(pixels: DataFrame, radius: float = 50, queen: bool = True, centre: bool = True, normalize: bool = True, kernel: Kernel | None = None) -> DataFrame:
    """As g_classical against the mean and spread (raw: the sum) of the disc around each pixel; the squares keep the centre."""
    w1, inner = _weight(queen, centre, kernel)
    x = F.col("value")
    g = disc_sums(_around(pixels, queen, centre, kernel), {"sx": x, "sx2": x * x, "nn": F.lit(1.0)}, radius)
    z = _z(F.col("xns"), x, F.col("nn") - inner, F.col("sx"), F.col("sx2"), F.lit(w1), inner)
    out = z if normalize else F.try_divide(F.col("xns"), F.col("sx") - x * inner)
    return g.withColumn("g", out).drop("xns", "sx", "sx2", "nn")


def with_p(stat: DataFrame, types: int = HOT | COLD | BOTH) -> DataFrame:
    """stat with the analytic p-values of g that are asked for."""
    made = {"p_both": 2 * (1 - phi("abs(g)")), "p_cold": phi("g"), "p_hot": 1 - phi("g")}
    return stat.withColumns({c: made[c] for c in split_types(types)})


def h_classical(pixels: DataFrame, queen: bool = True, centre: bool = True, a: float = 2.0, kernel: Kernel | None = None) -> DataFrame:
    """pixels with h (local against mean residual), hz (2h / variance) and h_var; a kernel takes the place of queen and centre."""
    w1, _ = _weight(queen, centre, kernel)
    g = _around(pixels, queen, centre, kernel)
    g = g.withColumn("r", F.pow(F.abs(F.col("value") - F.col("xns") / w1), F.lit(a)))
    g = _around(g, queen, centre, kernel, "r", "rns")
    g = _with_plane_sums(g, mr=F.avg("r"), mr2=F.avg(F.col("r") * F.col("r")), nn=F.count(F.lit(1)).cast("double"))
    denom = F.col("mr") * w1
    var = F.try_divide(F.lit(1.0), F.col("nn") - 1) * F.pow(F.try_divide(F.lit(1.0), denom), F.lit(2.0)) * (F.col("mr2") - F.col("mr") * F.col("mr")) * (F.col("nn") * w1 - w1 * w1)
    g = g.withColumn("h", F.try_divide(F.col("rns"), denom)).withColumn("h_var", var)
    return g.withColumn("hz", F.try_divide(2 * F.col("h"), F.col("h_var"))).drop("xns", "r", "rns", "mr", "mr2", "nn")


def _gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma by its series or continued fraction, all values of a batch at once."""
    out = np.full(len(x), np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    out[ok & np.isinf(x)] = 0.0
    ok &= (x > 0) & np.isfinite(x)
    for low in (True, False):
        at = ok & ((x < a + 1) == low)
        s, t = a[at], x[at]
        if not len(s):
            continue
        some, place = np.unique(s, return_inverse=True)
        front = np.exp(-t + s * np.log(t) - np.array([math.lgamma(v) for v in some])[place])
        if low:
            term = 1 / s
            total, k = term.copy(), s.copy()
            while (np.abs(term) > np.abs(total) * 1e-15).any():
                k += 1
                term *= t / k
                total += term
            out[at] = 1 - total * front
        else:
            b, c = t + 1 - s, np.full(len(s), 1e300)
            d = 1 / b
            f = d.copy()
            for n in range(1, 10_000):
                an = -n * (n - s)
                b = b + 2
                d = 1 / np.where(an * d + b == 0, 1e-300, an * d + b)
                c = np.where(b + an / c == 0, 1e-300, b + an / c)
                f *= d * c
                if (np.abs(d * c - 1) < 1e-15).all():
                    break
            out[at] = front * f
    return out


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; undefined is NULL."""
    v = pd.Series(_gammaincc(df.to_numpy(float) / 2, x.to_numpy(float) / 2))
    return v.where(v.notna(), None)


def h_with_p(pixels: DataFrame, **kernel) -> DataFrame:
    """h_classical with p: the chi-square tail of hz at 2 / variance degrees of freedom."""
    g = h_classical(pixels, **kernel)
    return g.withColumn("p", chi2_sf("hz", F.try_divide(F.lit(2.0), F.col("h_var"))))


def false_discovery(stat: DataFrame, p: str = "p", out: str = "q", scope: str = "column") -> DataFrame:
    """stat with Benjamini-Hochberg adjusted p-values, within each image column of a plane or within the whole plane.

    NULL p-values are not counted and stay NULL. The plane scope works on the counts of distinct p-values, in ranges of
    about as many of them each, so that no plane has to be sorted by one task and low p-values may be in the majority.
    """
    if scope == "column":
        key = [*PLANE, "col"]
        # one order for all three, so that rows are sorted once: those not above a p are all but those before its ties
        w = Window.partitionBy(*key).orderBy(F.col(p).desc_nulls_last())
        at = stat.withColumns({"__m": F.count(p).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__before": F.rank().over(w) - 1})
        at = at.withColumn("__i", F.col("__m") - F.col("__before"))
        q = F.min(F.when(F.col(p).isNotNull(), F.col(p) * F.col("__m") / F.col("__i"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return at.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), q))).drop("__m", "__before", "__i")
    counts = stat.where(F.col(p).isNotNull()).groupBy(*PLANE, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, PLANE, ["__p"], {"__i": F.col("__n")})
    ranked = cut(ranked.join(counts.groupBy(*PLANE).agg(F.sum("__n").alias("__m")), PLANE).withColumn("__down", -F.col("__p")))
    lows = running(ranked, PLANE, ["__down"], {"__low": F.col("__p") * F.col("__m") / F.col("__i")}, least=True)
    q = lows.select(*PLANE, "__p", F.least(F.lit(1.0), F.col("__low")).alias(out))
    return stat.withColumn("__p", F.col(p)).join(q, [*PLANE, "__p"], "left").drop("__p")


# --- permutation tests -------------------------------------------------------------------------------------------------


def _seed(*parts) -> int:
    import zlib

    return zlib.crc32("|".join(map(str, parts)).encode())


def _stencil(x: np.ndarray, queen: bool) -> np.ndarray:
    """Sum of the neighbours of each pixel of the last two axes, the border repeated."""
    pad = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    h, w = x.shape[-2:]
    steps = [(a, b) for a in range(3) for b in range(3) if (a, b) != (1, 1) and (queen or 1 in (a, b))]
    return sum(pad[..., a : a + h, b : b + w] for a, b in steps)


WHOLE = 512 * 512  # pixels of a plane that one group holds; larger planes are cut into tiles
SIDE = 256  # side of a tile


def _sized(pixels: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """(pixels of planes of up to `whole` pixels, those of larger ones or None), with the size and the sum of their plane.

    The sizes, a row for each plane, are written once: without a larger plane the pixels need not be read for them.
    """
    size = cut(pixels.groupBy(*PLANE).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.sum("value").alias("total")))
    at = pixels.select(*PLANE, "row", "col", F.col("value").cast("double").alias("value"))
    large = size.where(F.col("rows") * F.col("cols") > whole)
    return at.join(size.where(F.col("rows") * F.col("cols") <= whole), PLANE), None if large.isEmpty() else at.join(large, PLANE)


def _plane_key(pdf: pd.DataFrame, seed: int, tag: str) -> tuple:
    return seed, pdf["image_id"].iloc[0], pdf["channel"].iloc[0], tag


def _rounds(n_iter: int, block: int, which: int) -> range:
    return range(which * block, min(n_iter, (which + 1) * block))


def _shuffled(small: DataFrame | None, large: DataFrame | None, n_iter: int, block: int, seed: int, tag: str, halo: int, work, schema: str) -> DataFrame:
    """What `work` makes of shuffled planes: of each plane, or of its tiles with a halo, and a block of iterations.

    In iteration b the value of pixel i goes to place permuted(i) under a key of the plane and b. A small plane is shuffled
    inside its group. Of a large one each pixel is sent to the tiles of its new places, with one
    shuffle and no join, so a group holds a tile for a block of iterations whatever the plane's size. Results are the same.

    work(pdf of own pixels, x, planes (iterations, rows, columns), own rows and columns in them) gets pdf with total, rows
    and cols.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_iter - 1) // block)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = int(pdf["rows"].iloc[0]), int(pdf["cols"].iloc[0])
        x = np.full((rows, cols), np.nan)
        at = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        x[at] = pdf["value"]
        steps = _rounds(n_iter, block, int(pdf["block"].iloc[0]))
        planes = np.empty((len(steps), rows * cols))
        for k, b in enumerate(steps):
            planes[k, permuted(key(*_plane_key(pdf, seed, tag), b), np.arange(rows * cols), rows * cols)] = x.ravel()
        return work(pdf, x, planes.reshape(len(steps), rows, cols), *at)

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, pdf in batch.groupby([*PLANE], sort=False):
                rows, cols = int(pdf["rows"].iloc[0]), int(pdf["cols"].iloc[0])
                place = pdf["row"].to_numpy().astype(np.int64) * cols + pdf["col"].to_numpy()
                for b in range(-1 - (n_iter - 1) // block, n_iter):  # below 0: the plane as it is, for each block
                    to = place if b < 0 else permuted(key(*_plane_key(pdf, seed, tag), b), place, rows * cols)
                    r, c = to // cols, to % cols
                    ends = lambda v, n: (np.maximum(v - halo, 0) // SIDE, np.minimum(v + halo, n - 1) // SIDE)
                    (r0, r1), (c0, c1) = ends(r, rows), ends(c, cols)
                    for tr, some in ((r0, r0 >= 0), (r1, r1 > r0)):
                        for tc, more in ((c0, c0 >= 0), (c1, c1 > c0)):
                            at = np.flatnonzero(some & more)
                            if len(at):
                                yield pdf[[*PLANE, "rows", "cols", "total"]].iloc[at].assign(block=-1 - b if b < 0 else b // block, b=max(b, -1), tr=tr[at], tc=tc[at], row=r[at], col=c[at], value=pdf["value"].to_numpy()[at])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc, rows, cols = (int(pdf[c].iloc[0]) for c in ("tr", "tc", "rows", "cols"))
        r0, c0 = max(tr * SIDE - halo, 0), max(tc * SIDE - halo, 0)
        r1, c1 = min((tr + 1) * SIDE + halo, rows), min((tc + 1) * SIDE + halo, cols)
        steps = _rounds(n_iter, block, int(pdf["block"].iloc[0]))
        planes = np.full((len(steps) + 1, r1 - r0, c1 - c0), np.nan)
        b = pdf["b"].to_numpy()
        planes[np.where(b < 0, len(steps), b - steps.start), pdf["row"] - r0, pdf["col"] - c0] = pdf["value"]
        own = pdf[(b < 0) & (pdf["row"] // SIDE == tr) & (pdf["col"] // SIDE == tc)]
        return work(own, planes[-1], planes[:-1], own["row"].to_numpy() - r0, own["col"].to_numpy() - c0)

    parts = [] if small is None else [small.withColumn("block", blocks).groupBy(*PLANE, "block").applyInPandas(run, schema)]
    if large is not None:
        kinds = {f.name: f.dataType.simpleString() for f in large.schema}
        moved = f"image_id {kinds['image_id']}, channel {kinds['channel']}, rows {kinds['rows']}, cols {kinds['cols']}, total double, block int, b int, tr int, tc int, row int, col int, value double"
        parts.append(large.mapInPandas(scatter, moved).groupBy(*PLANE, "block", "tr", "tc").applyInPandas(tile, schema))
    return reduce(DataFrame.unionByName, parts)


_COUNTS = "image_id string, channel string, row int, col int, g double, n_both long, n_cold long, n_hot long, n long"


def _p_from_counts(counts: DataFrame) -> DataFrame:
    out = counts.groupBy(*PLANE, "row", "col").agg(F.first("g").alias("g"), *[F.sum(c).alias(c) for c in ("n_both", "n_cold", "n_hot", "n")])
    return out.select(*PLANE, "row", "col", "g", *[((1 + F.col(f"n_{k}")) / (1 + F.col("n"))).alias(f"p_{k}") for k in ("both", "cold", "hot")])


def _compared(pdf: pd.DataFrame, gi: np.ndarray, gp: np.ndarray) -> pd.DataFrame:
    """Counts of permuted values (iterations, pixels) beyond the observed ones of pdf's pixels."""
    out = pdf[[*PLANE, "row", "col"]].assign(g=gi)
    return out.assign(n_both=(np.abs(gp) > np.abs(gi)).sum(axis=0), n_cold=(gp < gi).sum(axis=0), n_hot=(gp > gi).sum(axis=0), n=len(gp))


def g_permutation(pixels: DataFrame, n_iter: int = 99, queen: bool = True, centre: bool = True, whole_image: bool = True, seed: int = 42, block: int = 25, whole: int = WHOLE) -> DataFrame:
    """(image_id, channel, row, col, g, p_both, p_cold, p_hot) from shuffles of the plane, or of neighbours drawn from it.

    Observed g is (neighbours + x if centre) / sum; permuted g divides by sum - x, as the definition has it. Permutations
    are keyed, so a plane of any size gives the same result as if one task held it (see `_shuffled`).
    """
    sized = _sized(pixels, whole)
    if not whole_image:
        return _p_from_counts(_drawn_neighbours(*sized, n_iter, queen, centre, seed, block))

    def work(pdf: pd.DataFrame, x: np.ndarray, planes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        total, mid = pdf["total"].to_numpy(), x[i, j]
        with np.errstate(all="ignore"):
            gi = (_stencil(x, queen)[i, j] + (mid if centre else 0)) / (total if centre else total - mid)
            return _compared(pdf, gi, ((mid if centre else 0) + _stencil(planes, queen)[:, i, j]) / (total - mid))

    return _p_from_counts(_shuffled(*sized, n_iter, block, seed, "g", 1, work, _COUNTS))


def _drawn_neighbours(small: DataFrame, large: DataFrame | None, n_iter: int, queen: bool, centre: bool, seed: int, block: int) -> DataFrame:
    """Counts against neighbours drawn from the plane: inside its group, or for a larger plane by an equi-join on pixel numbers."""
    k = 8 if queen else 4
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_iter - 1) // block)))

    def drawn(pdf: pd.DataFrame, b: int) -> np.ndarray:
        """Pixel numbers (pixels, k) that the pixels of pdf draw in iteration b."""
        rows, cols = int(pdf["rows"].iloc[0]), int(pdf["cols"].iloc[0])
        place = pdf["row"].to_numpy().astype(np.int64) * cols + pdf["col"].to_numpy()
        return draw(key(*_plane_key(pdf, seed, "drawn"), b), place[:, None] * k + np.arange(k), rows * cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full((int(pdf["rows"].iloc[0]), int(pdf["cols"].iloc[0])), np.nan)
        i, j = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        x[i, j] = pdf["value"]
        total, mid = pdf["total"].to_numpy(), x[i, j]
        with np.errstate(all="ignore"):
            gi = (_stencil(x, queen)[i, j] + (mid if centre else 0)) / (total if centre else total - mid)
            near = np.stack([x.ravel()[drawn(pdf, b)].sum(axis=1) for b in _rounds(n_iter, block, int(pdf["block"].iloc[0]))])
            return _compared(pdf, gi, ((mid if centre else 0) + near) / (total - mid))

    counted = small.withColumn("block", blocks).groupBy(*PLANE, "block").applyInPandas(run, _COUNTS)
    if large is None:
        return counted

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, pdf in batch.groupby([*PLANE], sort=False):
                for b in range(n_iter):
                    at = np.repeat(np.arange(len(pdf)), k)
                    yield pdf[[*PLANE, "row", "col"]].iloc[at].assign(b=b, of=drawn(pdf, b).ravel())

    kinds = {f.name: f.dataType.simpleString() for f in large.schema}
    asked = large.mapInPandas(ask, f"image_id {kinds['image_id']}, channel {kinds['channel']}, row int, col int, b int, of long")
    number = large.select(*PLANE, (F.col("row").cast("long") * F.col("cols") + F.col("col")).alias("of"), F.col("value").alias("picked"))
    near = asked.join(number, [*PLANE, "of"]).groupBy(*PLANE, "row", "col", "b").agg(F.sum("picked").alias("s"))
    mid = F.col("value") if centre else F.lit(0.0)
    seen = neighbourhood_sum(large, queen=queen, centre=False).withColumn("gi", F.try_divide(F.col("xns") + mid, F.col("total") if centre else F.col("total") - F.col("value")))
    gp = F.try_divide(mid + F.col("s"), F.col("total") - F.col("value"))
    met = near.join(seen, [*PLANE, "row", "col"]).withColumn("gp", gp).groupBy(*PLANE, "row", "col").agg(
        F.first("gi").alias("g"), F.count_if(F.abs("gp") > F.abs("gi")).alias("n_both"), F.count_if(F.col("gp") < F.col("gi")).alias("n_cold"), F.count_if(F.col("gp") > F.col("gi")).alias("n_hot"), F.count(F.lit(1)).alias("n")
    )
    return counted.unionByName(met)


SOME = 1 << 13  # pixels that are drawn for at once: few calls, and what is made for each stays in a core's cache
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _disc(r2: float) -> np.ndarray:
    """Whether places are in the disc, by their rows and columns from -r to r."""
    at = np.arange(-int(np.sqrt(r2)), int(np.sqrt(r2)) + 1) ** 2
    return np.add.outer(at, at) <= r2


def _disc_sums_drawn(x: np.ndarray, i: np.ndarray, j: np.ndarray, r2: float, k: int, n_iter: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of pixels i, j; sums (iterations, pixels) of k places drawn from the disc around each), some at a time.

    Places come from the square around a pixel, cut off at the ends of x, and are drawn again outside the disc; all k of a
    pixel are drawn again up to ten times for distinct ones. Each pixel needs another place in its disc. A place takes 32
    random bits: their product with the rows is a row and a fraction, which times the columns is a column.
    """
    r, (h, w) = int(np.sqrt(r2)), x.shape
    low_r, low_c = np.maximum(-r, -i), np.maximum(-r, -j)
    high_r, high_c = np.minimum(r, h - 1 - i), np.minimum(r, w - 1 - j)
    rows, cols = (high_r - low_r + 1).astype(np.uint64), (high_c - low_c + 1).astype(np.uint64)
    # places of x and of the disc in rows of one length, so that they differ by a number for each pixel
    length = max(w, 2 * r + 1)
    flat = np.pad(x, [(0, 0), (0, length - w)]).ravel()
    first, own = (i + low_r) * length + j + low_c, i * length + j
    beyond = np.pad(~_disc(r2), [(0, 0), (0, length - 2 * r - 1)])
    beyond[r, r] = True
    beyond, shift = beyond.ravel(), r * length + r - own
    cut_off = np.maximum(-low_r, high_r) ** 2 + np.maximum(-low_c, high_c) ** 2 > r2  # squares that are not wholly in the disc
    pairs = list(combinations(range(k), 2))

    def tried(of: np.ndarray, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places in x, and whether they are beyond the disc."""
        n = math.prod(shape)
        a = rng.integers(0, 1 << 64, (n + 1) // 2, np.uint64).view(np.uint32)[:n].reshape(shape).astype(np.uint64)
        a *= rows[of]
        b = a & _LOW
        b *= cols[of]
        a >>= _HALF
        b >>= _HALF
        a *= np.uint64(length)
        a += b
        place = a.view(np.int64)
        place += first[of]
        return place, beyond.take(place + shift[of]) if cut_off[of].any() else place == own[of]

    def drawn(of: np.ndarray) -> np.ndarray:
        place, out = tried(of, (k, len(of)))
        again, flat_place = np.flatnonzero(out), place.ravel()
        while len(again):
            # few are drawn four times at once, of which the first in the disc counts
            more, out = tried(of[again % len(of)], (1 if len(again) > SOME else 4, len(again)))
            best = more[0]
            for n in range(1, len(more)):
                best = np.where(out[0], more[n], best)
                out[0] &= out[n]
            flat_place[again] = best
            again = again[out[0]]
        return place

    for lo in range(0, len(i), SOME):
        at = np.arange(lo, min(lo + SOME, len(i)))
        steps = max(1, SOME // len(at))
        for done in range(0, n_iter, steps):
            of = np.tile(at, min(steps, n_iter - done))
            pick = drawn(of)
            bad = np.arange(len(of))
            for _ in range(10):
                some = (pick if len(bad) == len(of) else pick[:, bad]).astype(np.int32)
                twice = np.zeros(len(bad), bool)
                for n, m in pairs:
                    twice |= some[n] == some[m]
                bad = bad[twice]
                if not len(bad):
                    break
                pick[:, bad] = drawn(of[bad])
            yield at, flat.take(pick).sum(axis=0).reshape(-1, len(at))


def _disc_tests(pixels: DataFrame, radii: list[float], n_iter: int, queen: bool, seed: int, tile: int = 0) -> DataFrame:
    """(image_id, channel, row, col, then g0, p_both0, p_cold0, p_hot0, g1 ...): permutation G in the disc of each radius + 0.5.

    The plane is cut into tiles with the halo of the largest radius, so a group is bounded whatever the image's size, and a
    pixel is settled for all radii in the group that holds it. Memory goes with the pixels of a tile, not with the disc.
    Groups are dealt out to as many tasks as a shuffle has, however few bytes they are.
    """
    r = int(np.floor(max(radii) + 0.5))
    side = tile or max(32, 4 * r)
    near = lambda at: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - r - 1) / side)), F.floor((F.col(at) + r + 1) / side)))
    t = pixels.select(*PLANE, "row", "col", "value").withColumn("tr", near("row")).withColumn("tc", near("col"))
    names = [[f"{c}{n}" for c in ("g", "p_both", "p_cold", "p_hot")] for n in range(len(radii))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        x = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        x[pdf["row"] - r0, pdf["col"] - c0] = pdf["value"]
        own = pdf[(pdf["row"] // side == tr) & (pdf["col"] // side == tc)].sort_values(["row", "col"])
        out = own[[*PLANE, "row", "col"]].copy()
        i, j = (own["row"] - r0).to_numpy(), (own["col"] - c0).to_numpy()
        for radius, (g, *ps) in zip(radii, names):
            r2 = (radius + 0.5) ** 2
            k = min(8 if queen else 4, np.count_nonzero(_disc(r2)) - 1)
            rng = np.random.default_rng(_seed(seed, *(pdf[c].iloc[0] for c in PLANE), tr, tc, "disc", radius))
            some = np.flatnonzero(_disc_totals(np.ones(x.shape), r2)[i, j] > 1)
            total, mid = _disc_totals(np.nan_to_num(x), r2)[i, j], x[i, j]
            beyond = np.zeros((3, len(own)), int)

            def compare(at: np.ndarray, gp: np.ndarray, times: int = 1) -> None:
                seen = gi[at]
                beyond[:, at] += [times * v.sum(axis=0) for v in (np.abs(gp) > np.abs(seen), gp < seen, gp > seen)]

            with np.errstate(all="ignore"):
                gi = _stencil(x, queen)[i, j] / total
                if k:
                    alone = np.setdiff1d(np.arange(len(own)), some)
                    compare(alone, (mid / total)[None, alone], n_iter)
                    for at, sums in _disc_sums_drawn(x, i[some], j[some], r2, k, n_iter, rng):
                        at = some[at]
                        compare(at, (mid[at] + sums) / total[at])
            out[g] = gi
            for p, n in zip(ps, beyond):
                out[p] = (1 + n) / (1 + n_iter)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    keys = [*PLANE, "tr", "tc"]
    dealt = t.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in (*PLANE, "row", "col")], *[f"{c} double" for four in names for c in four]]))


def g_disc_permutation(pixels: DataFrame, radius: float, n_iter: int = 99, queen: bool = True, seed: int = 42, tile: int = 0) -> DataFrame:
    """As g_permutation with neighbours drawn from the disc of radius + 0.5 around each pixel (up to ten tries for distinct ones).

    Observed g lacks the centre, permuted g has it; both divide by the disc's sum. For tiles and memory see `_disc_tests`.
    """
    at = _disc_tests(pixels, [radius], n_iter, queen, seed, tile)
    return at.select(*PLANE, "row", "col", *[F.col(f"{c}0").alias(c) for c in ("g", "p_both", "p_cold", "p_hot")])


def g_radii(pixels: DataFrame, radii: tuple[float, ...] = (10, 25, 50, 100), n_iter: int = 99, merge: str = "min", queen: bool = True, seed: int = 42, **options) -> DataFrame:
    """Permutation G over several radii (-1: the whole plane), merged by pixel: means, or for each test the least p and its g.

    All discs of a pixel are settled in one group; further options are those of g_permutation, for the whole plane.
    """
    ps = ("p_both", "p_cold", "p_hot")
    discs, key = [radius for radius in radii if radius >= 0], [*PLANE, "row", "col"]
    every, at = _disc_tests(pixels, discs, n_iter, queen, seed) if discs else pixels.select(*key), iter(range(len(discs)))
    names = [next(at) if radius >= 0 else "_whole" for radius in radii]
    if len(discs) < len(radii):
        whole = g_permutation(pixels, n_iter, queen=queen, seed=seed, **options)
        every = every.join(whole.select(*[F.col(c).alias(c) for c in key], *[F.col(c).alias(f"{c}_whole") for c in ("g", *ps)]), key)
    if merge == "mean":
        mean = lambda c: F.try_divide(reduce(Column.__add__, [F.coalesce(f"{c}{n}", F.lit(0.0)) for n in names]), reduce(Column.__add__, [F.col(f"{c}{n}").isNotNull().cast("int") for n in names]))
        return every.select(*key, *[mean(c).alias(c) for c in ("g", *ps)])
    tests = lambda p: F.array(*[F.struct(F.col(f"{p}{n}").alias("p"), F.lit(pos).alias("pos"), F.col(f"g{n}").alias("g")) for pos, n in enumerate(names)])
    best = every.select(*key, *[F.array_min(tests(p)).alias(p) for p in ps])
    return best.select(*key, *[F.col(p)["g"].alias(f"g_{p[2:]}") for p in ps], *[F.col(p)["p"].alias(p) for p in ps])


def h_permutation(pixels: DataFrame, n_iter: int = 99, queen: bool = True, seed: int = 42, block: int = 25, whole: int = WHOLE) -> DataFrame:
    """(image_id, channel, row, col, h, p): the plane is shuffled, each pixel's true value is put back, h is taken there.

    With the residual e of a shuffled plane and d = true - shuffled value, putting a value back changes the residuals of
    a neighbourhood to e - d / w1 (centre: e + d - d / w1), so all pixels follow from stencil sums of e and e squared.
    Planes of any size, as in g_permutation. A plane of up to `whole` pixels is settled in its group, which has the mean
    square of its residuals; for a larger one that of each iteration is summed up first.
    """
    w1 = 9.0 if queen else 5.0
    small, large = _sized(pixels, whole)

    def residual(v: np.ndarray) -> np.ndarray:
        return v - (_stencil(v, queen) + v) / w1

    def put_back(x: np.ndarray, planes: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of squares around the pixels: of x, and of each iteration with the pixel's value put back."""
        d, own = (x - planes)[:, i, j] / w1, residual(x)
        tops = _stencil(e * e, queen)[:, i, j] - 2 * d * _stencil(e, queen)[:, i, j] + (w1 - 1) * d**2 + (e[:, i, j] + d * w1 - d) ** 2
        return (_stencil(own * own, queen) + own * own)[i, j], tops

    def settled(pdf: pd.DataFrame, x: np.ndarray, planes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        e = residual(planes)
        seen, tops = put_back(x, planes, e, i, j)

        def share(top: np.ndarray, s: np.ndarray) -> np.ndarray:
            s = s / len(pdf) * w1
            return np.divide(top, s, out=np.full(top.shape, np.nan), where=s != 0)

        own = share(seen, (residual(x)[i, j] ** 2).sum(keepdims=True))
        more = (share(tops, (e[:, i, j] ** 2).sum(axis=1, keepdims=True)) > own).sum(axis=0)
        return pdf[[*PLANE, "row", "col"]].assign(own=pd.Series(own, pdf.index).astype(object).where(~np.isnan(own), None), more=more, n=len(planes))

    counts = "image_id string, channel string, row int, col int, own double, more long, n long"
    of_pixels = lambda counted: counted.groupBy(*PLANE, "row", "col").agg(F.first("own").alias("h"), ((1 + F.sum("more")) / (1 + F.sum("n"))).alias("p"))
    counted = _shuffled(small, None, n_iter, block, seed, "h", 2, settled, counts)
    if large is None:
        return of_pixels(counted)

    def squares(pdf: pd.DataFrame, x: np.ndarray, planes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        every = np.concatenate([residual(planes)[:, i, j] ** 2, residual(x)[None, i, j] ** 2]).sum(axis=1) if len(pdf) else np.zeros(0)
        which = int(pdf["block"].iloc[0]) if len(pdf) else 0
        b = [*_rounds(n_iter, block, which), -1 - which] if len(pdf) else []
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1].repeat(len(b)).to_numpy(), "channel": pdf["channel"].iloc[:1].repeat(len(b)).to_numpy(), "b": b, "s": every})

    # a row for each plane and iteration; negative numbers are the plane as it is, once for each block
    sums = _shuffled(None, large, n_iter, block, seed, "h", 2, squares, "image_id string, channel string, b int, s double").groupBy(*PLANE, "b").agg(F.sum("s").alias("s"))
    means = sums.groupBy(*PLANE).agg(F.map_from_entries(F.collect_list(F.struct("b", "s"))).alias("m")).select(*PLANE, F.transform(F.sequence(F.lit(-1), F.lit(n_iter - 1)), lambda b: F.element_at("m", b)).alias("squares"))

    def work(pdf: pd.DataFrame, x: np.ndarray, planes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*PLANE, "row", "col", "b", "top"])
        steps = _rounds(n_iter, block, int(pdf["block"].iloc[0]))
        seen, top = put_back(x, planes, residual(planes), i, j)
        return pdf[[*PLANE, "row", "col"]].assign(first=steps.start, seen=seen, tops=list(np.ascontiguousarray(top.T)))

    tops = _shuffled(None, large, n_iter, block, seed, "h", 2, work, "image_id string, channel string, row int, col int, first int, seen double, tops array<double>")
    n = large.select(*PLANE, (F.col("rows").cast("double") * F.col("cols")).alias("size")).groupBy(*PLANE).agg(F.first("size").alias("size"))
    at = tops.join(means, PLANE).join(n, PLANE)
    h = lambda top, s: F.try_divide(top, s / F.col("size") * w1)
    at = at.withColumn("own", h(F.col("seen"), F.col("squares")[0]))
    more = F.size(F.filter(F.transform("tops", lambda t, k: h(t, F.get("squares", F.col("first") + k + 1)) > F.col("own")), lambda v: v))
    return of_pixels(counted.unionByName(at.select(*PLANE, "row", "col", "own", more.cast("long").alias("more"), F.size("tops").cast("long").alias("n"))))


def h_statistic(pixels: DataFrame, n_iter: int = 99, queen: bool = True, seed: int = 42) -> DataFrame:
    """(image_id, channel, row, col, hz, p): the normalised H with its chi-square p (n_iter 0) or the permuted one."""
    key = [*PLANE, "row", "col"]
    if n_iter == 0:
        return h_with_p(pixels, queen=queen).select(*key, "hz", "p")
    return h_classical(pixels, queen).select(*key, "hz").join(h_permutation(pixels, n_iter, queen, seed).select(*key, "p"), key)


def g_statistic(pixels: DataFrame, n_iter: int = 0, radius: float | tuple[float, ...] | None = None, types: int = HOT | COLD | BOTH, queen: bool = True, centre: bool = True, whole_image: bool = True, merge: str = "min", seed: int = 42, kernel: Kernel | None = None) -> DataFrame:
    """G with p-values by the way that the options name: analytic (n_iter 0) or permuted, global, in one disc or in several.

    Permutations take the neighbours of queen or rook only, not a kernel.
    """
    if n_iter and kernel is not None:
        raise ValueError("permutations take queen or rook neighbours, not a kernel")
    if n_iter == 0:
        if isinstance(radius, (tuple, list)):
            raise ValueError("several radii need permutations")
        g = g_classical(pixels, queen, centre, kernel=kernel) if radius is None else g_radius(pixels, radius, queen, centre, kernel=kernel)
        return with_p(g.drop("value"), types)
    if isinstance(radius, (tuple, list)):
        return g_radii(pixels, tuple(radius), n_iter, merge, queen=queen, seed=seed)
    out = g_permutation(pixels, n_iter, queen, centre, whole_image, seed) if radius is None else g_disc_permutation(pixels, radius, n_iter, queen, seed)
    return out.drop(*({"p_both", "p_cold", "p_hot"} - set(split_types(types))))
