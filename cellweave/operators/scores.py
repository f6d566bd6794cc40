"""Scores of cells against a channel's smooth maximum, and marker locations with bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.keyed import resampled_pieces
from cellweave.operators.ordered import running
from cellweave.sources.lineage import cut

PLANE = ["image_id", "channel"]


def smooth_max(xy: DataFrame, max_dist: float = 10.0, min_dist: float = 25.0, minp: float = 0.01) -> DataFrame:
    """(image_id, channel, x0, y0): where the highest y of a channel lie. NULL for ten cells or fewer.

    The cells with a y are put in ascending order of (y, ObjectNumber), y to 13 digits: means of the same values added up
    in another order are the same. x0 is the upper median of x from place
    round(0.95 n) on; y0 is the mean of y around x0 with triangular weights.
    """
    some = xy.where("x is not null and y is not null")
    n = some.groupBy(*PLANE).agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.lit(0.99)).alias("q99"))
    at = some.join(n, PLANE)
    rank = F.row_number().over(Window.partitionBy(*PLANE).orderBy(F.format_string("%.12e", F.col("y").cast("double")).cast("double"), "ObjectNumber"))
    top = at.withColumn("rank", rank).where(F.col("rank") > F.rint(0.95 * F.col("n")))
    order = Window.partitionBy(*PLANE).orderBy("x")
    mid = top.withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*PLANE)))
    x0 = mid.where("i = m div 2 and n > 10").select(*PLANE, F.col("x").alias("x0"))
    near = at.join(x0, PLANE).withColumn("d", F.abs(F.col("x") - F.col("x0")))
    width = near.groupBy(*PLANE).agg(F.percentile("d", F.lit(minp)).alias("dq"), F.first("q99").alias("q")).select(*PLANE, F.greatest(F.least(F.col("dq"), F.col("q") / max_dist), F.col("q") / min_dist).alias("width"))
    w = F.greatest(F.lit(0.0), 1 - F.try_divide("d", "width"))
    y0 = near.join(width, PLANE).groupBy(*PLANE).agg(F.try_divide(F.sum(w * F.col("y")), F.sum(w)).alias("y0"), F.first("x0").alias("x0"))
    return n.select(*PLANE).join(y0, PLANE, "left").select(*PLANE, "x0", "y0")


def _widths(ranked: DataFrame, max_dist: float, min_dist: float, minp: float) -> DataFrame:
    """(PLANE, id, width) of points with their rank in x: the minp-quantile of distances, cut to q99 / min_dist .. q99 / max_dist.

    The j nearest values to a point and itself are a run of j + 1 neighbours in order: the one whose ends lie about the
    point. Runs are sorted by the sum of their ends, in which the point's place is found by counting.
    """
    size = ranked.groupBy(*PLANE).agg(F.count(F.lit(1)).alias("n"))
    at = ranked.join(size, PLANE)
    pos = lambda p: F.lit(p) * (F.col("n") - 1)
    part = pos(0.99) - F.floor(pos(0.99))
    top = F.when(F.col("rank") == F.floor(pos(0.99)), F.col("x") * (1 - part)).when(F.col("rank") == F.floor(pos(0.99)) + 1, F.col("x") * part)
    q99 = at.groupBy(*PLANE).agg(F.sum(top).alias("q99"))
    both = at.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.least(F.floor(pos(minp)) + F.col("more"), F.col("n") - 1))
    ends = ranked.select(*PLANE, F.col("rank").alias("last"), F.col("x").alias("high"))
    runs = cut(both.withColumn("last", F.col("rank") + F.col("j")).join(ends, [*PLANE, "last"]).select(*PLANE, "more", F.col("rank").alias("first"), F.col("x").alias("low"), "high"))
    table = runs.select(*PLANE, "more", (F.col("low") + F.col("high")).alias("key"), F.lit(1).alias("kind"), F.col("first").alias("at"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("long").alias("runs"))
    asked = both.select(*PLANE, "more", (2 * F.col("x")).alias("key"), F.lit(0).alias("kind"), F.col("rank").alias("at"), "x", (F.col("n") - F.col("j")).alias("runs"))
    found = running(table.unionByName(asked), [*PLANE, "more"], ["key", "kind", "at"], {"below": F.col("kind").cast("long")}).where("kind = 0")
    near = lambda d: F.greatest(F.lit(0), F.least(F.col("below") + d, F.col("runs") - 1))
    found = found.select(*PLANE, "more", "x", F.col("at").alias("rank"), F.explode(F.array_distinct(F.array(near(-1), near(0)))).alias("first")).join(runs, [*PLANE, "more", "first"])
    far = F.greatest(F.abs(F.col("x") - F.col("low")), F.abs(F.col("high") - F.col("x")))
    dist = found.groupBy(*PLANE, "rank").agg(*[F.min(F.when(F.col("more") == k, far)).alias(f"d{k}") for k in (0, 1)])
    part = pos(minp) - F.floor(pos(minp))
    dq = F.col("d0") * (1 - part) + F.col("d1") * part
    return dist.join(size, PLANE).join(q99, PLANE).select(*PLANE, "rank", F.greatest(F.least(dq, F.col("q99") / max_dist), F.col("q99") / min_dist).alias("width"))


def smoothed(xy: DataFrame, max_dist: float = 10.0, min_dist: float = 25.0, minp: float = 0.01) -> DataFrame:
    """xy with ys: y smoothed over x with a triangular kernel of each point's own width (x >= 0).

    The kernel is linear on either side of a point, so sums over it follow from running sums of 1, x, y and xy up to its
    ends and its middle: three look-ups for each point, however many neighbours it has, and no pair of points is made.
    A channel of an image may have any share of the points. NULL where the width is 0.
    """
    some = xy.where("x is not null and y is not null").select(*PLANE, "ObjectNumber", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ranked = cut(running(some, PLANE, ["x", "ObjectNumber"], {"rank": F.lit(1).cast("long")}).withColumn("rank", F.col("rank") - 1))
    at = cut(ranked.join(_widths(ranked, max_dist, min_dist, minp), [*PLANE, "rank"]))
    sums = {"s1": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxy": F.col("x") * F.col("y")}
    table = ranked.select(*PLANE, F.col("x").alias("key"), F.lit(0).alias("side"), "rank", *[v.alias(k) for k, v in sums.items()])
    sides = F.explode(F.array(*[F.struct((F.col("x") + k * F.col("width")).alias("key"), F.lit(k + 2).alias("side")) for k in (-1, 0, 1)])).alias("q")
    asked = at.select(*PLANE, "rank", sides).select(*PLANE, "q.key", "q.side", "rank", *[F.lit(0.0).alias(k) for k in sums])
    found = running(table.unionByName(asked), PLANE, ["key", "side", "rank"], {f"u{k}": F.col(k) for k in sums}).where("side > 0")
    found = found.groupBy(*PLANE, "rank").agg(*[F.max(F.when(F.col("side") == side, F.col(f"u{k}"))).alias(f"{k}_{side}") for k in sums for side in (1, 2, 3)])
    left, right = (lambda k: F.col(f"{k}_2") - F.col(f"{k}_1")), (lambda k: F.col(f"{k}_3") - F.col(f"{k}_2"))
    by = F.try_divide("x", "width")
    over = lambda one, x: (1 - by) * left(one) + F.try_divide(left(x), "width") + (1 + by) * right(one) - F.try_divide(right(x), "width")
    ys = at.join(found, [*PLANE, "rank"]).select(*PLANE, "ObjectNumber", F.try_divide(over("sy", "sxy"), over("s1", "sx")).alias("ys"))
    return xy.join(ys, [*PLANE, "ObjectNumber"], "left")


def score(xy: DataFrame, peak: DataFrame, y: str = "y", out: str = "score") -> DataFrame:
    """xy with 1 - y / max(y), where y above y0, or left of x0, counts as y0. NULL where the peak is."""
    at = xy.join(peak, PLANE, "left")
    cut = F.when(F.col("x0").isNotNull(), F.when((F.col(y) > F.col("y0")) | (F.col("x") < F.col("x0")), F.col("y0")).otherwise(F.col(y)))
    at = at.withColumn("__y", cut)
    top = at.groupBy(*PLANE).agg(F.max("__y").alias("__top"))
    return at.join(top, PLANE).withColumn(out, 1 - F.try_divide("__y", "__top")).drop("__y", "__top", "x0", "y0")


def band(cells: DataFrame, edge: str = "edge", core: str = "core", low: float = 0.5, high: float = 1.0, min_area: float | None = None) -> DataFrame:
    """Cells whose edge or core is above low and both are below high; with min_area, also a smaller area of the two above it."""
    keep = ((F.col(edge) > low) | (F.col(core) > low)) & (F.col(edge) < high) & (F.col(core) < high)
    return cells.where(keep if min_area is None else keep & (F.least("AREA_EDGE", "AREA_CORE") > min_area))


def weighted_share(values: DataFrame) -> DataFrame:
    """(image_id, channel, n, proportion): the share of weight with value > 0; 0 where there is no weight."""
    pos = F.sum(F.when(F.col("value") > 0, F.col("weight")).otherwise(0.0))
    return values.groupBy(*PLANE).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(pos, F.sum("weight")), F.lit(0.0)).alias("proportion"))


def bootstrap_share(values: DataFrame, n_bootstrap: int = 1000, alpha: float = 0.05, seed: int = 42, part: int = 1 << 26, draws: int = 1 << 31) -> DataFrame:
    """(image_id, channel, ci_low, ci_high): percentile interval of the weighted share over resamples of n out of n values.

    Draws are keyed by seed, image, channel and resample, over values in order of ObjectNumber, value and weight. Values are
    numbered in that order, packed into blocks (a code for each value beside the weights that codes stand for) and sent once
    for each sixteenth of the resamples at most, once for all of them where they are few. A group is a run of at most `part`
    numbers of a channel, so one for most; at most 4,194,304 where weights are so many that codes save nothing. It makes all
    draws of its resamples, which takes no value, and adds up those that fall into its run, so it is bounded whatever share
    of the values a channel has; what leaves it is a row of sums for each resample.
    """
    block, few, most = min(part, 1 << 18), 1 << 12, 16

    def pack(rows: pa.Table) -> pa.Table:
        k, value, weight = (rows.column(c).to_numpy() for c in ("k", "value", "weight"))
        code, weights = pd.factorize(weight.astype(float), use_na_sentinel=False)
        codes = np.empty(len(k), np.min_scalar_type(max(2 * len(weights) - 1, 0)))
        codes[k % block] = 2 * code + (value.astype(float) > 0)
        made = {"size": [len(k)], "kinds": [2 * len(weights)], "codes": [codes.tobytes()], "weights": [weights.tobytes()]}
        return pa.table({c: rows.column(c).slice(0, 1) for c in (*PLANE, "block")} | made)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        n, of, at = (int(pdf[c].iloc[0]) for c in ("n", "chunks", "chunk"))
        first, prefix = int(pdf["block"].iloc[0]) * block, "|".join(map(str, (seed, *pdf[PLANE].iloc[0])))
        tables = [np.frombuffer(x) for x in pdf["weights"]]
        code, weights = pd.factorize(np.concatenate(tables), use_na_sentinel=False)
        both = np.empty(2 * len(weights), complex)  # weight with value > 0, and all, in one look-up
        both.real, both.imag = np.column_stack([np.zeros(len(weights)), weights]).ravel(), np.repeat(weights, 2)
        codes = np.empty(int(pdf["size"].sum()), np.min_scalar_type(max(len(both) - 1, 0)))
        lo = done = 0
        for x, table, size in zip(pdf["codes"], tables, pdf["size"]):
            mine = 2 * np.repeat(code[lo : lo + len(table)], 2) + np.tile([0, 1], len(table))
            codes[done : done + size] = mine[np.frombuffer(x, np.min_scalar_type(max(2 * len(table) - 1, 0)))]
            lo, done = lo + len(table), done + size
        coded = bool(pdf["coded"].iloc[0])
        held = codes if coded else both[codes]
        chosen = range(at * n_bootstrap // of, (at + 1) * n_bootstrap // of)
        drawn = np.zeros(len(chosen), complex)
        for i, b in enumerate(chosen):
            times = np.zeros(len(both), np.int64)
            for k in resampled_pieces(f"{prefix}|{b}", n):
                if len(held) < n:
                    k = k[(k >= first) & (k < first + len(held))] - first
                got = held.take(k, mode="wrap")
                if coded:
                    times += np.bincount(got, minlength=len(both))
                else:
                    drawn[i] += got.sum()
            if coded:
                drawn[i] = (both[times > 0] * times[times > 0]).sum()
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "channel": pdf["channel"].iloc[0], "b": chosen, "some": drawn.real, "every": drawn.imag})

    ranked = running(values.select(*PLANE, "ObjectNumber", "value", "weight"), PLANE, ["ObjectNumber", "value", "weight"], {"rank": F.lit(1).cast("long")})
    ranked = ranked.select(*PLANE, (F.col("rank") - 1).alias("k"), F.expr(f"(rank - 1) div {block}").alias("block"), "value", "weight")
    blocks = cut(ranked.groupBy(*PLANE, "block").applyInArrow(pack, "image_id string, channel string, block long, size long, kinds long, codes binary, weights binary"))
    sizes = blocks.groupBy(*PLANE).agg(F.sum("size").alias("n"), F.max("kinds").alias("kinds"))
    # as many chunks of the resamples as keep a group near that many draws
    sizes = sizes.select(*PLANE, "n", F.expr(f"n > 65536 and kinds <= {few}").alias("coded"), F.expr(f"least({min(most, n_bootstrap)}, ceil(n * {n_bootstrap} / {draws}))").alias("chunks"))
    at = blocks.drop("kinds").join(sizes, PLANE).withColumn("part", F.when(F.col("coded"), F.expr(f"block div {part // block}")).otherwise(F.expr(f"block div {max(1, min(part, 1 << 22) // block)}")))
    keys = [*PLANE, "part", "chunk"]
    at = at.join(values.sparkSession.range(most).withColumnRenamed("id", "chunk"), F.col("chunk") < F.col("chunks"))
    at = at.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    sums = at.groupBy(*keys).applyInPandas(run, "image_id string, channel string, b int, some double, every double")
    share = sums.groupBy(*PLANE, "b").agg(F.sum("some").alias("some"), F.sum("every").alias("every")).withColumn("s", F.when(F.col("some") > 0, F.col("some") / F.col("every")).otherwise(0.0))
    q = share.groupBy(*PLANE).agg(F.percentile("s", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return q.select(*PLANE, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def location_rule(shares: DataFrame, min_p: float = 0.5) -> DataFrame:
    """shares with location: Nuclear if the interval lies above min_p, Membrane if below 1 - min_p, else Whole_cell."""
    return shares.withColumn("location", F.when(F.col("ci_low") > min_p, "Nuclear").when(F.col("ci_high") < 1 - min_p, "Membrane").otherwise("Whole_cell"))


def marker_location(cells: DataFrame, low: float = 0.5, high: float = 1.0, alpha: float = 0.05, min_p: float = 0.5, n_bootstrap: int = 1000, min_area: float | None = None, seed: int = 42) -> DataFrame:
    """(image_id, channel, location, n, proportion, ci_low, ci_high) from cells (ObjectNumber, edge, core, AREA...).

    Values are core - edge; weights are the smaller area of edge and core, scaled so that they add up to the number of cells.
    """
    kept = band(cells, low=low, high=high, min_area=min_area).withColumn("value", F.col("core") - F.col("edge"))
    area = F.least("AREA_EDGE", "AREA_CORE")
    size = kept.groupBy(*PLANE).agg(F.try_divide(F.count(F.lit(1)), F.sum(area)).alias("k"))
    v = kept.join(size, PLANE).select(*PLANE, "ObjectNumber", "value", F.coalesce(area * F.col("k"), F.lit(0.0)).alias("weight"))
    out = weighted_share(v).join(bootstrap_share(v, n_bootstrap, alpha, seed), PLANE)
    return location_rule(out, min_p).select(*PLANE, "location", "n", "proportion", "ci_low", "ci_high")
