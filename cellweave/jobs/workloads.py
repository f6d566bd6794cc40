"""The three main jobs: marker location, boundary what-if and jitter-robust intensity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import cells, hotspot, polar, scores, shapes, stencil
from cellweave.sources.lineage import cut


def hot_spot_planes(pixels: DataFrame, fdr: bool = True, **options) -> DataFrame:
    """Planes {channel}, {channel}_GP (two-sided p) and {channel}_GPhot, adjusted within image columns when fdr."""
    one_pass = not options.get("n_iter")  # then g keeps the pixels' other columns, and pixels need not be made twice
    g = hotspot.g_statistic(pixels.withColumn("__value", F.col("value")) if one_pass else pixels, types=hotspot.HOT | hotspot.BOTH, **options)
    if fdr:
        g = hotspot.false_discovery(hotspot.false_discovery(g, "p_both", "p_both"), "p_hot", "p_hot")
    plane = lambda name, value: F.struct(name.alias("c"), F.col(value).alias("v"))
    made = F.array(plane(F.concat("channel", F.lit("_GP")), "p_both"), plane(F.concat("channel", F.lit("_GPhot")), "p_hot"))
    if one_pass:  # pixels without a channel are of no plane that has a statistic
        made = F.concat(F.array(plane(F.col("channel"), "__value")), F.when(F.col("channel").isNotNull(), made).otherwise(F.slice(made, 1, 0)))
    long = g.select("image_id", "row", "col", F.explode(made).alias("p")).select("image_id", F.col("p.c").alias("channel"), "row", "col", F.col("p.v").alias("value"))
    return long if one_pass else pixels.unionByName(long)


def calculate_features(pixels: DataFrame, mask: DataFrame, include_scores: bool = False, weighted: bool = False, include_weights: bool = False, min_pval: float = 0.1, offset: float = 0.1, qs: tuple[float, ...] = cells.QUANTILES, calc_hle: bool = False, calc_coreedgediff: bool = False, **options) -> DataFrame:
    """Features of every cell and plane; with include_scores also MEAN_GP_SCORE, EDGE_GP_SCORE and CORE_GP_SCORE.

    Scores hold a plane's mean against its mean two-sided p-value; all three use the point found for MEAN. weighted adds
    the features of planes {channel}_weighted, values times p-weights, include_weights those of {channel}_weights, the
    p-weights themselves.
    """
    edge = stencil.perimeter(mask)
    planes = hot_spot_planes(pixels, **options)
    if weighted or include_weights:
        planes = cut(planes)
        hot = planes.where(F.col("channel").endswith("_GPhot")).select("image_id", "row", "col", F.regexp_replace("channel", "_GPhot$", "").alias("channel"), F.col("value").alias("p_hot"))
        w = pixels.join(cells.p_weights(hot, "p_hot", min_pval, offset), ["image_id", "channel", "row", "col"])
        for asked, name, value in ((weighted, "_weighted", F.col("value") * F.col("weight")), (include_weights, "_weights", F.col("weight"))):
            if asked:
                planes = planes.unionByName(w.select("image_id", F.concat("channel", F.lit(name)).alias("channel"), "row", "col", value.alias("value")))
    f = cells.features(planes, edge, qs)
    if calc_hle:
        f = f.join(cells.hodges_lehmann(planes, edge), cells.KEY, "left")
    if calc_coreedgediff:
        f = f.join(cells.core_edge_difference(planes, edge), cells.KEY, "left")
    if not include_scores:
        return f
    f = cut(f)  # the scores read it nine times
    both = f.where(F.col("channel").endswith("_GP")).select("image_id", "ObjectNumber", F.regexp_replace("channel", "_GP$", "").alias("channel"), *[F.col(c).alias(f"p_{c}") for c in ("MEAN", "EDGE_MEAN", "CORE_MEAN")])
    own = f.where(~F.col("channel").rlike("_(GP|GPhot|weighted|weights)$")).join(both, cells.KEY)
    peak = cut(scores.smooth_max(own.select("image_id", "channel", "ObjectNumber", F.col("MEAN").alias("x"), F.col("p_MEAN").alias("y"))))
    made = [scores.score(own.withColumn("x", F.col(c)), peak, f"p_{c}", "s").select(*cells.KEY, F.col("s").alias(f"{c.removesuffix('_MEAN')}_GP_SCORE")) for c in ("MEAN", "EDGE_MEAN", "CORE_MEAN")]
    s = reduce(lambda a, b: a.join(b, cells.KEY), made)
    return f.join(s, cells.KEY, "left").withColumn("SCORE_DIFF", F.col("CORE_GP_SCORE") - F.col("EDGE_GP_SCORE")).withColumn("AREA_MIN_EDGE_CORE", F.least("AREA_EDGE", "AREA_CORE"))


def marker_location(pixels: DataFrame, mask: DataFrame, min_p: float = 0.75, low: float = 0.5, high: float = 1.0, n_bootstrap: int = 1000, **options) -> DataFrame:
    """Image to marker location, end to end."""
    f = calculate_features(pixels, mask, include_scores=True, **options).where(F.col("CORE_GP_SCORE").isNotNull())
    c = f.select("image_id", "channel", "ObjectNumber", F.col("EDGE_GP_SCORE").alias("edge"), F.col("CORE_GP_SCORE").alias("core"), F.col("AREA").cast("double").alias("AREA"), "AREA_EDGE", "AREA_CORE")
    return scores.marker_location(c, low, high, min_p=min_p, n_bootstrap=n_bootstrap)


def boundary_what_if(pixels: DataFrame, mask: DataFrame, mask_nuc: DataFrame, n_angles: int = 8, rmax: int = 12, dmax: int = 3, maxdist: int | None = None, maxp: float = 0.4, how: str = "all") -> DataFrame:
    """Summaries over boundary shapes for each cell and channel; shapes are never rows. maxdist is dmax where not given."""
    members = polar.membership(mask, mask_nuc)
    profile = polar.radial(pixels, cells.boxes(mask_nuc).select("image_id", "ObjectNumber", "x", "y"), polar.lookup(n_angles, rmax), members, (n_angles, rmax))
    keep = cut(profile.where((F.col("channel") == "own_nucleus") | ~F.col("channel").rlike("_(cell|nucleus)$")))
    return shapes.what_if_summaries(keep, n_angles, dmax, 0.0, maxp, maxdist, how)
