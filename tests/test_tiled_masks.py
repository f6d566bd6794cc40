from pyspark.sql import functions as F

from cellweave.operators import affine, stencil
from cellweave.sources.images import PIXEL


def test_masks_are_painted_and_closed_in_tiles(spark):
    """70 x 70 pixels lie in four tiles; cells of 5 x 7 pixels touch, so painting order and closing both matter."""
    side, n = 70, 3
    grid = spark.range(side * side).select(F.lit("i").alias("image_id"), F.expr(f"int(id div {side})").alias("row"), F.expr(f"int(id % {side})").alias("col"))
    mask = grid.withColumn("label", F.expr("IF(row BETWEEN 40 AND 69 AND col BETWEEN 42 AND 69, 1 + int((row - 40) div 5) * 4 + int((col - 42) div 7), 0)"))
    pixels = grid.select(F.lit("i").alias("image_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("channel"), "row", "col", F.expr("double((row * 31 + col * 17) % 97)").alias("value"))
    got = affine.random_masks(mask, n, pad=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # closing sorted every pixel of every mask four times
    # the same step by step
    cells = mask.where("label <> 0").select("image_id", F.col("label").alias("ObjectNumber")).distinct()
    jitter = affine.random_transforms(cells.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), 42)
    order = affine._hashed("image_id", "iter", "ObjectNumber", F.lit("42:paint"))
    labels = affine.warped(mask, jitter, 2).groupBy("image_id", "iter", "row", "col").agg(F.max_by("ObjectNumber", F.struct(order, "ObjectNumber")).alias("label"))
    full = mask.select(*PIXEL).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(labels, ["image_id", "iter", "row", "col"], "left").fillna(0, ["label"])
    want = stencil.closing(full, ["image_id", "iter"])
    rows = lambda df: sorted(map(tuple, df.select("iter", "row", "col", "label").collect()))
    assert rows(got) == rows(want) and len({r[3] for r in rows(got)}) == 25
    means = want.where("label <> 0").join(pixels, PIXEL).groupBy("label", "iter", "channel").agg(F.avg("value").alias("m")).groupBy("label", "channel").agg(F.median("m").alias("m"))
    medians = affine.affine_medians(pixels, mask, n, pad=2).select("ObjectNumber", "channel", "median")
    assert sorted((a, b, round(c, 9)) for a, b, c in medians.collect()) == sorted((a, b, round(c, 9)) for a, b, c in means.collect())
