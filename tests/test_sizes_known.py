"""Rows made from a few rows are joined at their own size, not at that of what they were made from."""

from pyspark.sql import functions as F

from cellweave.operators import polar
from cellweave.sources import fixtures as fx


def _stats(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_a_mask_is_as_large_as_its_grid(spark):
    """Every image gets 48 x 48 pixels; Spark has to know, or it sends the mask to the driver and all tasks."""
    images = spark.range(300).select(F.concat(F.lit("O-"), "id").alias("image_id"))
    grid = fx._grid(images)
    assert grid.count() == 300 * 48 * 48 == grid.distinct().count()
    assert _stats(grid) > 300 * 48 * 48
    assert grid.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_offsets_are_not_broadcast(spark):
    """Offsets around centres are many more rows than the centres, the only ones that Spark counts."""
    centres = spark.range(4).select(F.lit("O-0").alias("image_id"), F.col("id").cast("int").alias("ObjectNumber"), (F.col("id") * 8 + 4.0).alias("x"), (F.col("id") * 8 + 4.0).alias("y"))
    grid = fx._grid(spark.range(1).select(F.lit("O-0").alias("image_id")))
    pixels = grid.withColumn("channel", F.lit("A")).withColumn("value", F.col("row") * 1.0)
    got = polar.radial(pixels, centres, polar.lookup(8, 6), grid.withColumns({"cell": F.lit(1), "nucleus": F.lit(0)}))
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line and "row#" in line]
    assert not joins
    assert got.where("channel = 'any_cell' and n > 0").select(F.min("value")).first()[0] == 1.0
