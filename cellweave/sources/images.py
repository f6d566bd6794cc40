"""Images and masks as tables.

pixels: image_id, channel, row, col, value (dense); mask: image_id, row, col, label (dense, 0 is background).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["image_id", "row", "col"]


def pixels_from_arrays(images: DataFrame) -> DataFrame:
    """pixels from images (image_id, channel, height, width, data array in row-major order)."""
    flat = images.select("image_id", "channel", "width", F.posexplode("data").alias("pos", "value"))
    return flat.select("image_id", "channel", F.expr("pos div width").cast("int").alias("row"), (F.col("pos") % F.col("width")).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def foreground(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels of cells with their label; the background, which is the hot key, goes before anything is grouped."""
    return pixels.join(mask.where("label <> 0"), PIXEL)


def shape_violations(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, channel, n_pixels, n_mask, missing, extra): one row for each plane that does not cover its mask exactly."""
    m = mask.select(*PIXEL, F.lit(1).alias("in_mask"))
    planes = pixels.select("image_id", "channel").distinct()
    want = m.join(planes, "image_id").select("image_id", "channel", "row", "col", "in_mask")
    both = pixels.select("image_id", "channel", "row", "col", F.lit(1).alias("in_plane")).join(want, ["image_id", "channel", "row", "col"], "full")
    out = both.groupBy("image_id", "channel").agg(
        F.count("in_plane").alias("n_pixels"), F.count("in_mask").alias("n_mask"),
        F.count_if(F.col("in_plane").isNull()).alias("missing"), F.count_if(F.col("in_mask").isNull()).alias("extra"),
    )
    return out.where("missing > 0 or extra > 0")


def chosen_channels(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """The pixels of the asked channels; a ValueError names those that no image has. At most len(channels) names are gathered."""
    kept = pixels.where(F.col("channel").isin(channels))
    missing = set(channels) - {r["channel"] for r in kept.select("channel").distinct().collect()}
    if missing:
        raise ValueError(f"no such channels: {sorted(missing)}")
    return kept


def with_metadata(cells: DataFrame, info: DataFrame) -> DataFrame:
    """cells with the columns of info (image_id, ObjectNumber, ...); cells without a row there are left out."""
    return cells.join(info, ["image_id", "ObjectNumber"])


def unique_names(channels: DataFrame, idx: str = "idx", name: str = "name") -> DataFrame:
    """channels with `channel`: the name, or name_1, name_2 ... where several have it; null names become Channel_{idx}."""
    base = F.coalesce(F.col(name), F.concat(F.lit("Channel_"), F.col(idx).cast("string")))
    w = Window.partitionBy("base")
    named = channels.withColumn("base", base).withColumn("rn", F.row_number().over(w.orderBy(idx))).withColumn("n", F.count(F.lit(1)).over(w))
    return named.select(idx, name, F.when(F.col("n") > 1, F.concat_ws("_", "base", F.col("rn").cast("string"))).otherwise(F.col("base")).alias("channel"))


def wide(cells: DataFrame, channels: list[str], stats: dict[str, str]) -> DataFrame:
    """One row for each cell, a column {channel}_{suffix} for each statistic; channels are named so that pivot needs no scan."""
    aggs = [F.first(c).alias(suffix) for c, suffix in stats.items()]
    out = cells.groupBy("image_id", "ObjectNumber").pivot("channel", channels).agg(*aggs)
    if len(stats) == 1:
        out = out.select("image_id", "ObjectNumber", *[F.col(f"`{c}`").alias(f"{c}_{next(iter(stats.values()))}") for c in channels])
    return out
