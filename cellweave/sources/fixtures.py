"""Images, masks and cells derived from the star-schema tables, in Spark and, for the oracles, in DuckDB SQL.

An image is a line status with a run of fifty suppliers, so the number of images grows with the tables. Values are whole
numbers, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, BLOCK = 48, 8
CHANNELS = ["A", "N", "R"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    image = F.concat_ws("-", "l_linestatus", F.expr("(l_suppkey - 1) div 50").cast("string"))
    return spark.read.parquet(f"{d}/lineitem.parquet").withColumn("image_id", image)


def _grid(images: DataFrame) -> DataFrame:
    """All pixels of the images, a cross join: Spark sees the size of one, and tasks share it by pixels, however few rows name the images."""
    places = images.sparkSession.range(SIDE * SIDE).select(F.expr(f"int(id div {SIDE})").alias("row"), F.expr(f"int(id % {SIDE})").alias("col"))
    return places.crossJoin(F.broadcast(images)).select(*images.columns, "row", "col")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    key = ["image_id", "channel", "row", "col"]
    sums = lines.select("image_id", F.col("l_returnflag").alias("channel"), (F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_orderkey") % SIDE).cast("int").alias("col"), F.col("l_quantity").cast("double").alias("q")).groupBy(*key).agg(F.sum("q").alias("value"))
    grid = _grid(lines.select("image_id").distinct()).withColumn("channel", F.explode(F.array(*map(F.lit, CHANNELS))))
    return grid.join(sums, key, "left").select(*key, F.coalesce("value", F.lit(0.0)).alias("value"))


def _mask(spark: SparkSession, d: str, bound) -> DataFrame:
    grid = _grid(_lines(spark, d).select("image_id").distinct())
    label = F.expr(f"1 + (row div {BLOCK}) * {SIDE // BLOCK} + col div {BLOCK}").cast("int")
    reach = F.pow(2 * (F.col("row") % BLOCK) - 7, F.lit(2)) + F.pow(2 * (F.col("col") % BLOCK) - 7, F.lit(2))
    return grid.select("image_id", "row", "col", F.when(reach <= bound(label), label).otherwise(0).alias("label"))


def mask(spark: SparkSession, d: str) -> DataFrame:
    return _mask(spark, d, lambda label: 18 + 12 * (label % 4))


def mask_nuc(spark: SparkSession, d: str) -> DataFrame:
    return _mask(spark, d, lambda label: F.lit(10))


def radial(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, ObjectNumber, channel, angle, ring, value, n) from the embeddings, with an own_nucleus plane."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("ObjectNumber"), F.posexplode("embedding").alias("pos", "v"))
    at = e.select(F.lit("emb").alias("image_id"), "ObjectNumber", F.expr("pos div 8").cast("int").alias("angle"), (F.col("pos") % 8).alias("ring"), F.round(F.col("v").cast("double") * 1000).alias("value"))
    own = F.when(F.col("ring") < 2 + (F.col("ObjectNumber") + F.col("angle")) % 3, 1.0).otherwise(0.0)
    planes = F.array(F.struct(F.lit("emb").alias("c"), F.col("value").alias("v")), F.struct(F.lit("own_nucleus").alias("c"), own.alias("v")))
    return at.select("image_id", "ObjectNumber", F.explode(planes).alias("p"), "angle", "ring").select("image_id", "ObjectNumber", F.col("p.c").alias("channel"), "angle", "ring", F.col("p.v").alias("value"), F.lit(1).alias("n"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.lit("part").alias("image_id"), F.col("p_brand").alias("channel"), F.col("p_partkey").alias("ObjectNumber"), F.col("p_retailprice").cast("double").alias("x"), (F.col("p_size") / F.lit(50.0)).alias("y"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("channel"), F.col("p_size").cast("double").alias("weight"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") - 25).alias("value"))
    return li.join(p, "l_partkey").select(F.lit("part").alias("image_id"), "channel", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ObjectNumber"), "value", "weight")


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("channel"), F.col("l_suppkey").alias("col"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), (F.col("l_quantity").cast("double") / 50).alias("p")).withColumn("image_id", F.lit("lines"))


#: The same in DuckDB: tables img, px, mk, mkn, rad.
SQL = f"""
WITH ln AS (SELECT *, l_linestatus || '-' || CAST((l_suppkey - 1) // 50 AS VARCHAR) AS image_id FROM lineitem),
img AS (SELECT DISTINCT image_id FROM ln),
gr AS (SELECT image_id, CAST(r.row AS INT) AS row, CAST(c.col AS INT) AS col FROM img, range({SIDE}) r(row), range({SIDE}) c(col)),
sm AS (SELECT image_id, l_returnflag AS channel, l_partkey % {SIDE} AS row, l_orderkey % {SIDE} AS col, sum(CAST(l_quantity AS DOUBLE)) AS value FROM ln GROUP BY ALL),
px AS (SELECT g.image_id, c.channel, g.row, g.col, coalesce(s.value, 0.0) AS value FROM gr g CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(channel)
       LEFT JOIN sm s ON s.image_id = g.image_id AND s.channel = c.channel AND s.row = g.row AND s.col = g.col),
lb AS (SELECT *, 1 + (row // {BLOCK}) * {SIDE // BLOCK} + col // {BLOCK} AS l, (2*(row%8)-7)*(2*(row%8)-7) + (2*(col%8)-7)*(2*(col%8)-7) AS reach FROM gr),
mk AS (SELECT image_id, row, col, CAST(CASE WHEN reach <= 18 + 12*(l%4) THEN l ELSE 0 END AS INT) AS label FROM lb),
mkn AS (SELECT image_id, row, col, CAST(CASE WHEN reach <= 10 THEN l ELSE 0 END AS INT) AS label FROM lb),
cl AS (SELECT image_id, row, col, label AS "ObjectNumber", channel, value FROM px JOIN mk USING (image_id, row, col) WHERE label <> 0),
rad0 AS (SELECT vec_id AS "ObjectNumber", unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
rad AS (SELECT "ObjectNumber", CAST(pos // 8 AS INT) AS angle, CAST(pos % 8 AS INT) AS ring, round(CAST(v AS DOUBLE) * 1000) AS value,
        CASE WHEN pos % 8 < 2 + ("ObjectNumber" + pos // 8) % 3 THEN 1.0 ELSE 0.0 END AS own FROM rad0)
"""
