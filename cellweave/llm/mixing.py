"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source asks for its share of all words. A share above the cap (so many epochs of the source) is clamped, and the
excess goes to the others in proportion to their weights until none is above its cap. With sources in ascending order of
cap / weight, the clamped ones are a prefix, so running sums over the table of sources (one row each) find the level.

A target of e epochs takes every document floor(e) times, and once more the documents that come first in a seeded order
until the rest of the target is reached. The order's running sum is built in two levels (bins of the order, then within
a bin), so that a source with a third of all rows is still many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_DIGITS = 3  # hexadecimal digits of the order's bins in a source: 4096 bins


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a whole text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight: Column, epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size) and a weight expression over rank, from 0.

    Sources rank by code point, null last. Targets add up to the sum of all sizes; none is above epochs times its
    source's size. A source without words has target 0.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("rank", F.row_number().over(everything) - 1).withColumn("weight", weight.cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("reach", F.col("cap") / F.col("weight"))
    way = Window.orderBy("reach", "rank")
    before = way.rowsBetween(Window.unboundedPreceding, -1)
    after = way.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose cap is at or above the level of those from it on, sets the level
    level = F.min(F.when(F.col("reach") >= F.col("level"), F.struct("reach", "rank", "level"))).over(Window.partitionBy())["level"]
    s = s.withColumn("fill", level)
    return s.select("source", "source_size", F.round(F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))), 6).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, epochs: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, repeats, taken) of every document.

    size: words of the text. repeats: how often the mix takes it; taken = size * repeats, at most `epochs` times the
    size. A source's taken words differ from its target by less than one document. weight: an expression over `rank`;
    by default 1, 2, 3 and again. Null sources are one source. Null and empty texts have size 0 and repeat floor(e)
    times. Rows with the same id are ordered by size; rows with a null id
    are placed by their text's hash. No documents: no rows. Other columns are ignored.
    """
    out = _planned(docs, weight, epochs, seed, id_col, text_col, source_col)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, weight: Column | None = None, epochs: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: every row as often as mix() says, with all its columns."""
    out = _planned(docs, weight, epochs, seed, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return out.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")


def _planned(docs: DataFrame, weight: Column | None, epochs: float, seed: str, id_col: str, text_col: str, source_col: str, row: Column | None = None) -> DataFrame:
    weight = F.col("rank") % 3 + 1 if weight is None else weight
    rows = docs.select(F.lit(None).alias("row") if row is None else row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")), F.lit(f":{seed}"))).alias("place"))
    rows = rows.withColumn("bin", F.substring("place", 1, BIN_DIGITS))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goals = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weight, epochs)
    goals = goals.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = goals.withColumn("whole", F.floor("times")).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    start = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = start.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).select(F.col("source").alias("p_source"), F.col("bin").alias("p_bin"), "before", "source_size", "target", "whole", "more")
    at = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bin") == F.col("p_bin"))).drop("source", "bin")
    within = Window.partitionBy("p_source", "p_bin").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    came = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = (came + F.col("size") / 2.0 < F.col("more")) & (F.col("size") > 0)
    return at.withColumn("repeats", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long"))


#: The same for the whole documents table, in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(CAST(doc_id AS VARCHAR), ':mix')) AS place FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), l AS (
  SELECT *, cap / weight AS reach,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT *, (SELECT arg_min(level, (reach, rank)) FROM l WHERE reach >= level) AS fill FROM l
), g AS (
  SELECT source, source_size, round(least(cap, coalesce(fill * weight, cap)), 6) AS target FROM f
), c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, d.place,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS came
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), r AS (
  SELECT *, CAST(whole + CASE WHEN size > 0 AND came + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM c
)
SELECT doc_id, size, source_size, target, repeats, CAST(size * repeats AS BIGINT) AS taken FROM r
"""
