"""A channel of one image may have all cells: no task gets its rows for the sake of the ends of its histogram."""

import re

from pyspark.sql import functions as F

from cellweave.operators import shapes


def test_no_join_by_plane_alone(spark):
    name = F.concat(F.lit("emb"), F.col("id") % 1)  # of all rows, but Spark cannot tell
    at = spark.range(4000).select(name.alias("image_id"), F.col("id").cast("int").alias("ObjectNumber"), name.alias("channel"), (F.col("id") % 1000).alias("j"), (-F.col("id") / 1000).alias("lo"), (F.col("id") / 500).alias("hi"), F.lit(1.0).alias("mean"), F.lit(2).cast("long").alias("c"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = shapes._binned(at, 100)
        joins = re.findall(r"Join \[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
        assert joins and all("image_id" in j and ("ObjectNumber" in j or "__part" in j) for j in joins)
        rows = {r["ObjectNumber"]: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    first, last = -3.999 - 1, 3999 / 500 - 1
    assert len(rows) == 4000
    for k in (0, 17, 1999, 3999):
        x = (-k / 1000 - 1) + k % 1000 * ((k / 500 + k / 1000) / 999)
        b = -(-round((x - first) / ((last - first) / 100), 9) // 1) - 1
        assert (rows[k]["bin"], rows[k]["n"]) == (99 if b < 0 else min(b, 99), 2)
        assert abs(rows[k]["grid"] - (first + rows[k]["bin"] * (last - first) / 99)) < 1e-9
