"""Small planes are settled where they are shuffled: their pixels are read twice (sizes, shuffles), not again for large planes."""

import re

from pyspark.sql import functions as F

from cellweave.operators import hotspot


def test_no_join_of_iterations(spark):
    px = spark.range(3 * 64).select(F.concat(F.lit("I"), F.expr("id div 64")).alias("image_id"), F.lit("A").alias("channel"), F.expr("int(id % 64 div 8)").alias("row"), F.expr("int(id % 8)").alias("col"), (F.col("id") * 7 % 13).cast("double").alias("value"))
    px = px.withColumn("value", F.when(F.col("image_id") == "I2", 5.0).otherwise(F.col("value")))
    small = hotspot.h_permutation(px, 9, block=4)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and "tops" not in plan
    assert len(re.findall(r"\bRange \(", plan)) == 1
    for q in (hotspot.g_permutation(px, 9, block=4), hotspot.g_permutation(px, 9, block=4, whole_image=False)):
        assert len(re.findall(r"\bRange \(", q._jdf.queryExecution().optimizedPlan().toString())) == 1
    key = lambda rows: {(r["image_id"], r["row"], r["col"]): (None if r["h"] is None else round(r["h"], 9), r["p"]) for r in rows}
    got = key(small.collect())
    assert got == key(hotspot.h_permutation(px, 9, block=4, whole=1).collect())
    assert all(got["I2", r, c] == (None, 0.1) for r in range(8) for c in range(8))


def test_looked_up_rounds_are_the_same():
    """Many places at once (looked up) and one at a time (mixed); 2,304 places of an image take few calls."""
    import numpy as np

    from cellweave.functions import keyed

    for n in (2, 3, 100, 2304, 5000):
        k = keyed.key(7, n)
        every = keyed.permuted(k, np.arange(n), n)
        assert sorted(every) == list(range(n))
        assert all(every[i] == keyed.permuted(k, np.array([i]), n)[0] for i in range(0, n, 1 + n // 50))
    mixed, calls = keyed.scramble, []
    try:
        keyed.scramble = lambda x: calls.append(1) or mixed(x)
        keyed.permuted(1, np.arange(2304), 2304)
    finally:
        keyed.scramble = mixed
    assert len(calls) == 2
