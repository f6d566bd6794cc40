"""The bootstrap in runs of a channel's values."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.functions import keyed
from cellweave.operators import scores


def test_runs_equal_the_whole_channel(spark):
    """A channel cut into runs gives what one group gives, and what plain sums over the draws give."""
    rows = [("i", c, f"o{k:03d}", float((k * 7) % 11 - 5), float(1 + k % 4)) for c in "AB" for k in range(57 if c == "A" else 10)]
    df = spark.createDataFrame(rows, "image_id string, channel string, ObjectNumber string, value double, weight double")
    got = [sorted(map(tuple, scores.bootstrap_share(df, 40, part=part).collect())) for part in (5, 1 << 21)]
    want = []
    for c in "AB":
        v, w = (np.array([r[i] for r in sorted(rows) if r[1] == c]) for i in (3, 4))
        shares = [np.where(v > 0, w, 0.0)[k].sum() / w[k].sum() for k in (keyed.resampled(f"42|i|{c}|{b}", len(v)) for b in range(40))]
        want.append(("i", c, *np.quantile(shares, [0.025, 0.975])))
    for one in got:
        np.testing.assert_allclose([r[2:] for r in one], [r[2:] for r in want], rtol=1e-12)


def test_values_are_not_multiplied_by_resamples(spark):
    """What is sent for each value does not grow with the number of resamples."""
    df = spark.range(100).select(F.lit("i").alias("image_id"), F.lit("A").alias("channel"), F.col("id").alias("ObjectNumber"), F.lit(1.0).alias("value"), F.lit(1.0).alias("weight"))
    assert "Generate" not in scores.bootstrap_share(df, 1000)._jdf.queryExecution().optimizedPlan().toString()
