"""The bootstrap over packed blocks: a large channel makes its draws once, its resamples are dealt to several groups."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import keyed
from cellweave.operators import scores

N, TIMES = 70_000, 21


def _values(spark, weight):
    k = F.col("id")
    return spark.range(N).select(F.lit("i").alias("image_id"), F.lit("A").alias("channel"), k.alias("ObjectNumber"), ((k * 7) % 11 - 5).cast("double").alias("value"), weight(k).cast("double").alias("weight"))


@pytest.mark.parametrize("kinds", [4, 10_007])
@pytest.mark.parametrize("part,draws", [(1 << 26, 1 << 31), (1 << 26, 3 * N), (30_000, 5 * N)])
def test_runs_and_chunks(spark, kinds, part, draws):
    """Few weights are counted by their codes, many are looked up; runs and chunks give what plain sums give."""
    got = scores.bootstrap_share(_values(spark, lambda k: 1 + k % kinds), TIMES, part=part, draws=draws).collect()
    k = np.arange(N)
    w, some = 1.0 + k % kinds, (k * 7) % 11 > 5
    shares = [np.where(some, w, 0.0)[at].sum() / w[at].sum() for at in (keyed.resampled(f"42|i|A|{b}", N) for b in range(TIMES))]
    np.testing.assert_allclose([tuple(r)[2:] for r in got], [np.quantile(shares, [0.025, 0.975])], rtol=1e-12)


def test_null_values(spark):
    """A null value is not above 0."""
    df = _values(spark, lambda k: 1 + k % 4).withColumn("value", F.when(F.col("ObjectNumber") % 2 == 0, F.col("value")))
    got = scores.bootstrap_share(df, TIMES).collect()
    k = np.arange(N)
    w, some = 1.0 + k % 4, ((k * 7) % 11 > 5) & (k % 2 == 0)
    shares = [np.where(some, w, 0.0)[at].sum() / w[at].sum() for at in (keyed.resampled(f"42|i|A|{b}", N) for b in range(TIMES))]
    np.testing.assert_allclose([tuple(r)[2:] for r in got], [np.quantile(shares, [0.025, 0.975])], rtol=1e-12)


def test_a_channel_of_36_million_values_is_one_run():
    """At 6 GB each of six channels has 36 million values; each further run of a channel would make all draws again."""
    assert inspect.signature(scores.bootstrap_share).parameters["part"].default >= 36_000_000
