"""The smoother against all pairs, on channels of very different sizes, with ties and empty values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import hotspot, ordered, scores


def _plain(x, y, minp=0.01, max_dist=10.0, min_dist=25.0):
    d = np.abs(x[:, None] - x[None, :])
    q = np.quantile(x, 0.99)
    width = np.maximum(np.minimum(np.quantile(d, minp, axis=1), q / max_dist), q / min_dist)
    w = np.maximum(0, 1 - d / width[:, None])
    return (w @ y) / w.sum(axis=1)


def test_smoother_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    data = {"big": rng.gamma(2, 30, 1500), "ties": rng.integers(0, 9, 400).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 9.0]), "wide": np.concatenate([rng.normal(50, 1, 300), [900.0, 901.0]])}
    rows, want = [], {}
    for c, x in data.items():
        y = rng.random(len(x))
        rows += [("i", c, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))]
        want |= {(c, k): v for k, v in enumerate(_plain(x, y))}
    rows += [("i", "one", 7, None, 0.5), ("i", "one", 8, 3.0, None), ("i", "zero", 0, 0.0, 1.0)]
    got = {(r["channel"], r["ObjectNumber"]): r["ys"] for r in scores.smoothed(spark.createDataFrame(rows, "image_id string, channel string, ObjectNumber int, x double, y double")).collect()}
    assert len(got) == len(rows) and got["one", 7] is None and got["one", 8] is None and got["zero", 0] is None
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_running_sums_of_a_hot_key(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 5, 6000)
    df = spark.createDataFrame([("hot" if i % 10 else "rare", int(x), i) for i, x in enumerate(v)], "k string, x int, id int")
    got = ordered.running(df, ["k"], ["x", "id"], {"n": F.lit(1), "s": F.col("x")}).collect()
    for k in ("hot", "rare"):
        rows = sorted((r["x"], r["id"], r["n"], r["s"]) for r in got if r["k"] == k)
        x = [r[0] for r in rows]
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1)) and [r[3] for r in rows] == np.cumsum(x).tolist()


def test_false_discovery_of_a_plane_of_low_values(spark):
    """Nine of ten p-values are below 0.001: ranges follow the values, and the result is the plain one."""
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.random(18000) * 0.001, rng.random(2000), np.full(50, 0.5)])
    df = spark.createDataFrame([("i", "A", i % 50, i, float(v)) for i, v in enumerate(p)] + [("i", "A", 0, -1, None)], "image_id string, channel string, col int, row int, p double")
    order = np.argsort(-p, kind="stable")
    rank = np.searchsorted(np.sort(p), p, "right")
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate((p * len(p) / rank)[order]))
    got = {r["row"]: r["q"] for r in hotspot.false_discovery(df, scope="image").collect()}
    assert got.pop(-1) is None and all(got[i] == pytest.approx(v) for i, v in enumerate(want))
    parts = df.where("p is not null").select("p").distinct().repartitionByRange(8, "p").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
