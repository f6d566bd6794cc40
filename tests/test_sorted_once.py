"""False-discovery control within image columns sorts its rows once; ties, NULL and NaN come out as in plain Python."""

import math

import numpy as np

from cellweave.operators import hotspot


def _plain(p: list[float | None]) -> list[float | None]:
    some = [x for x in p if x is not None]
    order = lambda x: math.inf if math.isnan(x) else x
    part = [x * len(some) / sum(order(y) <= order(x) for y in some) for x in some]
    low = lambda x: min((q for y, q in zip(some, part) if order(y) >= order(x) and not math.isnan(q)), default=1.0)
    return [None if x is None else min(1.0, low(x)) for x in p]


def test_columns_are_sorted_once(spark):
    rng = np.random.default_rng(3)
    p = [None if v < 0.1 else float(np.round(v * v, 1 + i % 2)) for i, v in enumerate(rng.random(300))]
    p[:6] = [None, None, None, 0.0, 1.0, math.nan]
    rows = [("i", "A", 0 if i < 3 else 1 + i % 4, i, v) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "image_id string, channel string, col int, row int, p double")
    got = hotspot.false_discovery(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    q = {r["row"]: r["q"] for r in got.collect()}
    for col in range(5):
        own = [r for r in rows if r[2] == col]
        for r, want in zip(own, _plain([r[4] for r in own])):
            assert q[r[3]] is None if want is None else math.isclose(q[r[3]], want), r
    assert plan.count("- Sort [") == 1
