"""A fence that meets a value, and cells whose means differ in the last bit alone."""

import duckdb
import pytest

from cellweave.operators import cells, scores

SCHEMA = "image_id string, row int, col int, label int, is_edge boolean"


@pytest.mark.parametrize("tenths", [[0, 2, 23, 28, 30, 35, 35, 35, 43, 47, 54, 57, 87, 95, 100, 117], [0, 0, 0, 3, 12, 18, 24, 38, 39, 40, 41, 96], [1, 2, 3, 6, 11, 18], [7, 9, 13, 31, 58, 77, 101, 126]])
def test_fence_as_in_duckdb(spark, tenths):
    """Values are k * 0.1; whether the largest is within q3 + 1.5 (q3 - q1) hangs on the last bit of the quartiles."""
    v = [k * 0.1 for k in tenths]
    at = spark.createDataFrame([("I", i, 0, 1, True) for i in range(len(v))], SCHEMA)
    px = spark.createDataFrame([("I", "A", i, 0, x) for i, x in enumerate(v)], "image_id string, channel string, row int, col int, value double")
    got = cells.features(px, at).first()
    con = duckdb.connect()
    q = con.execute("SELECT quantile_cont(x, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [v]).fetchone()[0]
    want = [x for x in v if x <= q[3] + 1.5 * (q[3] - q[1])]
    assert got["EDGE_IQMEAN"] == pytest.approx(sum(want) / len(want))
    assert (got["EDGE_Q25"], got["EDGE_Q75"]) == (q[1], q[3])
    assert [got[f"EDGE_Q{k}"] for k in (5, 50, 95)] == pytest.approx([q[0], q[2], q[4]])


def test_last_bits_do_not_rank(spark):
    """Cells 1 to 3 have one y but for the order of its sum: the highest two are then 2 and 3."""
    y = 0.1 + 0.2
    rows = [("I", "A", 1, 50.0, y), ("I", "A", 2, 20.0, 0.3), ("I", "A", 3, 30.0, 0.3)] + [("I", "A", k, 1.0 + k, 0.01) for k in range(4, 41)]
    xy = spark.createDataFrame(rows, "image_id string, channel string, ObjectNumber int, x double, y double")
    assert scores.smooth_max(xy).first()["x0"] == 30.0
