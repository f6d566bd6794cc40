"""Pixels and their p-values come from one reading of the pixels; pixels without a channel stay, with no statistic."""

from cellweave.jobs import workloads


def test_planes_in_one_pass(spark):
    rows = [("I", "A", r, c, float((r * 7 + c * 3) % 11)) for r in range(6) for c in range(6)] + [("I", None, 0, 0, 5.0), ("I", "B", 1, 1, None)]
    pixels = spark.createDataFrame(rows, "image_id string, channel string, row int, col int, value double")
    got = workloads.hot_spot_planes(pixels)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    seen = [tuple(r) for r in got.select("image_id", "channel", "row", "col", "value").collect()]
    assert sorted((t for t in seen if t[1] in ("A", "B", None)), key=str) == sorted(rows, key=str)
    made = [t for t in seen if t[1] not in ("A", "B", None)]
    assert sorted({(t[1], sum(u[1] == t[1] for u in made)) for t in made}) == [("A_GP", 36), ("A_GPhot", 36), ("B_GP", 1), ("B_GPhot", 1)]
    assert all(t[4] is not None for t in made if t[1].startswith("A"))
    two = workloads.hot_spot_planes(pixels.where("channel = 'A'"), n_iter=3)
    assert two.count() == 3 * 36 and two.where("channel = 'A'").select("row", "col", "value").count() == 36
