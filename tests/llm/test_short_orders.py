"""op2 on short texts, and on ids far apart."""

from cellweave.llm import fingerprints


def test_short_texts_in_another_order_differ(spark):
    for n in (20, 52, 81):
        words = [f"q{i}" for i in range(n)]
        h = n // 2
        rows = [(1, " ".join(words)), (2, " ".join(words[h:] + words[:h])), (3, " ".join(words[:-1] + ["z"]))]
        got = {r["doc_id"]: r for r in fingerprints.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(len(r["fingerprint"]) == 640 for r in got.values())
        # h - 2 and n - h - 2 of the k-mers stay; a pair from both halves, and one with a lost k-mer, must not agree
        assert got[1]["near_next"] < 0.6 < got[1]["near_next"] + 0.6, got[1]["near_next"]
        near = fingerprints.edits(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).where("doc_id = 1").first()["near_next"]
        assert near > got[1]["near_next"] + 0.2


def test_next_of_far_ids(spark):
    ids = [None, -(1 << 62), -5, 0, 3, 1 << 20, (1 << 20) + 7, 1 << 41, 1 << 42, (1 << 62) + 9]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("fp", fingerprints.fingerprint("text"))
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(docs).collect()}
    assert got == {t: u for (_, t), (_, u) in zip(rows, rows[1:] + rows[:1])}
    values = spark.createDataFrame([(i << 25,) for i in range(-40, 40)], "v long")
    got = {r["v"]: r["next"] for r in fingerprints._follows(values).collect()}
    assert got == {i << 25: (i + 1 if i < 39 else -40) << 25 for i in range(-40, 40)}
