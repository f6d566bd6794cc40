"""op2 on text without spaces, and on texts of millions of characters."""

import numpy as np

from cellweave.llm import fingerprints


def _near(spark, a, b):
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    return fingerprints.edits(docs).where("doc_id = 1").first()["near_next"]


def test_an_insertion_into_unspaced_text(spark):
    rng = np.random.default_rng(3)
    text = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 4000))
    assert _near(spark, text, "x" + text) > 0.9
    assert _near(spark, text, text[:2000] + "yz" + text[2000:]) > 0.8
    assert _near(spark, text, text[2000:] + text[:2000]) < 0.75  # the same pieces in another order
    assert _near(spark, text, "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 4000))) < 0.1


def test_very_long_texts(spark):
    rows = [(1, "a" * 300_000), (2, "word " * 300_000), (3, " " * 3_000_000), (4, "".join(map(chr, range(0x4E00, 0x8E00))) * 8)]
    got = fingerprints.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_chars"] for r in got} == {i: len(t) for i, t in rows}
