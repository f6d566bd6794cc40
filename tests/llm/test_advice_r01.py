"""Cases of the review of round 1."""

import numpy as np

from cellweave.llm import substrings


def test_suffixes_are_in_the_order_of_their_bytes():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 100, 400), np.full(120, 97), rng.integers(0, 256, 200)]).astype(np.uint8)
    for length in (5, 8, 24, 50):
        at = np.arange(len(text) - length + 1)
        words = [text[i : i + length].tobytes() for i in at]
        key = substrings.suffix_keys(text, at, length)
        assert np.unique(key, return_inverse=True)[1].tolist() == [sorted(set(words)).index(w) for w in words]


def test_repeats_with_more_text_than_a_bucket(spark, monkeypatch):
    seen = []
    parse = substrings._parse
    monkeypatch.setattr(substrings, "_parse", lambda length, buckets: seen.append(buckets) or parse(length, buckets))
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 100)
    line = "the same line of more than fifty bytes in every one of these documents"
    got = substrings.remove_repeats(spark.createDataFrame([(i, f"{i} {line}") for i in range(20)], "doc_id long, text string")).collect()
    assert seen == [15] and sorted(r["n_removed"] > 0 for r in got) == [False] + [True] * 19
