"""op3: exact neighbours over an index of all terms that tell the labels apart."""

from collections import Counter

import numpy as np

from cellweave.llm import toxicity


def _index(n=700, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    labels = (rng.random(n) < 0.3).astype(int)
    bags = [Counter(rng.choice(words[:40] if y else words[20:], 12).tolist()) for y in labels]
    return toxicity.Index(bags, labels, np.arange(n)), bags


def test_as_many_neighbours_as_there_are():
    index, bags = _index()
    dense = np.zeros((len(index.labels), len(index.term)))
    for j, i in enumerate(index.ids):
        t, w = index.weigh(bags[i])
        dense[j, t] = w
    assert index.blocks > toxicity.FIRST
    for i in range(0, 700, 7):
        for skip in (-1, 3):
            t, w = index.weigh(bags[i])
            near, cosine = index.nearest(bags[i], skip)
            want = dense[:, t] @ w
            if skip >= 0:
                want[skip] = 0
            order = np.lexsort((np.arange(len(want)), -np.round(want, 12)))
            order = order[want[order] > 1e-12][: toxicity.K]
            assert len(near) == min(toxicity.K, int((want > 1e-12).sum())) and np.allclose(cosine, want[order])
            assert len(set(near.tolist())) == len(near) and np.allclose(want[near], cosine)


def test_terms_of_both_labels_and_no_cap():
    rng = np.random.default_rng(1)
    labels = (np.arange(4000) % 4 == 0).astype(int)
    marks = {y: [f"m{y}x{i}" for i in range(450)] for y in (0, 1)}
    bags = [Counter([*rng.choice(marks[int(y)], 30).tolist(), "all"]) for y in labels]
    index = toxicity.Index(bags, labels, np.arange(4000))
    assert set(index.term) >= {*marks[0], *marks[1]} and "all" not in index.term


def test_texts_of_one_label_or_no_words(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "a"), (3, "x " * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["example_ids"] == [] for r in got)
