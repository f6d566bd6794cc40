"""op3: all words of all examples are in the lists, evidence is a weight, scores against a plain recomputation."""

import math

import numpy as np
import pytest

from cellweave.llm import toxicity


@pytest.fixture(scope="module")
def few(spark):
    rng = np.random.default_rng(4)
    plain, vile = [f"plain{chr(97 + i)}q" for i in range(26)], [f"vile{chr(97 + i)}q" for i in range(6)]
    rows = [(i, " ".join([*rng.choice(plain, 9), *rng.choice(vile if i % 5 == 0 else plain, 3), f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"])) for i in range(300)]
    docs = spark.createDataFrame(rows + [(300, None), (301, ""), (302, "nothing known"), (302, "nothing known"), (5, "zzz of a repeated id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300)], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels)


def test_terms_without_evidence_are_in_the_lists(few):
    docs, labels, index = few
    texts = {}
    for r in docs.collect():
        texts[r["doc_id"]] = min(texts.get(r["doc_id"], r["text"] or ""), r["text"] or "")
    words = {t for i in index.ids.tolist() for t in toxicity.bag_of(texts[i])}
    assert set(index.term) == words and len(index.ids) == len(set(index.ids.tolist())) > 200
    assert min(index.scale / index.idf) == pytest.approx(toxicity.FLOOR) and max(index.scale / index.idf) > 3


def test_texts_that_share_a_word_have_neighbours(few):
    docs, _, index = few
    for r in toxicity.score(docs, index).join(docs.dropDuplicates(["doc_id"]), "doc_id").where("doc_id not in (5)").collect():
        shares = not index.term.keys().isdisjoint(toxicity.bag_of(r["text"]))
        assert (len(r["example_ids"]) > 0) == shares
        if not shares:
            assert r["score"] == index.without


def test_scores_against_plain_python(few):
    docs, labels, index = few
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.orderBy(docs.text.desc_nulls_last()).collect()}  # the first of a repeated id

    def vector(bag):
        v = {t: (1 + math.log(c)) * index.scale[index.term[t]] for t, c in bag.items() if t in index.term}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {i: vector(toxicity.bag_of(text[i])) for i in index.ids.tolist()}
    for r in toxicity.score(docs.where("doc_id % 11 = 1"), index).collect():
        mine = vector(toxicity.bag_of(text[r["doc_id"]]))
        cosine = {i: sum(x * e.get(t, 0.0) for t, x in mine.items()) for i, e in examples.items()}
        assert all(abs(cosine[i] - c) < 1e-9 for i, c in zip(r["example_ids"], r["cosines"]))
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[: toxicity.K]
        assert np.allclose(r["cosines"], best)
        vote = [sum(1 / (1.1 - min(c, 1)) for i, c in zip(r["example_ids"], r["cosines"]) if toxic[i] == y) for y in (0, 1)]
        odds = index.slope * math.log((vote[1] + index.base) / (vote[0] + 1 - index.base)) + index.shift
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)))
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_rows_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).cache()
    assert got.where("size(example_ids) = 0").join(docs.where(docs.text.rlike(r"[a-z]{3}")), "doc_id", "left_semi").count() == 0
    rows = got.where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    yes, no = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.9
