"""Every stage of the pipeline on the smallest tables."""

import corpus_pipeline

D = "/root/testdata/sf0.001"


def test_stages(spark):
    from cellweave.llm.store import stored, table

    docs = table(spark, D, "documents")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, D), name)
        now = [r[0] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(now) <= ids and (name == "mixing" or len(now) == len(set(now)))
        ids = set(now)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert last.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert {r[0] for r in last.select("doc_id").collect()} == ids


def _brute_near(texts, k=5, share=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, bin string, row int, grp long"


def test_stages_on_odd_rows(spark):
    from cellweave.llm.mixing import mix

    base = " ".join(f"word{i % 40} and some other text, number {i}." for i in range(60))
    texts = [base, base, base.replace("number 7.", "number x."), "Call +1 (974) 555-3436 now. " + base[:600], None, "", "   ", "one two", base[::-1], base]
    rows = [(i if i < 9 else None, t, None if i % 2 else "en", None if i % 3 else "s", None if t is None else len(t), "x", 0.5, "b", 7, 3) for i, t in enumerate(texts)] + [(8, base[::-1], "en", "s", 1, "x", 0.5, "b", 7, 3)]
    docs = spark.createDataFrame(rows, ODD)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, docs, D)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == _brute_near({i: t for i, t in enumerate(texts) if i < 9}) | {None}
    private = stages["pii"](spark, docs, D)
    assert private.columns == docs.columns and private.count() == 11
    assert private.where("text like '%555-3436%'").count() == 0 and private.where("n_chars <> length(text)").count() == 0
    mixed = stages["mixing"](spark, docs, D)
    assert mixed.columns == docs.columns and mixed.count() == mix(docs).agg({"repeats": "sum"}).first()[0]
    good = stages["quality"](spark, docs, D)
    assert good.columns == docs.columns and good.count() <= 11
    packed = stages["packing"](spark, docs, D)
    assert packed.where("piece = 0").count() == 11


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
