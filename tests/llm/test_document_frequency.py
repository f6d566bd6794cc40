"""op3: the IDF of a term is that of all documents, not of the labelled sample."""

import math

from cellweave.llm import toxicity


def test_idf_is_of_all_documents(spark):
    rows = [(i, "vile words here" if i < 40 else "calm words here") for i in range(400)]
    more = [(i, "vile again") for i in range(400, 1000)] + [(1000, None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(400)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert "vile" in index.term
    assert abs(index.idf[index.term["vile"]] - math.log(1002 / 640.5)) < 1e-9
