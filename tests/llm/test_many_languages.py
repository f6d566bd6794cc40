"""op9 with more languages than a word has bits."""

import numpy as np

from cellweave.llm import language


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(5)
    words = {f"l{n:02}": ["".join(chr(0x4E00 + 40 * n + int(c)) for c in rng.integers(0, 12, 4)) for _ in range(6)] for n in range(70)}
    rows = [(len(words) * k + n, " ".join(rng.choice(w, 12)), x) for k in range(8) for n, (x, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.fit(docs)
    assert filters.names == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, filters).collect()}
    assert got == {i: x for i, _, x in rows}
