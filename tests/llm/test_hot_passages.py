"""op10 when many documents of one batch have a passage, and with very long texts."""

import hashlib

import numpy as np

from cellweave.llm import substrings


def _expected(rows, length=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j] += 1
                gone[min(j + length, len(b))] -= 1
        keep = np.cumsum(gone)[:-1] == 0
        out[i] = (len(b), int((~keep).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[keep])).hexdigest())
    return out


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = np.random.default_rng(12)
    hot = "All of this passage stands in every third document, word by word, and it is longer than two windows of bytes. " * 2
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for i in rng.permutation(900):
        parts = [" ".join(word() for _ in range(int(rng.integers(3, 25)))) for _ in range(2)]
        if i % 3 == 0:
            parts.insert(1, hot[: int(rng.integers(60, len(hot)))] if i % 2 else hot)
        rows.append((int(i), " ".join(parts)))
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
        assert got == _expected(rows)


def test_few_rows_of_a_hot_passage_reach_its_bucket():
    import pyarrow as pa

    hot = "a passage of more than fifty bytes that stands in all of these documents, over and over again"
    texts = [f"{i:06d} {hot}" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([0] * 500, pa.int64()), pa.array(texts)], names=["id", "mark", "text"])
    sent, passed = 0, 0
    for out in substrings._parse(50, 4)(iter([batch])):
        for b, blob in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            if b >= 0:
                i, _, _, of, _ = substrings._unpack(blob, "<i8", "<i8", "<u8", "<u4", "<u4")
                sent += int(((i[of] != 0) & (i[of] != 499)).sum())
            else:
                passed += 1
    assert passed and sent <= 2 * 500  # what is left are the phrases around each document's own number


def test_very_long_texts(spark):
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, 3_000_000).astype(np.uint8)).decode()
    rows = [(1, long), (2, "x" + long[1_000_000:2_000_000] + "y"), (3, "a" * 1_500_000), (4, "a" * 60)]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 1_000_000, 0, 60]
