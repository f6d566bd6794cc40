"""Vector codes against plain integers, and on odd vectors."""

import hashlib

import numpy as np
import pytest

from cellweave.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, n int, codes string"


def _plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks in Python's whole numbers; rows: (id, ints)."""
    rows = sorted(rows)
    dim = len(rows[0][1])
    cuts = np.concatenate([[0], np.cumsum(codes.widths(dim, parts))])
    cut = lambda v, p: v[cuts[p] : cuts[p + 1]]
    books = [[list(cut(v, p)) for _, v in rows[:entries]] for p in range(parts)]

    def best(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            taken = {}
            for _, v in rows:
                taken.setdefault(best(v, p)[0], []).append(cut(v, p))
            for k, vs in taken.items():
                new[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
        books = new
    return {i: ("".join(f"{best(v, p)[0]:02x}" for p in range(parts)), sum(best(v, p)[1] for p in range(parts))) for i, v in rows}, books


@pytest.mark.parametrize("dim,entries,spread", [(8, 6, 40), (10, 5, 3), (4, 3, 100000), (3, 4, 9)])
def test_codes_equal_plain_integers(spark, dim, entries, spread):
    rng = np.random.default_rng(dim)
    ints = rng.integers(-spread, spread, (40, dim))
    ints[20:25] = ints[3]  # repeated rows, ties
    rows = [(100 - i, [float(x) / 1024 + 1 / 4096 for x in v], i % 3 or None, "x", 1, "c") for i, v in enumerate(ints)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), entries=entries).collect()
    want, books = _plain([(100 - i, v.tolist()) for i, v in enumerate(ints)], entries=entries)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    flat = ",".join(str(x) for b in books for e in b for x in e)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}
    label = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["label_error"] == sum(e for i, (_, e) in want.items() if label[i] == label[r["vec_id"]])


def test_screening_keeps_every_best_entry():
    """Distances that float32 cannot tell apart: the index and distance are those of int64."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 24), 1 << 24, 16)
    entries = base + rng.integers(-3, 4, (256, 16))
    entries[40] = entries[7]
    x = np.concatenate([base + rng.integers(-3, 4, (200, 16)), entries[[40, 7, 255]], np.zeros((1, 16), np.int64)])
    index, distance = codes.nearest(x, entries)
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (distance == exact.min(axis=1)).all() and (index == exact.argmin(axis=1)).all() and index[200] == 7


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [0.1, -0.2, 0.3, 0.4]
    vecs = [None, [], [1.0, None, 1.0, 1.0], [nan] * 4, [inf, 0.0, 0.0, 0.0], good, good, [0.0] * 4, [1e300, -1e300, 3e38, 1e-320], [1.0, 2.0]]
    rows = [(i if i != 7 else None, v, None, "x", 1, "c") for i, v in enumerate(vecs)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {5, 6, None, 8, 9}
    by = {r["vec_id"]: r for r in got}
    assert len(got) == 5 and by[5]["code"] == by[6]["code"] == "00000000" and by[5]["error"] == 0
    assert by[9]["code"] is None and by[9]["error"] is None and by[8]["error"] is not None
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame(rows[:5], SCHEMA)).count() == 0


def test_decode_is_near(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist(), 1, "x", 1, "c") for i in range(50)] + [(99, [1.0], 1, "x", 1, "c")]
    ints = codes.whole_numbers(spark.createDataFrame(rows, SCHEMA))
    books = codes.fit(ints)
    got = {r["id"]: r["vector"] for r in codes.decode(codes.encode(ints, books), books).collect()}
    assert got[99] is None and all(np.abs(np.array(got[i]) - v).max() <= 1 / 1024 for i, v, *_ in rows[:50])  # an entry for each vector
