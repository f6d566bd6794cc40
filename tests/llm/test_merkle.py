"""The manifest against a plain Merkle tree, with blocks of few levels so that trees end in different climbs."""

import zlib
from hashlib import sha256

import pytest

from cellweave.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree int, i string, n int, digest string"
H = lambda *x: sha256("".join(x).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _plain(docs):
    """{row: (subroot, root, proof hash, folded root)} of distinct rows (doc_id, text, source, lang, n_chars)."""
    trees = {}
    for d in docs:
        trees.setdefault(d[3], []).append(d)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda d: (d[0] is not None, d[0] or 0, _leaf(d[0], d[2], d[3], d[4], d[1])))
        built[lang] = _levels([_leaf(d[0], d[2], d[3], d[4], d[1]) for d in trees[lang]])
    top = _levels([built[x][-1][0] for x in order])
    out = {}
    for t, lang in enumerate(order):
        for i, d in enumerate(trees[lang]):
            tamper = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            at, way = _leaf(d[0], d[2], d[3], None if d[4] is None else d[4] + tamper, d[1]), []
            for levels, k in ((built[lang], i), (top, t)):
                for row in levels[:-1]:
                    run = [row[j] if j != k else None for j in range(k // 2 * 2, min(k // 2 * 2 + 2, len(row)))]
                    way += [x for x in run if x]
                    at, k = H(*(x or at for x in run)), k // 2
            out.setdefault(d, []).append((built[lang][0][i], built[lang][-1][0], top[-1][0], H(*way), at, at == top[-1][0]))
    return {k: sorted(v) for k, v in out.items()}


def _docs():
    sizes = {None: 1, "": 2, "a": 3, "b": 8, "ä": 9, "c": 17, "en": 70, "z": 5}
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            text = [None, "", "x" * 20000, f"tëxt 😀 {k}"][k % 4]
            rows.append((1000 - 7 * k, text, None if k % 5 == 0 else f"s{k % 3}", lang, None if k % 11 == 0 else k))
            k += 1
    return rows + [(None, "no id", "s", "en", 4), (None, "no id either", "s", "en", 4)]


def _check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)
    got = {}
    ids = {(d[0], _leaf(d[0], d[2], d[3], d[4], d[1])): d for d in rows}
    for r in merkle.manifest_rows(df, **options).collect():
        got.setdefault(ids[r["doc_id"], r["leaf"]], []).append((r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]))
    assert {k: sorted(v) for k, v in got.items()} == _plain(rows)


@pytest.mark.parametrize("step", [2, 3, 10])
def test_rows_of_many_trees(spark, step):
    _check(spark, _docs(), step=step)


def test_one_row_equal_rows_and_no_rows(spark):
    _check(spark, [(5, "only", "s", "en", 4)])
    _check(spark, [(5, "same", "s", "en", 4)] * 7 + [(6, "same", "s", None, 4)] * 2, step=2)
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest_rows(empty).count() == 0 and merkle.build(empty).root is None


def test_proofs_and_stored_levels(spark):
    made = merkle.build(spark.createDataFrame([(*r, 1, "x", 2, "y") for r in _docs()], SCHEMA), step=3)
    for r in merkle.prove(made).collect():
        path = [r["proof"][i : i + 32] for i in range(0, len(r["proof"]), 32)]
        assert r["verified"] and H(*(d.hex() for d in path)) == r["proof_sha256"]
    levels = {(r["climb"], r["level"]) for r in made.nodes.where("not top").collect()}
    assert {(0, 0), (0, 3), (3, 3), (3, 6), (6, 6), (6, 7)} <= levels
