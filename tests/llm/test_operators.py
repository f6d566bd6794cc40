"""The operators against brute force on small tables, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cellweave.llm import fingerprints, language, mixing, near_dedup, packing, pii, quality, queries, substrings, toxicity, vectors

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, id string, score int, key binary, n double, bin string, row int"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x" for i in range(30000))
    texts = [None, "", "   \n\t ", "one", "one two", "One two", "one two three four five six seven eight nine ten", long, long, long + " end", "ä" * 5000, "😀 ✓ " * 40, None]
    rows = [(i, t, None if i % 3 else f"s{i % 2}", None if i % 2 else "en", "x", 1, b"k", 0.5, "b", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates_of_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(odd, words=3, threshold="0.85").collect()}
    assert len(got) == 13 and all(got[i]["n_shingles"] == 0 and got[i]["kept"] for i in (0, 1, 2, 12))
    assert got[4]["component_id"] == got[5]["component_id"] == 4 and got[8]["component_id"] == got[9]["component_id"] == 7
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_loose_group(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(700):  # more than two blocks
        w = list(base)
        for j in rng.integers(0, 150, int(rng.integers(0, 9))):
            w[j] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold="0.85").collect()}
    sets = [{tuple(t.split()[j : j + 3]) for j in range(148)} for _, t in rows]
    at = list(range(700))
    changed = True
    links = [(a, b) for a in range(700) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            changed |= at[a] != m or at[b] != m
            at[a] = at[b] = m
    assert got == dict(enumerate(at))


def test_signature_is_of_the_set():
    orders = near_dedup._orders(100)
    x = np.random.default_rng(0).integers(0, 1 << 62, 40).astype(np.uint64)
    assert (near_dedup.signature(x, 100, orders) == near_dedup.signature(x[::-1], 100, orders)).all()
    assert near_dedup.bands_for(float(Fraction("0.85"))) == 25


def _repeats(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        mine = [b[j : j + length] for j in range(len(b) - length + 1)]
        for j, x in enumerate(mine):
            if x in seen:
                gone[j : j + length] = b"\1" * length
        seen.update(mine)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_removed_repeats(spark, odd, none):
    rng = np.random.default_rng(8)
    passages = ["".join(rng.choice(list("abcde é"), int(n))) for n in (49, 50, 51, 120, 400)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 90)))) for _ in range(4)]
        parts.insert(int(rng.integers(0, 4)), passages[int(rng.integers(0, 5))])
        rows.append((i * 3 - 50, "".join(parts) if i % 17 else None))
    rows += [(1000, rows[3][1]), (1001, "a" * 300), (1002, "a" * 77), (1003, "ab" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:5] for r in substrings.remove_repeats(docs).collect()}
    assert got == _repeats(rows)
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 9]
    got = {r[0]: tuple(r)[1:5] for r in substrings.remove_repeats(odd.where("doc_id <> 9")).collect()}
    assert got == _repeats(odd_rows)
    assert substrings.remove_repeats(none).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(60):
        v = rng.normal(size=64)
        for k in range(int(rng.integers(1, 14))):
            w = v + rng.normal(size=64) * rng.uniform(0.05, 0.45)
            rows.append((len(rows), [float(np.float32(x)) for x in w], int(c % 3)))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(30)]
    n = len(rows)
    bad = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, rows[0][1], None), (n + 4, [], 1), (n + 5, [1.0, None], 1)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    assert sum(got[i]["n_links"] for i in range(n)) >= 0.99 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(n))
    assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["kept"] for b in bad)


def test_packing(spark, odd, none):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    got = packing.pack(odd, path).collect()
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 1024 for r in mine[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024
    assert packing.pack(none, path).count() == 0


def test_genetic_packing_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1000, 600).tolist()
    bins = packing.evolve(lengths, [], 3)
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 1024) * 1.03


def test_encoding_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["It's  a\n\n test 12ab  ", "naïve Straße, ¿qué?", "x<|endoftext|>y", "日本語 ²½", " a\u00a0b", " \t\r\n ", "don't we'll I'M", "a" * 30000, " " * 30000 + "x", "\n\u2003" * 9000]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or 0xE0000 <= c < 0xE0200)]
    texts += ["".join(f"a{chr(c)}b {chr(c)}1\n" for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    for t in texts:
        assert packing.encode(t, path)[:-4] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encode(None, path) == packing.encode("", path) == b"\2\0\0\0"


def test_pseudonyms(spark, none):
    text = 'Mail jo.x@mail7.example.com, call +1 (974) 555-3436, card 4111111111111111 not 4111111111111112, ip 10.2.3.4 not 10.2.3.400, on 2024-02-29 not 2023-02-29, 31.12.1999, 078-05-1120 not 000-05-1120, token = "04dbebab91ab85687d33eeaaf9ac699e1188aaaa".'
    rows = [(0, text), (1, text + " again"), (2, None), (3, ""), (4, "nothing 12 here")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "test").collect()}
    new = got[0]["text"]
    for gone in ("jo.x@", "555-3436", "4111111111111111 ", "10.2.3.4 ", "2024-02-29", "31.12.1999", "078-05-1120", "04dbebab"):
        assert gone not in new
    for kept in ("4111111111111112", "10.2.3.400", "2023-02-29", "000-05-1120"):
        assert kept in new
    assert got[1]["text"] == new + " again" and got[0]["n_replaced"] == 8 and got[2]["text"] is None and got[4]["text"] == rows[4][1]
    card = re.search(r"card (\d{16})", new)[1]
    assert sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(card))) % 10 == 0
    assert pii.pseudonymise(none, "test").count() == 0


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for size in (7, 1000, 73049):
        got = spark.range(size).select(pii.permute(F.col("id"), F.lit(size).cast("long"), "k", F.lit("t")).alias("x"))
        assert tuple(got.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()) == (size, 0, size - 1)


def test_mix_matches_its_sql(spark, odd, none):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    cols = ("doc_id", "size", "source_size", "target", "repeats", "taken")
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in queries.op7_mix_sources(spark, D).collect()) == want
    got = mixing.mix(odd).collect()
    assert len(got) == 13 and all(r["taken"] <= 3 * r["size"] for r in got) and mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_fingerprints(spark, odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got = {r["doc_id"]: r for r in fingerprints.edits(odd).collect()}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[7]["near_next"] == 1
    assert fingerprints.edits(none).count() == 0
    words = [f"q{i}" for i in range(400)]
    both = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[200:] + words[:200]))], "doc_id long, text string")
    moved = fingerprints.edits(both).where("doc_id = 1").first()["near_next"]
    assert moved < 0.75  # the same k-mers in another order are not the same


def test_classifiers_on_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).join(labels, "doc_id").where("held_out and quality is not null")
    assert got.where("predicted = quality").count() >= 0.97 * got.count()
    index = toxicity.fit(docs, labels)
    got = toxicity.score(docs, index).join(labels, "doc_id").where("held_out and toxic is not null")
    assert got.where("predicted = toxic").count() >= 0.93 * got.count()
    filters = language.fit(docs)
    got = language.identify(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    assert quality.classify(odd, model).count() == toxicity.score(odd, index).count() == language.identify(odd, filters).count() == 13
    assert {r["lang_pred"] for r in language.identify(odd, filters).where("doc_id < 3").collect()} == {"und"}
    empty = none.selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic")
    assert quality.classify(odd, quality.fit(none, empty)).count() == 13 and toxicity.score(odd, toxicity.fit(none, empty)).count() == 13
    assert language.identify(odd, language.fit(none)).where("lang_pred = 'und'").count() == 13


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    from collections import Counter

    bags, labels = [], []
    for i in range(500):
        y = int(rng.random() < 0.3)
        bags.append(Counter(rng.choice(words[:40] if y else words[20:], 12).tolist()))
        labels.append(y)
    index = toxicity.Index(bags, np.array(labels), np.arange(500))
    assert index.blocks > 1
    dense = np.zeros((len(index.labels), len(index.term)))
    at = [i for i, b in enumerate(bags) if b.keys() & index.term.keys()]
    for j, i in enumerate(at):
        t, w = index.weigh(bags[i])
        dense[j, t] = w
    for i in range(0, 500, 25):
        t, w = index.weigh(bags[i])
        near, cosine = index.nearest(bags[i])
        want = np.sort(dense[:, t] @ w)[::-1][: toxicity.K]
        assert np.allclose(cosine, want[want > 1e-12][: len(cosine)])
