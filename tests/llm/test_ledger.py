"""The rule ledger against plain Python, policies and ablations against counting documents one by one."""

import re

from cellweave.llm import ledger

SCHEMA = "doc_id long, text string, n_words string, fail_bits int, source string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(40000))
TEXTS = [
    None, "", " \n\t\x0b ", "one", "a b c d e f g h", "a b c d e f g h " * 2, " ".join("abcdefghij") * 5, LONG, LONG + " end", "ä" * 3000, "# $ % & | < > * #\n# $\n# $\nx", "same line\nsame line\n\n\nsame line\r\nother",
    "  　  ", "😀 ✓ " * 40, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21", "word " * 7, "word " * 8, "word " * 9, "the quick brown fox jumps over the lazy dog and then it runs home again to rest for one night " * 2,
]


def _plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {}
    for w in wins:
        many[w] = many.get(w, 0) + 1
    hit = {i + j for i, w in enumerate(wins) if many[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(lines), sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words), len(set(words)))


def _docs(spark):
    return spark.createDataFrame([(i if i else None, t, "x", 1, "s", 2) for i, t in enumerate(TEXTS)] + [(3, "one", "x", 1, "s", 2)], SCHEMA)


def _bits(m):
    v = dict(zip(ledger.MEASURES, m))
    return sum(1 << i for i, r in enumerate(ledger.RULES) if r.a * v[r.left] < r.b * (v[r.right] if r.right else 1))


def test_measurements_and_bits(spark):
    got = ledger.ledger(_docs(spark)).collect()
    want = [_plain(t) for t in [*TEXTS, "one"]]
    assert [tuple(r[m] for m in ledger.MEASURES) for r in got] == want
    assert [r["fail_bits"] for r in got] == [_bits(m) for m in want]
    assert ledger.ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def _rejects(policy, bits, without=None):
    failed = {r.name for i, r in enumerate(ledger.RULES) if bits >> i & 1} - {without}
    return bool(failed & set(policy.any_of)) or len(failed & set(policy.several)) >= policy.least


def test_policies(spark):
    book = ledger.write_ledger(_docs(spark))
    for policy in ledger.POLICIES:
        for r in ledger.apply(book, policy).collect():
            base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == base and r["kept"] == (not base and not _rejects(policy, r["fail_bits"])) and (r["rejected_by"] == 0) == r["kept"]


def test_ablations(spark):
    book = ledger.write_ledger(_docs(spark))
    bits = [r["fail_bits"] for r in book.collect()]
    rows = ledger.ablations(book).collect()
    assert len(rows) == sum(len(p.any_of) + len(p.several) for p in ledger.POLICIES)
    place = {r.name: i for i, r in enumerate(ledger.RULES)}
    for r in rows:
        p = next(p for p in ledger.POLICIES if p.version == r["policy"])
        used = sum(1 << place[n] for n in (*p.any_of, *p.several))
        hit = [b for b in bits if b >> place[r["rule"]] & 1]
        assert r["failed"] == len(hit) and r["rejected"] == sum(_rejects(p, b) for b in hit)
        assert r["alone"] == sum(b & used == 1 << place[r["rule"]] for b in hit)
        assert r["regained"] == sum(_rejects(p, b) and not _rejects(p, b, r["rule"]) for b in bits)
