"""op2: whole fingerprints against plain Python, written from the definition."""

import random

from pyspark.sql import functions as F

from cellweave.llm import fingerprints

SIGN = 1 << 63


def _hashes(spark, lists):
    """xxhash64 of each tuple of strings or whole numbers, asked of Spark alone."""
    out = {}
    for kind, cast in ((str, "string"), (int, "long")):
        for n in sorted({len(t) for t in lists if isinstance(t[0], kind)}):
            rows = sorted(t for t in lists if isinstance(t[0], kind) and len(t) == n)
            df = spark.createDataFrame(rows, ", ".join(f"c{i} {cast}" for i in range(n)))
            out |= {tuple(r)[:-1]: r[-1] for r in df.withColumn("h", F.xxhash64(*df.columns)).collect()}
    return out


def _words(text):
    for word in "".join(" " if c in "\x09\x0a\x0b\x0c\x0d" else c for c in text or "").split(" "):
        if len(word) > 16:
            yield from (word[i : i + 16] for i in range(len(word) - 15))
        elif word:
            yield word


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "one two", "one two three", "a " * 40, "a b " * 300 + "c", "x" * 300, "\u00e9\u4e2d\U0001f600 b\u00a0c d e"]
    texts += [" ".join(rng.choice(["tip", "tap", "top", "w%d" % rng.randrange(500)]) for _ in range(n)) for n in (4, 9, 30, 64, 65, 200, 1500)]
    words = [list(_words(t)) for t in texts]
    mers = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else [] for w in words]
    first = _hashes(spark, {m for ms in mers for m in ms})
    # the hash of a k-mer's later occurrence is that of (hash, number of earlier ones); they are counted on the hash without
    # its low bits, which make room for the position
    numbered = []
    for ms in mers:
        seen, mine = {}, []
        for m in ms:
            mine.append((first[m], seen.get(m, 0)))
            seen[m] = seen.get(m, 0) + 1
        numbered.append(mine)
    later = _hashes(spark, {(h, o) for mine in numbered for h, o in mine if o} | {(0,)})
    by_place = [[later[(h, o)] if o else h for h, o in mine] for mine in numbered]
    chosen = []
    for hs in by_place:
        # ascending by hash; a sketch begins at its range of the hash's top six bits and goes around the end
        bits = max(1, (len(hs) + 1).bit_length())
        order = sorted(range(len(hs)), key=lambda i: ((hs[i] >> bits), i))
        rows = []
        for sketch in range(64 if hs else 0):
            start = next((j for j, i in enumerate(order) if ((hs[i] + SIGN) >> 58) >= sketch), 0)
            two = sorted(order[(start + d) % len(order)] for d in range(min(2, len(order))))
            rows.append(tuple(hs[i] for i in two))
        chosen.append(rows)
    codes = _hashes(spark, {t for rows in chosen for t in rows})
    want = ["".join("%010x" % (sketch << 34 | codes[t] & ((1 << 34) - 1)) for sketch, t in enumerate(rows)) for rows in chosen]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = [r[0] for r in df.orderBy("i").select(fingerprints.printed(fingerprints.fingerprint(F.col("text")))).collect()]
    for t, g, w in zip(texts, got, want):
        assert g == w, t
