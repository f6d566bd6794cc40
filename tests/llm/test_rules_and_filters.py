"""op1's rules and op9's filters evaluated again in plain Python, and odd and very long texts through both."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import language, quality
from cellweave.llm import textkit as tk

ODD = [None, "", "   ", "12 34", "A", "x" * 300_000, "word. " * 200_000, "Ünï çödé\nlines\nlines", "a b c " * 40]


def _statistics(text):
    t = text or ""
    n = max(len(t), 1)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = t.split("\n")
    share = lambda ok: sum(map(ok, t)) / n
    return {
        "upper": share(lambda c: c.isupper()), "symbol": share(lambda c: c in "#$%&*+<=>@^_|~{}[]\\"), "bang": share(lambda c: c in "!?"),
        "digit": share(lambda c: c in "0123456789"), "stop": share(lambda c: c in ".,;:"), "log_chars": math.log(n), "word_length": n / max(len(words), 1),
        "distinct_words": len(set(words)) / max(len(words), 1), "distinct_lines": len(set(lines)) / len(lines), "line_length": math.log(n / len(lines)),
    }


def test_rules_by_hand(spark):
    rules = (((("upper", True, 0.1), ("log_chars", False, 2.0)), 1.5), ((("distinct_words", False, 0.4),), -0.75), ((("stop", False, 0.05), ("digit", True, 0.2)), 0.5))
    model = quality.Rules(0.2, rules)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    for i, t in enumerate(ODD):
        s = _statistics(t)
        total = 0.2 + sum(w for cond, w in rules if all(s[n] <= v if below else s[n] > v for n, below, v in cond))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-total))), (i, s)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def _grams(text):
    """n-grams within a word and one of its edges; a whole word with both edges is none."""
    out = []
    for word in re.findall(r"[^\W\d_]+", text):
        w = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in word) + " "
        for n in language.GRAMS:
            out += [g for j in range(len(w) - n + 1) if not (g := w[j : j + n])[0] == g[-1] == " "]
    return out


def _hash(gram):
    h = np.array([len(gram)], np.uint64)
    for c in gram:
        h = h * np.uint64(0x100000001B3) + np.uint64(ord(c))
    return int(tk.mix(h)[0])


def test_filters_by_hand():
    texts = ["The cat sat on the mat, and the hat.", "Der Hund und die Katze sind im Haus.", "le chat est sur la table"]
    names = ["de", "en", "fr"]
    of = {"en": _grams(texts[0]), "de": _grams(texts[1]), "fr": _grams(texts[2])}
    hashes = np.array([_hash(g) for n in names for g in of[n]], np.uint64)
    filters = language.Filters(hashes, np.repeat(np.arange(3), [len(of[n]) for n in names]), names)
    slots = {n: [{int(h >> 24 * j) % language.SLOTS for h in map(_hash, of[n])} for j in range(language.HASHES)] for n in names}
    every = {n: set().union(*slots[n]) for n in names}  # both hashes share one row of slots
    asked = [*texts, "the Hund", "table und mat", "zzz qqq", "42", None]
    got, scores = filters.predict(asked)
    for text, name, score in zip(asked, got, scores):
        grams = _grams(text or "")
        if not grams:
            assert (name, score) == ("und", 0)
            continue
        share = []
        for k, n in enumerate(names):
            hit = sum(all(int(_hash(g) >> 24 * j) % language.SLOTS in every[n] for j in range(language.HASHES)) for g in grams) / len(grams)
            false = (len(every[n]) / language.SLOTS) ** language.HASHES
            share.append(max((hit - false) / (1 - false), 0))
        best = int(np.argmax(share))
        assert name == names[best] and score == pytest.approx(share[best] / sum(share) if sum(share) else 0)


def test_odd_and_very_long_texts(spark):
    docs = spark.createDataFrame([(i if i else None, t, "en" if i % 2 else "de") for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()}
    assert len(got) == len(ODD) and {got[i] for i in (None, 1, 2, 3)} == {"und"} and all(got[i] in ("en", "de") for i in (4, 5, 6, 7, 8))


def test_bags_count_every_form():
    from cellweave.llm import toxicity

    assert toxicity.bag_of("Worthless, worthless x") == Counter({"worthless": 2, "worth*": 2, "worthl*": 2, "worthle*": 2, "worthles*": 2, "x": 1})
