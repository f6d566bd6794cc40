"""Language ID by language-bitmask n-gram filters.

For each language the n-grams that are typical of it are put into a Bloom filter. The filters of all languages are
bit-sliced: slot s holds a bit for each language, 64 to a word, that says whether the language has set s. One lookup (the
AND of the words at an n-gram's slots) returns every language that contains it. Per language the hits are counted over the whole text, the
expected false positives are taken off, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import textkit as tk
from cellweave.llm.labelled import held_out

SAMPLE_ROWS = 600  # rows of each language that the filters are fitted on, about
GRAMS = (2, 3, 4)
SLOTS = 1 << 17
HASHES = 2
SHARE, RATIO = 2e-5, 0.5  # an n-gram is a language's if it is this frequent in it, and this near to where it is most so
BITS = 64  # languages in a word; a slot has as many words as the languages need


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 32 for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its row, rows that have a letter). n-grams lie within a word and one of its edges."""
    if not _FOLD:
        _FOLD.append(_letters())
    parts = [np.frombuffer((" " + (t or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cp = _FOLD[0][np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
    space = cp == 32
    some = np.zeros(len(parts), bool)
    some[row[~space]] = True
    hashes, rows = [], []
    for n in GRAMS:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint64)
        inner = np.zeros(len(h), bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + cp[j : len(cp) - n + 1 + j]
            if 0 < j < n - 1:
                inner |= space[j : len(cp) - n + 1 + j]
        ok = ~inner & ~(space[: len(h)] & space[n - 1 :]) if n > 2 else ~(space[: len(h)] & space[1:])
        ok &= row[: len(h)] == row[n - 1 :]
        hashes.append(h[ok])
        rows.append(row[: len(h)][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), some
    return tk.mix(np.concatenate(hashes)), np.concatenate(rows), some


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(24 * j)) % np.uint64(SLOTS)).astype(np.int64) for j in range(HASHES)]


class Filters:
    """The bit-sliced filters, the languages' names by bit, and each language's false-positive rate."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, names: list[str]):
        self.names, self.words = names, np.zeros((-(-len(names) // BITS), SLOTS), np.uint64)
        for s in _slots(hashes):
            np.bitwise_or.at(self.words, (langs // BITS, s), np.left_shift(np.uint64(1), (langs % BITS).astype(np.uint64)))
        bits = np.array([((self.words[b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)).mean() for b in range(len(names))])
        self.false = np.minimum(bits**HASHES, 0.9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Names and scores; und and 0 for a text without a letter. No hit at all: the first name, 0."""
        h, row, some = grams(texts)
        slots = _slots(h)
        total = np.maximum(np.bincount(row, minlength=len(texts)), 1).astype(float)
        share = np.empty((len(texts), len(self.names)))
        for b in range(len(self.names)):
            if b % BITS == 0:
                found = self.words[b // BITS][slots[0]]
                for s in slots[1:]:
                    found &= self.words[b // BITS][s]
            hit = np.bincount(row, ((found >> np.uint64(b % BITS)) & np.uint64(1)).astype(float), minlength=len(texts))
            share[:, b] = np.maximum((hit / total - self.false[b]) / (1 - self.false[b]), 0)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        most = share[np.arange(len(texts)), best]
        score = np.where(most > 0, most / np.maximum(share.sum(axis=1), 1e-12), 0)
        return [self.names[i] if ok else "und" for i, ok in zip(best, some)], np.where(some, score, 0.0)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters fitted on about `rows` rows of each language, chosen by a hash of their id, none held out.

    A language with fewer rows is learnt from all of them, and every language is learnt. Counting is done in tasks; what
    comes to the driver is a count of rows for each language, and the n-grams that pass the frequency limit.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    part = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, rows / n)]) if sizes else F.lit(None).cast("map<string,double>")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    texts = own.where(place < F.element_at(part, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(2).to_pylist()
            langs = {x: i for i, x in enumerate(dict.fromkeys(names))}
            h, row, _ = grams(batch.column(1).to_pylist())
            of = np.array([langs[x] for x in names], np.int64)[row]
            for name, i in langs.items():
                u, n = np.unique(h[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = texts.select("id", "text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).cache()
    try:
        totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        names = sorted(totals)
        size = F.create_map(*[F.lit(x) for k in names for x in (k, float(totals[k]))]) if names else F.lit(None).cast("map<string,double>")
        got = counted.select("lang", "gram", (F.col("n") / F.element_at(size, F.col("lang"))).alias("p")).where(F.col("p") >= SHARE).toArrow()
    finally:
        counted.unpersist()
    bit = {x: i for i, x in enumerate(names)}
    gram, p = got.column("gram").to_numpy().view(np.uint64), got.column("p").to_numpy()
    lang = np.array([bit[x] for x in got.column("lang").to_pylist()], np.int64)
    u, at = np.unique(gram, return_inverse=True)
    most = np.zeros(len(u))
    np.maximum.at(most, at, p)
    ok = p >= RATIO * most[at]
    return Filters(gram[ok], lang[ok], names)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row, from its whole text.

    Null texts and texts without a letter are und with score 0. Ids may repeat or be null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in tk.chunks(batch.column(1), 1 << 18):
                names, scores = shared.value.predict(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
