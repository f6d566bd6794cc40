"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

The examples are a bounded sample of labelled rows. Their terms are all their words and the first letters of these. A term
weighs its IDF, from how many of all documents have it, times what it tells of the labels: its likelihood ratio beyond
chance, above a floor that every term has. TF-IDF vectors are stored as inverted lists cut into blocks of examples, each
with its largest weight per term. A text is held against a block only if the sum of those maxima can still reach the k-th
best cosine so far, so the k neighbours are exact. Votes weighted by cosine give a raw score; a logistic curve fitted on
the examples' own votes (each left out of its own neighbours) turns it into a probability.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.labelled import held_out, training_rows

SAMPLE_ROWS = 2000  # labelled rows that are the examples, at most; all their words are in the lists
STEMS = (5, 6, 7, 8)  # first letters of a word that are terms, too
K = 15
BLOCK = 64  # examples of a block
FIRST = 4  # blocks of the highest bounds, whose cosines tell which others are worth a look
FLOOR = 0.05  # what a term weighs that tells nothing of the labels
CHANCE = 3.5  # root likelihood ratio that a term may have by chance
_WORD = re.compile(r"[^\W\d_]+")


def _evidence(a: int, n: int, b: int, m: int) -> float:
    """Root of the likelihood-ratio statistic of a in n against b in m."""
    p = (a + b) / (n + m)
    cells = ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p)))
    return math.sqrt(max(0.0, 2 * sum(x * math.log(x / e) for x, e in cells if x)))


def _forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each run of so many, run after run."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Examples' TF-IDF vectors over all their terms as block-max inverted lists.

    Terms that all documents have tell no text from another and are left out. With examples of one label there is nothing to vote on:
    the index is empty.
    """

    def __init__(self, bags: list[Counter], labels: np.ndarray, ids: np.ndarray, frequency: tuple[int, dict[str, int]] | None = None):
        """frequency: the number of documents and of those that have a term; where it is not given, the examples are all documents."""
        n, pos = len(bags), int(labels.sum())
        df, hit = Counter(), Counter()
        for bag, y in zip(bags, labels) if 0 < pos < n else ():
            df.update(bag.keys())
            if y:
                hit.update(bag.keys())
        n_docs, having = frequency or (n, df)
        self.term = {t: i for i, t in enumerate(sorted(t for t in df if having.get(t, 0) < n_docs))}
        self.idf = np.array([math.log((n_docs + 1) / (having.get(t, 0) + 0.5)) for t in self.term], np.float64)
        told = (_evidence(hit[t], pos, df[t] - hit[t], n - pos) for t in self.term)
        self.scale = self.idf * np.array([FLOOR + max(0.0, e - CHANCE) for e in told], np.float64)
        keep = [i for i, bag in enumerate(bags) if not self.term.keys().isdisjoint(bag)]
        # like examples (of one label, with the same most frequent word) share blocks, which keeps the blocks' maxima low
        keep.sort(key=lambda i: (labels[i], max((c, df[t], t) for t, c in bags[i].items() if t in self.term)[2], i))
        self.labels, self.ids = labels[keep].astype(np.float64), ids[keep]
        self.base = pos / max(n, 1)
        rest = np.delete(labels, keep)
        self.without = float(rest.sum() + self.base) / (len(rest) + 1)  # share of label 1 among examples with no term
        self.blocks = (len(keep) + BLOCK - 1) // BLOCK
        weighed = [self.weigh(bags[i]) for i in keep]
        t = np.concatenate([t for t, _ in weighed]) if keep else np.zeros(0, np.int64)
        j = np.repeat(np.arange(len(keep)), [len(t) for t, _ in weighed])
        order = np.lexsort((j, t))
        t, self.doc = t[order], j[order]
        self.weight = np.concatenate([w for _, w in weighed])[order] if keep else np.zeros(0)
        cell = t * (self.blocks + 1) + self.doc // BLOCK  # the part of a list that is in one block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.at = np.append(first, len(t))
        self.block = self.doc[first] // BLOCK
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(t[first], np.arange(len(self.term) + 1))
        self.slope, self.shift = 1.0, 0.0
        self._calibrate(weighed)

    def weigh(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms in a bag and their weights, of length 1 together."""
        found = sorted((self.term[t], c) for t, c in bag.items() if t in self.term)
        return self._unit(np.array([t for t, _ in found], np.int64), np.array([c for _, c in found], np.float64))

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.scale[terms]
        return terms, w / np.linalg.norm(w) if len(w) else w

    def nearest(self, bag: Counter, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The K examples of the largest cosine (ties: the smaller number) and the cosines; those of 0 are left out."""
        return self._nearest(*self.weigh(bag), skip)

    def _nearest(self, terms: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        size = self.cells[terms + 1] - self.cells[terms]
        cell, w = _spread(self.cells[terms], size), np.repeat(w, size)
        block = self.block[cell]
        bound = np.bincount(block, w * self.most[cell], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_i, best_c = self._best(cell, w, block, order[:FIRST], skip)
        rest = order[FIRST:]
        if len(best_c) == K:
            rest = rest[bound[rest] >= best_c[-1] - 1e-12]
        if len(rest):
            more_i, more_c = self._best(cell, w, block, rest, skip)
            best_i, best_c = np.concatenate([best_i, more_i]), np.concatenate([best_c, more_c])
            kept = np.lexsort((best_i, -best_c))[:K]
            best_i, best_c = best_i[kept], best_c[kept]
        return best_i, best_c

    def _best(self, cell: np.ndarray, w: np.ndarray, block: np.ndarray, blocks: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest among the examples of some blocks."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        here = wanted[block]
        cell = cell[here]
        size = self.at[cell + 1] - self.at[cell]
        at = _spread(self.at[cell], size)
        total = np.bincount(self.doc[at], np.repeat(w[here], size) * self.weight[at], minlength=len(self.labels))
        if skip >= 0:
            total[skip] = 0
        got = np.flatnonzero(total > 0)
        if len(got) > K:
            got = got[total[got] >= np.partition(total[got], -K)[-K]]
        kept = np.lexsort((got, -total[got]))[:K]
        return got[kept], total[got[kept]]

    def votes(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the votes: a neighbour at distance 1 - cosine votes with 1 / (0.1 + distance)."""
        v = 1 / (1.1 - np.minimum(cosine, 1))
        yes = float((v * self.labels[near]).sum()) + self.base
        return math.log(yes / (float((v * (1 - self.labels[near])).sum()) + 1 - self.base))

    def _calibrate(self, weighed: list[tuple[np.ndarray, np.ndarray]]) -> None:
        raw = np.array([self.votes(*self._nearest(t, w, i)) for i, (t, w) in enumerate(weighed)])
        y, a, b = self.labels, 1.0, 0.0
        for _ in range(30 if len(raw) else 0):  # Newton steps with a weak pull to slope 1 and shift 0
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            s = p * (1 - p)
            g = np.array([((p - y) * raw).sum() + a - 1, (p - y).sum() + b])
            h = np.array([[(s * raw * raw).sum() + 1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.slope, self.shift = max(a, 0.05), b

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The probability of label 1 of a text with so many of each of these terms, its neighbours and their cosines."""
        near, cosine = self._nearest(*self._unit(terms, counts))
        if not len(near):
            return self.without, near, cosine
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.votes(near, cosine) + self.shift)))), near, cosine


def bag_of(text: str | None) -> Counter:
    bag: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for form in _forms(word):
            bag[form] += n
    return bag


class _Pieces(dict):
    """Pieces of text between white space, each with the numbers of its words' terms; short ones are remembered."""

    def __init__(self, term: dict[str, int]):
        super().__init__()
        self.term = term

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(self.term[f] for word in _WORD.findall(piece) for f in _forms(word) if f in self.term)
        if len(piece) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[piece] = found
        return found


def known_terms(term: dict[str, int], texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the numbers of its terms, ascending, and how often it has them.

    White space is in no word, so the words of a text are those of its pieces."""
    pieces = _Pieces(term)
    for text in texts:
        bag = Counter((text or "").lower().split())
        found = [pieces[p] for p in bag]
        size = np.fromiter(map(len, found), np.int64, len(found))
        terms, place = np.unique(np.fromiter(chain.from_iterable(found), np.int64, int(size.sum())), return_inverse=True)
        yield terms, np.bincount(place, np.repeat(np.fromiter(bag.values(), np.float64, len(bag)), size), minlength=len(terms))


def document_frequency(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of all documents, and of those that have each of the terms (a bounded list): counted in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, n, total = _Pieces(shared.value), 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0) if terms else ():
                found = chain.from_iterable([pieces[p] for p in set((text.as_py() or "").lower().split())])
                total[list(set(found))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([None, *some.tolist()], pa.int32()), pa.array([n, *total[some].tolist()], pa.int64())], names=["t", "n"])

    counted = docs.select(text_col).mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(counted.column("t").to_pylist(), counted.column("n").to_pylist()))
    return got.pop(None, 0), {terms[i]: n for i, n in got.items()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Index:
    """The index over at most `rows` labelled examples that are not held out, IDF from all documents; bags are made in tasks.

    Of a document id that repeats, the text that sorts first is the example.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bag_of(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(b) for b in made], pa.list_(pa.string())), pa.array([list(b.values()) for b in made], pa.list_(pa.int32()))], names=["id", "label", "terms", "counts"])

    examples = training_rows(docs, labels, label, rows).groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    got = examples.select("id", "text", "label").mapInArrow(bags, "id long, label int, terms array<string>, counts array<int>").toArrow().sort_by("id")
    found = [Counter(dict(zip(map(sys.intern, t.as_py()), c.as_py()))) for t, c in zip(got.column("terms"), got.column("counts"))]
    return Index(found, got.column("label").to_numpy().astype(np.int64), got.column("id").to_numpy(), document_frequency(docs, sorted(set().union(*found))))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", flag: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted, example_ids, cosines) of every row.

    score: the calibrated probability of label 1. example_ids and cosines: the neighbours that voted, the nearest first.
    Null and empty texts, and texts with no word of an example, get the share of label 1 among such examples.
    The index is bounded by its parameters and sent to the executors once. Ids may repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            scores, near, cosines = [], [], []
            for terms, counts in known_terms(idx.term, (t.as_py() for t in batch.column(1))):
                s, i, c = idx.score(terms, counts)
                scores.append(s)
                near.append(idx.ids[i].tolist())
                cosines.append(c.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["id", "score", "example_ids", "cosines"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, example_ids array<long>, cosines array<double>")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= flag).cast("int").alias("predicted"), "example_ids", "cosines")
