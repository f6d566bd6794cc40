"""op4: packings that are perfect by construction, and texts of millions of characters."""

import itertools
import zlib

import numpy as np
import pytest

from cellweave.llm import packing, queries


def _triples(n, seed):
    """Lengths that fill n sequences by threes; best fit pairs the wrong ones."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(rng.integers(390, 500))
        b = int(rng.integers(250, (1024 - a) // 2 + 1))
        out += [a, b, 1024 - a - b]
    return rng.permutation(out)


def _legal(lengths, bins):
    return sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 1024 for b in bins)


def test_planted_perfect_packings():
    for n, most in ((300, 304), (1000, 1008)):
        lengths = _triples(n, n)
        plain = packing.best_fit(lengths)
        found = packing.evolve(lengths.tolist(), [], 1)
        found = packing.evolve(lengths.tolist(), found, 2)
        assert _legal(lengths, found) and len(plain) >= 1.1 * n and len(found) <= most


def test_bound_is_below_the_least_number_of_bins():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 1024, 6)
        least = 6
        for of in itertools.product(range(4), repeat=6):
            used = np.bincount(of, lengths, 4)
            if used.max() <= 1024:
                least = min(least, int((used > 0).sum()))
        assert packing.bound(lengths) <= least
    assert packing.bound(np.array([600] * 5 + [300])) == 5


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 900, 400)
    a, b = packing.best_fit(lengths), packing.Pool(lengths, np.arange(400)).bins(rng)
    assert _legal(lengths, packing._cross(lengths, a, b, rng)) and _legal(lengths, packing._cross(lengths, b, a, rng))


def test_assignment_is_near_the_planted_packing(spark):
    lengths = _triples(1000, 6)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    got = packing.assign(items).collect()
    used = {}
    for r in got:
        used[r["bin_group"], r["bin"]] = used.get((r["bin_group"], r["bin"]), 0) + int(lengths[r["row"]])
    assert len(got) == 3000 and max(used.values()) <= 1024 and len(used) <= 1010


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 300_000, "a b" + " \t" * 100_000 + " b  c" + "\n" * 70_000, "x" + "\u3000" * 70_000 + "y", " " * 65_536 + "<|endoftext|>"])
def test_long_white_space(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    want = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert packing.encode(text, path) == want


def test_very_long_texts(spark):
    texts = [" " * 10_000_000, "word " * 400_000, "ab" * 1_000_000]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path()).collect()
    for i, t in enumerate(texts):
        data = packing.encode(t, queries.tokenizer_path())
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(data) // 4 and all(r["length"] == 1024 for r in mine[1:])
        assert all(zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in mine)
