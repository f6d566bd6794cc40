"""Order of pixels by md5: that of the hex digests, with few strings made."""

import hashlib

import numpy as np

from cellweave.operators import cells


def test_order_is_that_of_hex_digests(monkeypatch):
    starts, ends = [b"42|I|7|A|%d" % b for b in range(20)], [b"|%d|%d" % (r, c) for r in range(6) for c in range(11)]
    want = [np.argsort([hashlib.md5(s + x).hexdigest() for x in ends]) for s in starts]
    assert (cells._hash_order(starts, ends) == want).all()

    class Tied:
        def __init__(self, text):
            self.text = text

        def digest(self):
            return b"\0" * 8 + hashlib.sha256(self.text).digest()[:8]

    monkeypatch.setattr(cells.hashlib, "md5", Tied)
    assert (cells._hash_order(starts, ends) == [np.argsort([Tied(s + x).digest().hex() for x in ends]) for s in starts]).all()
