"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

1. Tasks turn whole texts into token ids and cut them: a document over the capacity gives full pieces, of which the
   first may be shorter. Full pieces are sequences of their own; all others are items to pack.
2. Items are dealt by hash into groups of bounded size. Several islands work on each group from different seeds. A
   solution is a list of bins. Crossover injects the best-filled bins of one parent whole into the other, drops the bins
   that hold the same items, opens the bins with room left, and puts all displaced items back by best fit: room after
   room takes the one or two items that leave least of it, exact fits first.
3. After each epoch the best solution of a group over its islands migrates to all of them; the last epoch's is the result.
   A group stops early where it has reached a lower bound of the bins that it needs.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import textkit as tk
from cellweave.llm.store import stored

CAPACITY, END = 1024, 2
GROUP, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 2, 2, 30, 5
PATIENCE = 10  # generations without a better packing, after which an island rests
#: Fixed: how the byte-level vocabulary cuts a text into words before it merges bytes.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of a length that the pattern's look-ahead cannot step back over (Unicode's White_Space, fixed).
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The byte-level vocabulary of a tokenizer file, whose ids are the order of its merges, once in a worker.

    It gives the ids of the file's own tokenizer (held against it in the tests) in half the time, and keeps no cache of
    words that grows with the corpus. The second encoding takes its whole text as one word.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"not a byte-level vocabulary without a prefix space: {path}")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tuple(tiktoken.Encoding(f"{path} {name}", pat_str=x, mergeable_ranks=ranks, special_tokens=special) for name, x in (("words", _WORDS), ("whole", r"[\s\S]+")))


def encode(text: str | None, path: str) -> bytes:
    """Ids of a whole text as little-endian 32-bit bytes, ended by END; special tokens in the text are such tokens.

    White space is one word but for the last character before other text. A very long run is handed over as that word,
    and the texts before and after it apart; no other word looks beyond its end.
    """
    by_word, whole = encoding(path)
    ids = lambda e, x: e.encode_to_numpy(x, allowed_special="all").astype("<u4", copy=False).tobytes() if x else b""
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text) if text and len(text) >= 65536 else ():
        end = run.end() - (run.end() < len(text))
        out += [ids(by_word, text[at : run.start()]), ids(whole, text[run.start() : end])]
        at = end
    return b"".join(out) + ids(by_word, text[at:] if text and at else text) + END.to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of every document's pieces, in order; null and empty texts are END alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 4 * CAPACITY
        for batch in batches:
            for lo, hi, _, _ in tk.chunks(batch.column(1), 1 << 22):
                ids, piece, start, length, crc = [], [], [], [], []
                for key, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo)):
                    data = encode(text.as_py(), tokenizer)
                    at, first = 0, len(data) % size or size
                    for i in range((len(data) + size - 1) // size):
                        part = data[at : at + (first if i == 0 else size)]
                        ids.append(key)
                        piece.append(i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


class Bins:
    """A packing in the making: items of each bin and the rooms left, kept in order for best fit."""

    def __init__(self, lengths: list[int], bins: list[list[int]] = ()):
        self.lengths, self.bins = lengths, [list(b) for b in bins]
        self.rooms = sorted((CAPACITY - sum(lengths[i] for i in b), k) for k, b in enumerate(self.bins))

    def put(self, items: list[int]) -> None:
        """Best fit, the longest item first."""
        for i in sorted(items, key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, k = self.rooms.pop(at)
                self.bins[k].append(i)
            else:
                room, k = CAPACITY, len(self.bins)
                self.bins.append([i])
            if room > n:
                insort(self.rooms, (room - n, k))


class Pool:
    """Displaced items by length, from which rooms take what leaves least of them."""

    def __init__(self, lengths: np.ndarray, items: np.ndarray):
        self.items = items[np.argsort(lengths[items], kind="stable")]
        self.count = np.bincount(lengths[items], minlength=CAPACITY + 1)
        self.first = np.cumsum(self.count) - self.count
        self.left = len(items)

    def take(self, n: int) -> int:
        self.count[n] -= 1
        self.left -= 1
        return int(self.items[self.first[n] + self.count[n]])

    def top(self, room: int) -> int:
        """The largest length that fits, 0 if none does."""
        found = np.flatnonzero(self.count[: room + 1])
        return int(found[-1]) if len(found) else 0

    def fill(self, room: int, rng: np.random.Generator | None, eager: bool) -> list[int]:
        """Items for a room: one that fits exactly, or two that do, or the longest and so on with the room it leaves.

        Unless eager, two are looked for only where the longest would leave room that nothing fits into, which spares the
        short items.
        """
        out = []
        while room > 0 and self.left:
            n = self.top(room)
            if not n:
                break
            if n == room or not eager and self.count[1 : room - n + 1].any():
                out.append(self.take(n))
                room -= n
                continue
            has = self.count[1:room] > 0
            both = np.flatnonzero(has & has[::-1]) + 1
            both = both[len(both) // 2 :]  # the longer of each two
            if len(both) and 2 * both[0] == room and self.count[both[0]] < 2:
                both = both[1:]
            if len(both):
                n = int(both[-1 if rng is None else int(rng.integers(len(both)))])
                out += [self.take(n), self.take(room - n)]
                break
            out.append(self.take(n))
            room -= n
        return out

    def bins(self, rng: np.random.Generator | None = None, eager: bool = False) -> list[list[int]]:
        """All items in new bins, each begun with the longest item left."""
        out = []
        while self.left:
            n = self.top(CAPACITY)
            out.append([self.take(n), *self.fill(CAPACITY - n, rng, eager)])
        return out


def best_fit(lengths: np.ndarray) -> list[list[int]]:
    """Plain best fit, the longest item first."""
    out = Bins(lengths.tolist())
    out.put(list(range(len(lengths))))
    return out.bins


def _fills(lengths: np.ndarray, bins: list[list[int]]) -> np.ndarray:
    size = np.array([len(b) for b in bins])
    return np.add.reduceat(lengths[np.concatenate(bins).astype(np.int64)], np.cumsum(size) - size) if len(bins) else np.zeros(0, np.int64)


def _fitness(lengths: np.ndarray, bins: list[list[int]]) -> tuple[int, float]:
    """Fewer bins are better; among as many, those with fuller bins and so more room in one place."""
    return len(bins), -float(((_fills(lengths, bins) / CAPACITY) ** 2).sum())


def _cross(lengths: np.ndarray, a: list[list[int]], b: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """b with some of a's best-filled bins injected whole; bins that hold their items go, displaced items are put back."""
    fill = _fills(lengths, a)
    best = np.argsort(-(fill + rng.random(len(a)) * 8))[: max(1, int(len(a) * rng.uniform(0.3, 0.7)))]
    injected = [a[k] for k in best if fill[k] == CAPACITY or rng.random() < 0.5]
    taken = np.zeros(len(lengths), bool)
    taken[[i for x in injected for i in x]] = True
    # some other bins are opened as well, so that best fit has something to choose from: those with room left, or the emptiest
    again, by_room = rng.uniform(0.02, 0.3), rng.random() < 0.5
    fills = _fills(lengths, b)
    full = fills > np.quantile(fills, again / 2) if by_room else fills == CAPACITY
    size = np.array([len(x) for x in b])
    free = ~np.logical_or.reduceat(taken[np.concatenate(b).astype(np.int64)], np.cumsum(size) - size)
    kept = [b[k] for k in np.flatnonzero(full & free & (rng.random(len(b)) >= again))]
    taken[[i for x in kept for i in x]] = True
    rest = np.flatnonzero(~taken)
    if by_room:  # item by item into the room that it leaves least of, also in bins that are kept
        out = Bins(lengths.tolist(), injected + kept)
        out.put(rest.tolist())
        return out.bins
    return injected + kept + Pool(lengths, rest).bins(rng, rng.random() < 0.5)


def bound(lengths: np.ndarray) -> int:
    """Bins that any packing needs: for each small length k, items over half a bin have one each, those over CAPACITY - k
    alone, and the items from k to half a bin need what room these leave, or more bins."""
    most = np.bincount(lengths, minlength=CAPACITY + 1).astype(np.int64)
    n, s = np.cumsum(most), np.cumsum(most * np.arange(CAPACITY + 1))  # items and tokens of lengths up to the index
    half, k = CAPACITY // 2, np.arange(1, CAPACITY // 2 + 1)
    large, beside = n[-1] - n[half], n[CAPACITY - k] - n[half]
    room = beside * CAPACITY - (s[CAPACITY - k] - s[half])
    more = -((s[half] - s[k - 1] - room) // -CAPACITY)
    return int((large + np.maximum(more, 0)).max())


def evolve(lengths: list[int], start: list[list[int]], seed: int) -> list[list[int]]:
    """The best packing that one island finds in one epoch; start: the migrated solution, empty at first."""
    lengths = np.asarray(lengths, np.int64)
    rng = np.random.default_rng(seed)
    least = bound(lengths)
    rank = lambda x: _fitness(lengths, x)
    people = [start] if start else [best_fit(lengths)]
    if len(people[0]) <= least:
        return people[0]
    people.append(Pool(lengths, np.arange(len(lengths))).bins())
    people.append(Pool(lengths, np.arange(len(lengths))).bins(rng, eager=True))
    while len(people) < POPULATION:
        people.append(Pool(lengths, np.arange(len(lengths))).bins(rng))
    ranked = sorted(((rank(x), x) for x in people), key=lambda r: r[0])
    stale = 0
    for _ in range(GENERATIONS):
        (top, best), (_, mate), (last, _) = ranked[0], ranked[int(rng.integers(1, len(ranked)))], ranked[-1]
        if top[0] <= least or stale == PATIENCE:
            break
        child = _cross(lengths, best, mate, rng) if rng.random() < 0.5 else _cross(lengths, mate, best, rng)
        new = rank(child)
        stale = 0 if new < top else stale + 1
        if new < last:
            ranked = sorted([*ranked[:-1], (new, child)], key=lambda r: r[0])
    return ranked[0][1]


def _epoch(epoch: int):
    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by([("row", "ascending")])
        lengths, old = block.column("length").to_pylist(), block.column("bin").to_numpy()
        start: list[list[int]] = []
        if epoch:
            order = np.argsort(old, kind="stable")
            start = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(old[order])) + 1)]
        bins = evolve(lengths, start, int(key[0].as_py()) * 1009 + int(key[1].as_py()) * 31 + epoch)
        of = np.empty(len(lengths), np.int64)
        for k, x in enumerate(bins):
            of[x] = k
        size, fill = _fitness(np.asarray(lengths), bins)
        n = len(lengths)
        return pa.table({"grp": block.column("grp"), "island": block.column("island"), "row": block.column("row"), "length": block.column("length"), "bin": of, "bins": np.full(n, size), "fill": np.full(n, fill)})

    return run


def assign(items: DataFrame) -> DataFrame:
    """(row, bin_group, bin) of items (row, length), each length under the capacity; bins count within their group."""
    total = items.count()
    groups = max(1, -(-total // GROUP))
    # a named number of partitions is not merged by the size of the rows, which are few bytes for much work
    parts = min(groups * ISLANDS, max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups * ISLANDS // 16))
    islands = lambda x: x.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition(parts, "grp", "island")
    dealt = items.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"), "row", "length", F.lit(0).cast("long").alias("bin"))
    now = islands(dealt)
    schema = "grp long, island int, row long, length long, bin long, bins long, fill double"
    for epoch in range(EPOCHS):
        done = stored(now.groupBy("grp", "island").applyInArrow(_epoch(epoch), schema), "epoch")
        elite = done.groupBy("grp").agg(F.min(F.struct("bins", "fill", "island")).alias("e")).select("grp", F.col("e.island").alias("island"))
        best = done.join(elite, ["grp", "island"]).select("grp", "row", "length", "bin")
        now = islands(best)
    return best.select("row", F.col("grp").alias("bin_group"), "bin")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Sequences have at most CAPACITY tokens, without gaps. Null and empty texts are one token. Rows with the same or a
    null id are packed on their own. Full pieces have negative sequence ids. No documents: no rows. Other columns are
    ignored.
    """
    cut = stored(pieces(docs, tokenizer, id_col, text_col), "pieces").withColumn("row", F.monotonically_increasing_id())
    cut = stored(cut, "rows")
    part = cut.where(F.col("length") < CAPACITY)
    placed = part.join(assign(part.select("row", "length")), "row")
    # bins hold few items, so a bin is never a large group
    placed = placed.groupBy("bin_group", "bin").agg(F.sort_array(F.collect_list(F.struct("row", id_col, "piece", "start", "length", "ids_crc32"))).alias("x"))
    placed = placed.select((F.col("bin_group") * (1 << 20) + F.col("bin")).alias("sequence_id"), "x", F.posexplode("x").alias("i", "p"))
    offset = F.aggregate(F.slice("x", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, e: a + e["length"])
    placed = placed.select(F.col(f"p.{id_col}").alias(id_col), "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", offset.alias("offset"))
    full = cut.where(F.col("length") == CAPACITY).select(id_col, "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed)
