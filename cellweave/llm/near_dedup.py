"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. Each document's word shingles are hashed once. The hash range is cut into bins, the smallest hash of each bin is the
   signature, and an empty bin takes the value of the first filled bin in its own fixed random order of bins.
2. Documents with equal shingle sets become one class before any bucket is made, so a huge group of copies is one row.
3. Bands of the signature are bucket keys. The first candidates are stars: each member of a bucket with its smallest id.
   They are confirmed on the full shingle sets, which are made once, of the members of buckets.
4. Members of one bucket that are still in different components are compared as well, so that no link that a bucket
   shows is lost. Buckets with equal members count once. The members outside a bucket's largest component are held
   against one another and against that component, block by block inside tasks that give back only which components
   hang together. Members that the stars have connected need no more comparisons.

The number of bands follows from the threshold: a pair at the threshold misses all buckets with probability under 1e-8.
"""


from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import textkit as tk
from cellweave.llm.graph import components
from cellweave.llm.groups import each_group
from cellweave.llm.store import stored

ROWS = 4  # bins in a band
MISS = 1e-8
BLOCK = 256  # documents in a block, about, of which two meet in a group
BLOCK_ITEMS = 1 << 20  # shingles in a block, about
STEP = 4096  # shingles of one matrix product


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _orders(bins: int) -> np.ndarray:
    """order[i, j]: the place of bin j in bin i's own order, drawn once from a fixed seed."""
    return np.argsort(np.random.default_rng(20240607).random((bins, bins)), axis=1).argsort(axis=1)


def signature(hashes: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """One-permutation signature with optimal densification of a non-empty set."""
    g = np.sort(tk.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
    where = ((g >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    filled = where[first].astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[filled] = g[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        out[empty] = out[filled[np.argmin(orders[np.ix_(empty, filled)], axis=1)]]
    return out


def _signed(k: int, bands: int):
    bins = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(bins)
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                n, a, b, keys = [], [], [], np.zeros((hi - lo, bands), np.uint64)
                for i, s in enumerate(tk.shingles(data, offsets, k)):
                    n.append(len(s))
                    a.append(int(tk.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    b.append(int(tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    if len(s):
                        sig = signature(s, bins, orders).reshape(bands, ROWS)
                        key = np.arange(bands, dtype=np.uint64)
                        for j in range(ROWS):
                            key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
                        keys[i] = key
                count = np.where(np.array(n) > 0, bands, 0)
                flat = keys[np.array(n) > 0].ravel().view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], names=["id", "n", "sig_a", "sig_b", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                found = list(tk.shingles(data, offsets, k))
                at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["id", "items"])

    return run


def _alike(n: Column, m: Column, t: Fraction) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) * t.denominator >= F.greatest(n, m) * t.numerator


def _confirmed(cands: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The candidate pairs (a, b) whose full shingle sets reach the threshold, exactly in whole numbers."""
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return cands.join(left, "a").join(right, "b").where(both * t.denominator >= (F.size("x") + F.size("y") - both) * t.numerator).select("a", "b")


def _linked(t: Fraction):
    """Which components hang together by links within one group of documents: a spanning forest over the components.

    Common shingles are counted by products of 0/1 blocks.
    """

    def group(block: pa.Table) -> pa.RecordBatch | None:
        comp = block.column("comp").to_numpy()
        names, own = np.unique(comp, return_inverse=True)
        if len(names) < 2:
            return None
        items = block.column("items").combine_chunks()
        size = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, code, docs = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(comp)), size), docs[code] > 1
        code, row = np.unique(code[often], return_inverse=True)[1], row[often]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        both = np.zeros((len(comp), len(comp)), np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, STEP):
            lo, hi = np.searchsorted(code, [at, at + STEP])
            part = np.zeros((len(comp), STEP), np.float32)
            part[row[lo:hi], code[lo:hi] - at] = 1
            both += part @ part.T
        common = both.astype(np.int64)
        ok = (common * t.denominator >= (size[:, None] + size[None, :] - common) * t.numerator) & (comp[:, None] != comp[None, :])
        x, y = own[np.stack(np.nonzero(ok))]
        root = np.arange(len(names))  # the smallest component reached; names are in ascending order
        while len(x):
            least = root.copy()
            np.minimum.at(least, x, root[y])
            if (least == root).all():
                break
            root = least
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])

    return group


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, comp, n) of the buckets whose members are in several components, each set of members once."""
    at = stored(shared.select("key", "id", "n").join(found, "id", "left").select("key", "id", "n", F.coalesce("component_id", "id").alias("comp")), "members")
    mark = lambda salt: F.bit_xor(F.xxhash64("id", F.lit(salt))).alias(f"m{salt}")
    keys = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), mark(1), mark(2)).where("lo < hi")
    keys = keys.groupBy("size", "lo", "hi", "m1", "m2").agg(F.min("key").alias("key"))
    return at.join(keys.select("key"), "key", "left_semi")


def _across(open_: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(a, b): components that hang together by links between members of one open bucket.

    The largest component of a bucket is cut into blocks, and the other members into blocks. Each block of these meets
    each one of both kinds in a group of bounded size; members of the largest component never meet one another.
    """
    parts = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / F.lit(BLOCK), s / F.lit(BLOCK_ITEMS))).cast("int")
    plan = parts.groupBy("key").agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    plan = plan.select("key", F.col("top.comp").alias("top"), blocks(F.col("top.c"), F.col("top.s")).alias("tops"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("rests"))
    dealt = open_.join(plan, "key").withColumn("side", F.col("comp") == F.col("top"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("side"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    meets = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    # x: a block of the others; y: a block of the largest component from 0 on, or another block of the others from -1 down
    own = F.col("block")
    with_top = F.transform(every(F.col("tops")), lambda i: meets(own, i))
    with_rest = F.when(F.col("rests") > 1, F.transform(every(F.col("rests")), lambda i: meets(F.least(own, i), -1 - F.greatest(own, i)))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    groups = F.when(F.col("side"), F.transform(every(F.col("rests")), lambda i: meets(i, own))).otherwise(F.concat(with_top, with_rest))
    dealt = dealt.select("key", "id", "comp", F.explode(groups).alias("g")).select("key", "g.x", "g.y", "id", "comp")
    full = dealt.join(sets, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return full.select("key", "x", "y", "comp", "items").mapInArrow(each_group(("key", "x", "y"), _linked(t)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every document.

    A document's set: the distinct shingles of so many words, A-Z lower-cased, over the whole text. Null or empty texts
    and texts of white space have an empty set and are linked with nothing. Ids are unique; where one repeats, every
    row still gets a component, and rows of equal sets the same one. Rows with a null id are left out of the links and
    returned with themselves (component_id null, kept true). No documents: no rows. Other columns are ignored.
    """
    t = Fraction(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(docs.mapInArrow(_signed(words, bands_for(float(t))), "id long, n long, sig_a long, sig_b long, bands array<long>"), "signed")
    real = signed.where("n > 0 and id is not null")
    classes = stored(real.groupBy("sig_a", "sig_b", "n").agg(F.min("id").alias("rep")), "classes")
    reps = real.join(classes.withColumnRenamed("rep", "id"), ["id", "sig_a", "sig_b", "n"], "left_semi")
    members = reps.select("id", "n", F.explode("bands").alias("key"))
    centres = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(members.join(centres, "key").select("key", "id", "n", "c"), "buckets")
    # texts are dealt out by id once, whatever the number of ids that are wanted
    wanted = shared.select("id").distinct()
    sets = stored(docs.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(_sets(words), "id long, items array<long>"), "sets")
    stars = shared.where((F.col("id") != F.col("c.id")) & _alike(F.col("n"), F.col("c.n"), t)).select(F.col("id").alias("a"), F.col("c.id").alias("b")).distinct()
    found = stored(components(_confirmed(stars, sets, t), "a", "b"), "components")
    more = components(_across(_open(shared, found), sets, t), "a", "b")
    of = found.withColumnRenamed("component_id", "comp").join(more.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("component_id", "comp").alias("component_id"))
    # components of one member are in `more` alone
    of = of.unionByName(more.join(found.select("id"), "id", "left_anti"))

    of_rep = classes.join(of.withColumnRenamed("id", "rep"), "rep", "left").select("sig_a", "sig_b", "n", F.coalesce("component_id", "rep").alias("component_id"))
    # the many rows without words have one key between them and stay out of the join
    joined = real.select("id", "n", "sig_a", "sig_b").join(of_rep, ["sig_a", "sig_b", "n"], "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    every = joined.unionByName(alone)
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
