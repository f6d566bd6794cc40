"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are turned by random rotations; the signs are the code, and the inner product of the code with the turned
vector is stored as its correction factor. <code_a, turned b> / factor_a is an unbiased estimate of <a, b> with a known
error bound, so pairs whose bound lies under the threshold are settled by their codes; the others are computed exactly in
double precision.

Runs of code bits are bucket keys; how many bits and runs follows from the number of vectors and from the threshold (a
pair at the threshold misses all buckets with probability under MISS). Equal vectors become one class first. Buckets are
cut into blocks, and pairs of blocks are compared inside tasks, in two passes. The first has codes, factors and vectors
rounded to a byte for each component (what rounding can add goes into the bound), and gives back the members of pairs that
stay open; a pair in several buckets counts in the first, of buckets with equal members only the first is looked at, and
pairs within the largest class of members that share an earlier key are passed over. Whole vectors travel in the second pass, for these members only,
which gives back counts and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.graph import components
from cellweave.llm.groups import each_group
from cellweave.llm.store import stored

MISS = 1e-4
BLOCK = 512  # vectors in a block, of which two meet
FILL = 32  # vectors that a bucket would hold if all were spread evenly
SMALL = 128  # members of a group that are compared whole sooner than sorted by their earlier keys
SIGMAS = 5.0
PAIRS = 1 << 15  # pairs looked at together in a task
GROUP = ("key", "dim", "x", "y")


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, number of keys) for n vectors in the largest group."""
    bits = min(24, max(4, math.ceil(math.log2(max(n, 2) / FILL)))) if n > FILL else 4
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def rotations(dim: int, total_bits: int) -> np.ndarray:
    """Stacked random rotations, (rotations, dim, dim), from a fixed seed."""
    rng = np.random.default_rng(77003)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-total_bits // dim))])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by powers of two first, so that no square overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _codes(bits: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = _unit(_rows(part.column("vec")))
                if dim not in turn:
                    turn[dim] = rotations(dim, bits * keys)
                turned = np.einsum("rij,nj->nri", turn[dim], v)
                factor = np.abs(turned).sum(axis=2) / math.sqrt(dim)
                code = np.packbits((turned >= 0).reshape(len(v), -1), axis=1)
                key = _keys(code, bits, keys)
                at = lambda n: pa.array((np.arange(len(v) + 1) * n).astype(np.int32))
                step = np.abs(v).max(axis=1) / 127
                rounded = np.rint(v / step[:, None]).astype(np.int8)
                binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                lists = lambda rows, kind: pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * rows.shape[1]).astype(np.int32)), pa.array(rows.ravel().astype(kind)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("label"), part.column("copies"), part.column("vec"), binary(code), lists(factor, np.float32), lists(key, np.int64), binary(rounded), pa.array(step.astype(np.float32))],
                    names=["rep", "label", "copies", "vec", "code", "factor", "keys", "rounded", "step"],
                )

    return run


def _keys(code: np.ndarray, bits: int, keys: int) -> np.ndarray:
    raw = np.unpackbits(code, axis=1)[:, : bits * keys].reshape(len(code), keys, bits).astype(np.int64)
    return raw @ (1 << np.arange(bits, dtype=np.int64))


def _bytes(t: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind).reshape(t.num_rows, -1)


def _unmet(key: np.ndarray, band: int) -> np.ndarray:
    """The members of a bucket outside the largest class of it that has one earlier key in common.

    Pairs within that class count in the earlier bucket, so only pairs with a member outside it are left to look at.
    """
    if not band:
        return np.arange(len(key))
    place = np.sort(key[:, :band], axis=0)
    start = np.vstack([np.ones((1, band), bool), place[1:] != place[:-1]])
    run = np.arange(len(key))[:, None] - np.maximum.accumulate(np.where(start, np.arange(len(key))[:, None], 0), axis=0)
    last = run.argmax(axis=0)
    best = int(run.max(axis=0).argmax())
    return np.flatnonzero(key[:, best] != place[last[best], best])


def _pairs(t: pa.Table, rest: np.ndarray, near: np.ndarray, key: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs marked in near (a row for each of rest), each once, whose first common key is this group's, some at a time.

    Where there are two blocks, only those between them.
    """
    side, among = t.column("block").to_numpy(), np.zeros(len(key), bool)
    among[rest] = True
    near = near & (~among[None, :] | (rest[:, None] < np.arange(len(key))[None, :]))
    if t.column("x")[0] != t.column("y")[0]:
        near &= side[rest, None] != side[None, :]
    x, y = np.nonzero(near)
    x = rest[x]
    for lo in range(0, len(x), PAIRS):
        a, b = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
        first = np.argmax(key[a] == key[b], axis=1) == band
        yield a[first], b[first]


def _open(bits: int, keys: int, threshold: float):
    """Of one pair of blocks: the members with a pair that the codes do not settle."""
    turn: dict[int, np.ndarray] = {}

    def group(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        packed = _bytes(t, "code", np.uint8)
        key, band = _keys(packed, bits, keys), t.column("band")[0].as_py()
        rest = _unmet(key, band) if t.num_rows >= SMALL else np.arange(t.num_rows)
        if not len(rest):
            return None
        step = t.column("step").to_numpy()
        v = _bytes(t, "rounded", np.int8) * step[:, None]
        n, dim = v.shape
        if dim not in turn:
            turn[dim] = rotations(dim, bits * keys).astype(np.float32)
        turned = np.einsum("rij,nj->nri", turn[dim], v, optimize=True)
        signs = turned.shape[1]
        code = np.unpackbits(packed, axis=1)[:, : signs * dim].reshape(turned.shape) * np.float32(2) - 1
        factor = _rows(t.column("factor").combine_chunks())
        # unbiased estimates by each rotation, averaged; both directions of a pair
        code = (code / (factor[:, :, None] * math.sqrt(dim))).astype(np.float32).reshape(n, -1)
        turned = turned.reshape(n, -1)
        est = (code[rest] @ turned.T + turned[rest] @ code.T) / (2 * signs)
        error = SIGMAS * np.sqrt(np.maximum(1 / factor**2 - 1, 0).mean(axis=1) / (max(dim - 1, 1) * signs))
        error += (1 / factor).mean(axis=1) * step.max() * math.sqrt(dim) / 2 + 1e-5  # rounding of either side
        flagged = np.zeros(n, bool)
        for x, y in _pairs(t, rest, est + np.maximum(error[rest, None], error[None, :]) >= threshold, key, band):
            flagged[x] = flagged[y] = True
        return t.select([*GROUP, "band", "block", "rep"]).filter(pa.array(flagged)).combine_chunks().to_batches()[0] if flagged.any() else None

    return each_group(GROUP, group)


def _compare(bits: int, keys: int, threshold: float):
    """Of one pair of blocks: ids, linked vectors (copies counted), and the smallest id linked to it here."""

    def group(t: pa.Table) -> pa.RecordBatch | None:
        ids, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        key, band = _keys(_bytes(t, "code", np.uint8), bits, keys), t.column("band")[0].as_py()
        rest = _unmet(key, band) if t.num_rows >= SMALL else np.arange(t.num_rows)
        if not len(rest):
            return None
        v = _unit(_rows(t.column("vec").combine_chunks()))
        links, ends = np.zeros(len(ids), np.int64), []
        for x, y in _pairs(t, rest, (v[rest] @ v.T >= threshold - 1e-9) & (label[rest, None] == label[None, :]), key, band):
            near = np.einsum("ij,ij->i", v[x], v[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            ends.append((x, y))
        if not links.any():
            return None
        x, y = (np.concatenate(e) for e in zip(*ends))
        root = ids.copy()
        while True:
            least = root.copy()
            np.minimum.at(least, x, root[y])
            np.minimum.at(least, y, root[x])
            if (least == root).all():
                break
            root = least
        got = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(links[got]), pa.array(root[got])], names=["rep", "links", "root"])

    return each_group(GROUP, group)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every vector.

    Linked: equal labels that are not null, equal dimensions, and a cosine of at least the threshold. Vectors that are
    null, empty, zero or hold null or non-finite components are linked with nothing, nor are rows with a null id. Any
    finite length will do. Ids are unique but for whole rows that repeat, which link with one another. No
    vectors: no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    good_rows = rows.where(good)
    classes = stored(good_rows.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    most = classes.groupBy("label", F.size("vec")).count().agg(F.max("count")).first()[0] or 0
    bits, keys = plan(most, threshold)
    coded = stored(classes.select("rep", "label", "copies", "vec").mapInArrow(_codes(bits, keys), "rep long, label string, copies long, vec array<double>, code binary, factor array<float>, keys array<long>, rounded binary, step float"), "codes")
    spread = coded.select("rep", F.posexplode("keys").alias("band", "bits"), "label", F.size("vec").alias("dim")).select("rep", "band", "dim", F.xxhash64("label", "dim", "band", "bits").alias("key"))
    mark = lambda salt: F.bit_xor(F.xxhash64("rep", F.lit(salt))).alias(f"m{salt}")
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("band").alias("band"), mark(1), mark(2)).where("n > 1")
    # of buckets with equal members the first, in which all their pairs count
    sizes = sizes.groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "key"))["key"].alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = spread.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "dim", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "band", "block", "rep")

    def grouped(members: DataFrame, *columns: str) -> DataFrame:
        at = members.join(coded.select("rep", *columns), "rep").select(*GROUP, "band", "block", "rep", *columns)
        return at.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")

    open_ = stored(grouped(dealt, "code", "factor", "rounded", "step").mapInArrow(_open(bits, keys, threshold), "key long, dim int, x int, y int, band int, block int, rep long"), "open")
    found = stored(grouped(open_, "label", "copies", "vec", "code").mapInArrow(_compare(bits, keys, threshold), "rep long, links long, root long"), "near")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root").withColumnRenamed("id", "rep")
    state = classes.select("label", "vec", "rep", "copies").join(links, "rep", "left").join(parts, "rep", "left")
    state = state.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    done = good_rows.join(state, ["label", "vec"], "left").select("id", "n_links", "component_id")
    done = done.unionByName(rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
