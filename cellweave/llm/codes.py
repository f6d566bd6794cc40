"""Vector code compression: every vector becomes one entry number for each of its parts, from codebooks fitted by rounds.

Components are whole numbers (floor of scale times the component), so results do not depend on the order of sums. Nearest
entries are screened by a float32 matrix product; each score stands in an interval that holds the true one, by the rounding
bound of dot products:

    |fl(a . b) - a . b| <= g(d) * sum |a_i| |b_i|,   g(d) = d u / (1 - d u),  u = 2^-24, in any order of summation.

Entries whose interval overlaps the best one's are computed again in int64, and the smallest index wins a tie. Codebooks are
bounded (entries x dimension) and travel with the tasks; a round sends back sums for each entry, added up in the tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.store import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 4096  # vectors of one matrix product


@dataclass(frozen=True)
class Codebooks:
    """entries[p] holds the whole-number entries of part p, (entries, width of the part)."""

    entries: tuple[np.ndarray, ...]
    scale: int

    @property
    def dim(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()

    def edges(self) -> list[int]:
        return [0, *np.cumsum([e.shape[1] for e in self.entries]).tolist()]


def widths(dim: int, parts: int) -> list[int]:
    """Widths of consecutive parts: equal, or the first dim % parts wider by one."""
    return [dim // parts + (i < dim % parts) for i in range(parts)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, both exact; ties go to the lower index.

    The score of entry c is |c|^2 - 2 x . c, a product of (-2 x, 1) and (c, |c|^2), each rounded to float32 once.
    """
    n, d = x.shape
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    square = (entries.astype(np.float64) ** 2).sum(axis=1)
    left = np.concatenate([-2 * x, np.ones((n, 1), x.dtype)], axis=1).astype(np.float32)
    right = np.concatenate([entries, square[:, None]], axis=1).astype(np.float32)
    score = left @ right.T
    # d + 1 terms, two roundings of the factors, one of the sum and of each interval's end, and room for these bounds' own
    terms = d + 8
    g = terms * 2.0**-24 / (1 - terms * 2.0**-24) * 1.0001
    width = (2 * norm[:, None] * np.sqrt(square)[None, :] + square[None, :]) * g
    width = width.astype(np.float32) * np.float32(1.0001)
    best = (score + width).min(axis=1)
    row, entry = np.nonzero(score - width <= best[:, None])
    delta = x[row] - entries[entry]
    exact = np.einsum("ij,ij->i", delta, delta)
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(exact, first)
    won = np.flatnonzero(exact == least[row])
    _, at = np.unique(row[won], return_index=True)
    return entry[won[at]], least


def _parts(column: pa.Array, books: Codebooks) -> list[np.ndarray]:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), books.dim)
    return [np.ascontiguousarray(x[:, a:b]) for a, b in zip(books.edges(), books.edges()[1:])]


def _assigned(column: pa.Array, books: Codebooks) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first row, for each part its vectors, entry indexes and squared distances) of some rows at a time."""
    for lo in range(0, len(column), ROWS):
        yield lo, [(x, *nearest(x, e)) for x, e in zip(_parts(column.slice(lo, ROWS), books), books.entries)]


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            for _, found in _assigned(batch.column("ints"), books):
                for p, (x, code, _) in enumerate(found):
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
                    order = np.argsort(code, kind="stable")
                    used, at = np.unique(code[order], return_index=True)
                    if x.shape[1]:
                        sums[p][used] += np.add.reduceat(x[order], at, axis=0)
        for p, (count, total) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(count)
            if len(used) and total.shape[1]:
                entry, place = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place), pa.array(count[entry]), pa.array(total[entry, place])], names=["part", "entry", "place", "n", "total"])

    return run


def whole_numbers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, ints) of the vectors that are not null, not empty and have finite components only.

    Components beyond what keeps squared distances of whole vectors within int64 count as that bound.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where((F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    limit = F.expr(f"least(floor(sqrt({1 << 61}D / size(vec)) / 2), {1 << 28}D)")
    return rows.select("id", "label", F.transform("vec", lambda v: F.greatest(-limit, F.least(limit, F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), v * scale))).cast("double"))).cast("int")).alias("ints"))


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks from whole-number vectors (id, ints), or None where there are none.

    Each starts as that part of the vectors with the smallest ids (null last, equal ids by their components); fewer vectors
    than entries give fewer entries. In each round an entry becomes the mean of its parts, components rounded down; entries
    without parts stay. The dimension is that of the smallest id; vectors of another one are not fitted.
    """
    # ids in order, as many as entries: the bound of what comes to the driver
    first = ints.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["ints"])
    same = ints.where(F.size("ints") == dim)
    start = np.array([r["ints"] for r in same.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()], np.int64)
    edges = np.concatenate([[0], np.cumsum(widths(dim, parts))])
    books = Codebooks(tuple(np.ascontiguousarray(start[:, a:b]) for a, b in zip(edges, edges[1:])), scale)
    for _ in range(rounds):
        found = same.select("ints").mapInArrow(_sums(books), "part long, entry long, place long, n long, total long")
        found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        now = [e.copy() for e in books.entries]
        for r in found.collect():  # at most entries x dimension
            now[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = Codebooks(tuple(now), scale)
    return books


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, codes, error): the entry numbers of each part, and the squared distance to them over all parts.

    Vectors of another dimension than the codebooks' have null for both.
    """
    out = f"id {ints.schema['id'].dataType.simpleString()}, label {ints.schema['label'].dataType.simpleString()}, codes array<int>, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, found in _assigned(batch.column("ints"), books):
                codes = np.stack([code for _, code, _ in found], axis=1).astype(np.int32)
                n = len(codes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, n), batch.column("label").slice(lo, n), lists, pa.array(sum(d for _, _, d in found))], names=["id", "label", "codes", "error"])

    same = F.size("ints") == books.dim
    return ints.where(same).mapInArrow(run, out).unionByName(ints.where(~same).select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")))


def decode(encoded: DataFrame, books: Codebooks) -> DataFrame:
    """encoded with `vector`, the doubles that its codes stand for: each component's middle of the range that floor merged."""
    kind = "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("codes").is_valid().to_numpy(zero_copy_only=False)
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, len(books.entries))
            vecs = (np.concatenate([e[codes[:, p]] for p, e in enumerate(books.entries)], axis=1) + 0.5) / books.scale
            at = np.concatenate([[0], np.cumsum(np.where(known, books.dim, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(vecs.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, vector {kind}")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Left out: vectors that are null or hold null or non-finite components, and empty ones. Codes are two hex digits for
    each part (entries up to 256). label_error is summed over equal labels, nulls together, NULL beyond a long. Components
    whose whole number passes the bound of `whole_numbers` count as that. Vectors of another dimension than the smallest id's have NULL for
    code and error. Ids may repeat or be null; no vectors: no rows. Other columns are ignored.
    """
    ints = stored(whole_numbers(vectors, scale, id_col, vec_col, label_col), "whole")
    books = fit(ints, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks((np.zeros((0, 0), np.int64),) * parts, scale)
    coded = stored(encode(ints, books), "coded")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    coded = coded.withColumn("code", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), ""))
    joined = coded.alias("a").join(sums.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")), "left")
    return joined.select(F.col("a.id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        # whole numbers far below 2^53, so doubles are exact
        steps.append(
            f"""d{i} AS (SELECT vec_id, label, p.part, entry, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{i} USING (part)),
a{i} AS MATERIALIZED (SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, any_value(x) AS x, min(d) AS d FROM d{i} GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY vec_id, label, part")
        )
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS (SELECT part, entry, place, floor(sum(x[place]) / count(*)) AS c FROM a{i}, (SELECT unnest(range(1, max(len(x)) + 1)) AS place FROM p) GROUP BY part, entry, place),
n{i} AS (SELECT part, entry, list(c ORDER BY place) AS c FROM m{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (part, entry))"""
            )
    last = ROUNDS
    return (
        ",\n".join(steps)
        + f""",
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last}),
r AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"""
    )


ORACLE = _oracle()
