"""Merkle manifest of a dataset, held as an external-memory store of nodes.

1. Leaves are hashed where the texts are read (built-in functions); from there on only digests move.
2. Leaves are range-sorted into runs by tree and id and written; counts of the runs give each leaf its coordinate, so no
   window passes over a tree.
3. A climb reads one level of the store and writes the next STEP levels: the nodes under one aligned block of 2^STEP
   nodes meet in a task, which hashes them level by level. A level is one partition of the Parquet store, its rows are
   aligned runs of digests, and the next climb reads the last level written.
4. Subroots, in order of their tree, are the leaves of a top tree that is climbed alike.
5. Proofs go down: a block's levels are read by coordinate, merged with the proof of the block's own node, and give the
   proofs of the nodes below. The block is the unit of memory at any number of leaves.

A node at `level` with number i is H of the nodes 2i and 2i + 1 below, of the one there is for the last; a tree ends where
one node remains.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.groups import each_group
from cellweave.llm.store import shared_dir, stored

STEP = 10  # levels of one climb: a block has 2^STEP nodes, 32 KB of digests
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Hex sha256 of the fields, each `-` if null, else its length in UTF-8 bytes, `:` and its value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


def _hex(digest: bytes) -> bytes:
    return digest.hex().encode()


def _up(below: list[bytes]) -> list[bytes]:
    """The digests above: H of every two consecutive ones as hex text, of a last one alone."""
    text = [_hex(d) for d in below] + [b""]
    return [sha256(text[i] + text[i + 1]).digest() for i in range(0, len(below), 2)]


def _cut(blob: bytes) -> list[bytes]:
    return [blob[i : i + 32] for i in range(0, len(blob), 32)]


@dataclass(frozen=True)
class Manifest:
    """A written manifest: its leaves with coordinates, its nodes by level, its trees, and the digest of the whole."""

    leaves: DataFrame  # tree, i (number in the tree), id, leaf, claim (hex) and the tree's n
    nodes: DataFrame  # level, tree, block (of the level's climb), digests; the top tree's have top = true
    trees: DataFrame  # tree (number in order of its key), key, n, subroot
    root: str | None
    step: int


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their number in the tree, and trees with their size and number: sorted runs, then offsets of runs."""
    spark = leaves.sparkSession
    runs = leaves.repartitionByRange("key", "id", "leaf", "row").sortWithinPartitions("key", "id", "leaf", "row")
    runs = stored(runs.withColumn("run", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "runs")
    sizes = runs.groupBy("key", "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")), "offsets")
    # trees in order: a range sort and offsets of its parts, since there may be many
    trees = sizes.groupBy("key").agg(F.sum("n").alias("n")).repartitionByRange("key").sortWithinPartitions("key")
    trees = stored(trees.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "trees")
    parts = trees.groupBy("part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each partition
    offsets, at = [], 0
    for r in parts:
        offsets.append((r["part"], at - r["first"]))
        at += r["n"]
    trees = trees.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").select((F.col("pos") + F.col("offset")).alias("tree"), "key", "n")
    trees = stored(trees, "trees")
    at = sizes.select("key", "run", "offset").join(trees, "key")
    numbered = runs.join(at, ["key", "run"]).select("tree", (F.col("pos") + F.col("offset")).alias("i"), "n", "id", F.unhex("leaf").alias("digest"), F.unhex("claim").alias("claim"))
    return stored(numbered, "leaves"), trees


def _climb(nodes: DataFrame, level: int, step: int) -> DataFrame:
    """Runs (level, tree, block, n, digests) of levels `level` to `level` + step above nodes (tree, i, n, digest).

    n is the number of leaves of the tree. The last of these levels is a single digest for each block; a tree that ends
    within has none above its subroot.
    """

    def block(t: pa.Table) -> pa.RecordBatch:
        digests = t.column("digest").to_pylist()
        tree, at, leaves = (t.column(c)[0].as_py() for c in ("tree", "block", "n"))
        left = -(-leaves >> level)  # nodes of the tree at this level
        rows, up = [], level
        while True:
            rows.append((up, b"".join(digests)))
            if left == 1 or up == level + step:
                break
            digests, left, up = _up(digests), -(-left // 2), up + 1
        k = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([tree] * k, pa.int64()), pa.array([at] * k, pa.int64()), pa.array([leaves] * k, pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["level", "tree", "block", "n", "digests"],
        )

    at = nodes.select("tree", F.shiftright("i", step).alias("block"), "i", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return at.mapInArrow(each_group(("tree", "block"), block), "level int, tree long, block long, n long, digests binary")


def _forest(nodes: DataFrame, most: int, step: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(all runs of all levels, (tree, subroot)) of trees of at most `most` leaves, from their leaves (tree, i, n, digest).

    A level that ends a climb starts the next one; it is written by the lower climb, one digest for each block.
    """
    spark = nodes.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    level, schema = 0, "tree long, block long, n long, digests binary, level int"
    while True:
        # `climb` keeps a level that two climbs have apart
        _climb(nodes, level, step).withColumn("climb", F.lit(level)).write.mode("append").partitionBy("climb", "level").parquet(path)
        runs = spark.read.schema(schema + ", climb int").parquet(path)
        if most <= 1 << level + step:
            break
        level += step
        above = runs.where((F.col("climb") == level - step) & (F.col("level") == level))
        nodes = above.where(F.col("n") > F.lit(1 << level)).select("tree", F.col("block").alias("i"), "n", F.col("digests").alias("digest"))
    height = F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))  # levels above the leaves
    return runs, runs.where((F.col("level") == height) & (F.col("block") == 0) & (F.length("digests") == 32)).groupBy("tree").agg(F.first("digests").alias("subroot"))


def _siblings(block: list[list[bytes]], i: int) -> list[bytes]:
    """The nodes beside the path of node i of a block, from its lowest level up; the last level has no sibling there."""
    return [row[(i >> k) ^ 1] for k, row in enumerate(block[:-1]) if (i >> k) ^ 1 < len(row)]


def _down(runs: DataFrame, above: DataFrame, level: int, step: int, below: DataFrame | None, out: str, give: Callable[[list[bytes], list[bytes], int, dict], tuple]) -> DataFrame:
    """A merge-scan of one climb's runs with the proofs of its blocks' own nodes (tree, i, proof): columns that `give` makes
    of the siblings inside the block, those above it, the number of the node and its row of `below`.

    below: (tree, i, ...) of nodes of this climb's lowest level, returned with the new columns; where not given, each node.
    """
    every, passed = below is None, [f for f in below.schema if f.name not in ("tree", "i")] if below is not None else []
    names = ["tree", "i", *[f.name for f in passed]]
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in passed]
    rows = runs.where(F.col("climb") == level).select("tree", "block", F.lit(0).alias("kind"), F.col("level").cast("long").alias("i"), F.col("digests").alias("blob"), *null)
    rows = rows.unionByName(above.select("tree", F.col("i").alias("block"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("i"), F.col("proof").alias("blob"), *null))
    if below is not None:
        rows = rows.unionByName(below.select("tree", F.shiftright("i", step).alias("block"), F.lit(2).alias("kind"), "i", F.lit(None).cast("binary").alias("blob"), *[f.name for f in passed]))
    fields = [x.split() for x in out.split(", ")]
    arrow = {"string": pa.string(), "binary": pa.binary()}

    def block(t: pa.Table) -> pa.RecordBatch | None:
        kind, at, blob = t.column("kind").to_numpy(), t.column("i").to_numpy(), t.column("blob")
        levels = [_cut(blob[j].as_py()) for j in np.flatnonzero(kind == 0).tolist()]
        proof = [d for j in np.flatnonzero(kind == 1).tolist() for d in _cut(blob[j].as_py())]
        first = t.column("block")[0].as_py() << step
        if every:
            asked = pa.table({"tree": pa.array(np.full(len(levels[0]), t.column("tree")[0].as_py())), "i": pa.array(first + np.arange(len(levels[0])))})
        else:
            asked = t.filter(pa.array(kind == 2)).select(names)
        if not asked.num_rows:
            return None
        made = [give(_siblings(levels, i - first), proof, i, row) for i, row in zip(asked.column("i").to_pylist(), asked.to_pylist())]
        for (name, kind_), values in zip(fields, zip(*made)):
            asked = asked.append_column(name, pa.array(values, arrow[kind_]))
        return asked.combine_chunks().to_batches()[0]

    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "i")
    return rows.mapInArrow(each_group(("tree", "block"), block), "tree long, i long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passed) + out)


def _joined(own: list[bytes], proof: list[bytes], i: int, row: dict) -> tuple[bytes]:
    return (b"".join(own + proof),)


def _proofs_down(runs: DataFrame, most: int, step: int, tops: DataFrame) -> DataFrame:
    """(tree, i, proof) of the nodes that the lowest climb ended in (its blocks), from those of the trees' subroots (tree, proof)."""
    level = 0
    while most > 1 << level + step:
        level += step
    above = tops.select("tree", F.lit(0).cast("long").alias("i"), "proof")
    while level > 0:
        # trees that ended in a lower climb take part from there on
        here = runs.where(F.col("climb") == level).select("tree").distinct()
        found = _down(runs, above.join(here, "tree", "left_semi"), level, step, None, "proof binary", _joined)
        above = stored(found.unionByName(above.join(here, "tree", "left_anti")), "proofs")
        level -= step
    return above


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None, step: int = STEP) -> Manifest:
    """The manifest of docs: a tree for each value of tree_col (null first, then by UTF-8 bytes), leaves in order of ids.

    `changed` gives columns of claimed rows, which `prove` holds against the manifest; without it the rows themselves are
    claimed. Null ids come first; equal ids are ordered by their leaves. No rows: no root.
    """
    claim = [changed[f].cast("string") if changed and f in changed else F.col(f) for f in fields]
    key = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))  # null before any text
    made = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"), leaf(claim).alias("claim"))
    leaves, trees = _numbered(stored(made.withColumn("row", F.monotonically_increasing_id()), "hashed"))
    most, count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    if not count:
        return Manifest(leaves, None, trees.withColumn("subroot", F.lit(None).cast("binary")), None, step)
    runs, subroots = _forest(leaves.select("tree", "i", "n", "digest"), most, step, "nodes")
    trees = stored(trees.join(subroots, "tree"), "subroots")
    top, roots = _forest(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest")), count, step, "top")
    return Manifest(leaves, runs.withColumn("top", F.lit(False)).unionByName(top.withColumn("top", F.lit(True))), trees, bytes(roots.first()["subroot"]).hex(), step)


def _fold(digest: bytes, i: int, n: int, proof: list[bytes]) -> tuple[bytes, int]:
    """(root of a tree of n leaves from leaf i and its siblings, siblings used)."""
    used = 0
    while n > 1:
        if (i ^ 1) < n:
            other = _hex(proof[used])
            digest = sha256(other + _hex(digest) if i & 1 else _hex(digest) + other).digest()
            used += 1
        else:
            digest = sha256(_hex(digest)).digest()
        i, n = i >> 1, -(-n // 2)
    return digest, used


def prove(manifest: Manifest) -> DataFrame:
    """(id, leaf, claim, subroot, root, proof, proof_sha256, folded_root, verified) of every leaf.

    proof: the siblings' digests, 32 bytes each, from the leaf's level up to the subroot and on to the root. folded_root
    comes from the claimed leaf and these siblings; a claim that is the leaf itself gives the root.
    """
    low = lambda c: F.lower(F.hex(c)).alias(c)
    root, step = manifest.root, manifest.step
    if root is None:
        none = {"subroot": "string", "root": "string", "proof": "binary", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
        return manifest.leaves.select("id", low("digest").alias("leaf"), low("claim"), *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    most, count = manifest.trees.agg(F.max("n"), F.count(F.lit(1))).first()
    top, runs = (manifest.nodes.where(F.col("top") == t) for t in (True, False))
    above = manifest.leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(b"").alias("proof"))
    tops = _down(top, _proofs_down(top, count, step, above), 0, step, None, "proof binary", _joined)
    tops = stored(tops.select(F.col("i").alias("tree"), "proof"), "proofs")  # the top tree's leaves are the trees

    def give(own: list[bytes], proof: list[bytes], i: int, row: dict) -> tuple[bytes, str, str]:
        path = own + proof
        got, used = _fold(row["claim"], i, row["n"], path)
        got, _ = _fold(got, row["tree"], count, path[used:])
        return b"".join(path), sha256(b"".join(map(_hex, path))).hexdigest(), got.hex()

    proved = _down(runs, _proofs_down(runs, most, step, tops), 0, step, manifest.leaves, "proof binary, proof_sha256 string, folded_root string", give)
    proved = proved.join(manifest.trees.select("tree", "subroot"), "tree")
    return proved.select(
        "id", low("digest").alias("leaf"), low("claim"), low("subroot"), F.lit(root).alias("root"), "proof", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def tampered(id_col: str = "doc_id", count_col: str = "n_chars") -> dict[str, Column]:
    """Claims that differ where 7 divides crc32 of the id as text: one more character. Nulls stay."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0
    return {count_col: F.when(hit, F.col(count_col) + 1).otherwise(F.col(count_col))}


def manifest_rows(docs: DataFrame, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, with the tampered claims."""
    made = prove(build(docs, changed=tampered(), step=step))
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _oracle() -> str:
    cell = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || ({c}::VARCHAR), '-')"
    hashed = lambda n_chars: f"sha256({' || '.join(cell(n_chars if c == 'n_chars' else c) for c in FIELDS)})"
    bit = "xor(c >> 1, 3988292384 * (c & 1))"  # the polynomial of crc32
    eight = "list_reduce(range(8), lambda c, k: " + bit + ", xor(c, b))"
    return f"""
WITH RECURSIVE d AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT), lambda c, b: {eight}, 4294967295::BIGINT), 4294967295) AS crc FROM documents),
l AS (SELECT doc_id, lang, {hashed("n_chars")} AS leaf, {hashed("(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS claim FROM d),
t AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, count(*) AS n FROM l GROUP BY lang),
p AS (SELECT doc_id, leaf, claim, t.tree, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id, leaf) - 1 AS i, n FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang),
nodes AS (SELECT tree, 0 AS level, i, leaf AS h, n FROM p UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n),
sub AS (SELECT tree, level AS height, h AS subroot, (SELECT count(*) FROM t) AS trees FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, tree AS i, subroot AS h, trees AS n FROM sub UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
way AS (SELECT doc_id, tree, i, 0 AS level, FALSE AS top, leaf, claim, n, '' AS proof FROM p UNION ALL
  SELECT w.doc_id, w.tree, CASE WHEN w.n > 1 THEN w.i // 2 ELSE w.tree END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, w.top OR w.n = 1, w.leaf,
    CASE WHEN w.n = 1 THEN w.claim WHEN b.h IS NULL THEN sha256(w.claim) WHEN w.i % 2 = 1 THEN sha256(b.h || w.claim) ELSE sha256(w.claim || b.h) END,
    CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE (SELECT count(*) FROM t) END, w.proof || coalesce(b.h, '')
  FROM way w LEFT JOIN (SELECT FALSE AS top, tree, level, i, h FROM nodes UNION ALL SELECT TRUE, NULL, level, i, h FROM tops) b
    ON w.n > 1 AND w.top = b.top AND (w.top OR w.tree = b.tree) AND w.level = b.level AND b.i = xor(w.i, 1)
  WHERE w.n > 1 OR NOT w.top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = root AS verified
FROM way JOIN sub USING (tree), (SELECT h AS root FROM tops WHERE n = 1) WHERE top AND n = 1"""


ORACLE = _oracle()
