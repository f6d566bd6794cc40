"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cellweave.llm.store import stored

EDGES = 1 << 18  # edges for a task, about
TASKS = 4  # tasks at least


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, written, with their number and the sum of their hashes, which the same job counts."""
    seen = Observation(f"edges-{uuid.uuid4().hex}")
    now = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return now, (seen.get["n"], seen.get["h"])


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """Hang the neighbours of each node on its smallest one: the smaller ones and itself (small), or the larger ones."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # u > v in edges; the smallest node is aggregated before the shuffle
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # h makes Spark deal out both sides for the join alone, so that a hub's edges can be split over tasks (skew join)
    joined = both.withColumn("h", F.xxhash64("u")).join(least.withColumn("h", F.xxhash64("u")).hint("merge"), ["h", "u"])
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct().coalesce(tasks)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of all ids that have an edge; component_id is the smallest id reachable.

    Every round is written to the shared folder; rounds stop when the edge set no longer changes. The number of tasks
    follows the number of edges, so that a small graph does not pay for many empty ones.
    Self-loops and null ends are ignored; no edges give no rows.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, state = _written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while state[0]:
        tasks = max(TASKS, -(-state[0] // EDGES))
        before, (now, state) = state, _written(_star(_star(now, False, tasks), True, tasks))
        if before == state:
            break
    # each node but the smallest of its component is the larger end of one edge now
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct().coalesce(TASKS))
