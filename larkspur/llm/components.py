"""Connected components of an edge table: in one task where edges are few, by alternating large-star and small-star steps else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_partitioning, removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).select(forget_partitioning(F.col("a")).alias("of"), "low")
    out = both.join(low, forget_partitioning(both["a"]) == low["of"]).where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b")
    return out.where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them.  Edges have a < b."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    of = low.select(forget_partitioning(F.col("b")).alias("of"), "low")
    moved = edges.join(of, forget_partitioning(edges["b"]) == of["of"]).where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("low").alias("a"), "b"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of edges (a, b), for nodes other than that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        before = up.copy()
        np.minimum.at(up, np.maximum(before[u], before[v]), np.minimum(before[u], before[v]))
        while (up != up[up]).any():
            up = up[up]
        if (up == before).all():
            break
    other = up != np.arange(len(nodes))
    return nodes[other], nodes[up[other]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            node, component = stars(*(np.concatenate([h[i] for h in held]) for i in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long")


#: Edges that one task takes at once: 16 MB of them, and some ten times that while it works.
ONE_TASK = 1 << 20


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), component the smallest node
    reachable; a component's smallest node itself has no row.

    Up to `one_task` edges, which are counted first, are settled in one task.  Beyond, each
    round is a few aggregations of the edge table; a node with very many edges is summed
    map-side, and joined on a key that adaptive execution can split.  The number of
    rounds grows with the logarithm of the largest component, and each round's table goes to
    the shared folder.  Self links and repeated edges do no harm.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if now.count() <= one_task:
        out = written(_in_one_task(now))
        removed(now)
        return out
    state = None
    while True:
        before, now = now, written(_small_star(_large_star(now)).distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        removed(before)
        if mark == state:
            break
        state = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
