"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import checkpointed, partitions_of

#: Edges that a task contracts together.
CONTRACT_EDGES = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (leaf, smallest node) of the components that these edges make; no edge is lost in what they connect."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        for side in (a, b):
            np.minimum.at(fresh, side, low)
            np.minimum.at(fresh, label[side], low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, n = [], [], 0

    def flush() -> pa.RecordBatch:
        x, y = contract(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["u", "v"])

    for batch in batches:
        us.append(batch.column("u").to_numpy(zero_copy_only=False))
        vs.append(batch.column("v").to_numpy(zero_copy_only=False))
        n += len(us[-1])
        if n > CONTRACT_EDGES:
            yield flush()
            us, vs, n = [], [], 0
    if n:
        yield flush()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Every node is a leaf of one centre, or a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf + centre > 1").isEmpty()


def _nodes(edges: DataFrame) -> DataFrame:
    """(x, low, n, centre): each node, its smallest centre (null without one), of how many it is a leaf, whether it is one."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("at"), F.lit(False).alias("centre")).union(edges.select("v", F.lit(None).cast("long"), F.lit(True)))
    return ends.groupBy("x").agg(F.min("at").alias("low"), F.count("at").alias("n"), F.max("centre").alias("centre"))


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges among centres alone that connect them as these edges do: by a leaf that they share, or as one is a leaf."""
    shared = edges.join(nodes.where("n > 1").select(F.col("x").alias("u"), "low"), "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return shared.union(nodes.where("centre and n > 0").select("x", "low"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node that links reach.

    Edges are first contracted within each task, then once more where those of one leaf, at most one a task, meet. Most
    components are stars then, so the rounds take only edges among centres of stars that touch, and a leaf gets the root of
    its smallest centre. Each round replaces edges by as many or fewer that keep connectivity; it ends when they form stars.
    Nulls and self-loops are ignored; repeated edges count once; no edges give no rows. Nothing is collected, and
    every round is checkpointed.
    """
    plain = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    met = plain.mapInArrow(_contracted, "u long, v long").repartition(partitions_of(edges.sparkSession), "u")
    stars = checkpointed(met.mapInArrow(_contracted, "u long, v long"))
    nodes = checkpointed(_nodes(stars))
    now = checkpointed(_between(stars, nodes).distinct())
    found = nodes.select(F.col("x").alias("node"), F.coalesce("low", "x").alias("root"))
    if now.isEmpty():
        return found
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = checkpointed(_small_star(_large_star(now)).distinct())
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("u").alias("root"), F.col("v").alias("least"))  # a root's own centre is itself
    return found.join(centres, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
