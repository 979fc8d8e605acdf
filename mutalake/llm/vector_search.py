"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is put in one of its leaves. A query walks the
tree best bin first: a priority queue of nodes by what their centre and spread promise of the inner product, widening
the number of leaves visited until a calibration set, compared with brute force over all rows, reaches
the wanted recall. Equal vectors are one class with its smallest ids, which is exact for the k nearest.
Leaves are split in blocks of bounded size, so a crowded leaf is searched by several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalake.llm.common import checkpointed, partitions_of

K = 20
#: Vectors the tree is fitted on, and branches of a node.
SAMPLE, BRANCHES = 16_384, 8
#: Vectors of a leaf, as far as the sample can tell leaves apart; least and most leaves.
LEAF, LEAVES, MOST_LEAVES = 1024, 128, 1024
#: Queries that calibrate the visits, and the recall they must reach.
CALIBRATION, RECALL = 192, 0.97
#: Vectors, and queries, of a block.
BLOCK = 8192
#: Queries whose best a task holds before it passes them on.
HELD = 50_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Tree:
    """centres[node], children[node] (empty for leaves), leaf[node] (number or -1); node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaves: int = LEAVES, branches: int = BRANCHES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        centres = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        open_nodes = [(-len(sample), 0, sample)]
        n = 1
        while open_nodes and n < leaves:
            size, node, rows = heapq.heappop(open_nodes)
            k = min(branches, leaves - n + 1, len(rows) // 4)
            if k < 2:
                continue
            own = _kmeans(rows, k, rng)
            near = np.argmin((own**2).sum(1) - 2 * rows @ own.T, axis=1)
            for j in range(k):
                self.children[node].append(len(centres))
                heapq.heappush(open_nodes, (-int((near == j).sum()), len(centres), rows[near == j]))
                centres.append(own[j])
                self.children.append([])
            n += k - 1
        self.centres = np.array(centres)
        tips = [i for i, c in enumerate(self.children) if not c]
        self.leaf = np.full(len(centres), -1)
        self.leaf[tips] = np.arange(len(tips))
        self.leaves = len(tips)
        # What a vector of a node gains over its centre: two standard deviations of its sample along any direction.
        self.spread = np.zeros(len(centres))
        for node, rows in self._members(sample):
            if len(rows):
                self.spread[node] = 2 * np.sqrt(((sample[rows] - self.centres[node]) ** 2).sum(1).mean() / sample.shape[1])

    def _members(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each node with the vectors that fall below it."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            yield node, rows
            below = self.children[node]
            if below and len(rows):
                c = self.centres[below]
                near = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)
                todo += [(below[j], rows[near == j]) for j in range(len(below))]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the nearest centre."""
        at = np.zeros(len(x), dtype=np.int64)
        for node, rows in self._members(x):
            if not self.children[node]:
                at[rows] = self.leaf[node]
        return at

    def visits(self, query: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: so many, and more until they hold the least number of ids."""
        gain = self.centres @ query + np.linalg.norm(query) * self.spread
        queue, out = [(-gain[0], 0)], []
        ids = 0
        while queue and (len(out) < most or (held is not None and ids < least)):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                ids += held.get(out[-1], 0) if held else 0
            for below in self.children[node]:
                heapq.heappush(queue, (-gain[below], below))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _nearest(queries: np.ndarray, own_ids: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[int, list[float], list[int]]]:
    """(query number, scores, ids) of the k best of these vectors, each standing for its ids, best first."""
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ vectors.T
        m = min(len(vectors), k + 13)
        near = np.argpartition(-rough, m - 1, axis=1)[:, :m] if m < len(vectors) else np.broadcast_to(np.arange(len(vectors)), rough.shape)
        for q in range(len(rough)):
            exact = (vectors[near[q]] * queries[at + q]).sum(1)  # the same for equal vectors, in whatever block
            own = own_ids[at + q]
            best = sorted((-s, i) for s, c in zip(exact.tolist(), near[q].tolist(), strict=True) for i in ids[c] if i != own)[:k]
            yield at + q, [-s for s, _ in best], [i for _, i in best]


def _search(k: int):
    """Rows of a task key: vectors (ids not null), then queries, of which a block is held. A task keeps its best k of some queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        key, vectors, ids, queries, own = None, [], [], [], []

        def search() -> None:
            if vectors and queries:
                for q, scores, found in _nearest(np.array(queries), np.array(own), np.array(vectors), ids, k):
                    held = best.get(own[q], [])
                    best[own[q]] = sorted([*held, *((-s, i) for s, i in zip(scores, found, strict=True))])[:k]
            queries.clear(), own.clear()

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if len(best) <= least:
                return
            names = [*best]
            for at in range(0, len(names), 5000):
                part = names[at : at + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([[-s for s, _ in best[q]] for q in part], pa.list_(pa.float64())), pa.array([[i for _, i in best[q]] for q in part], pa.list_(pa.int64()))], names=["query_id", "scores", "ids"])
            best.clear()

        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for i, (task, query, members) in enumerate(zip(batch.column("task").to_pylist(), batch.column("query_id").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                if task != key or len(queries) >= BLOCK:
                    search()
                    yield from out(HELD)
                if task != key:
                    key = task
                    vectors.clear(), ids.clear()
                if query is None:
                    vectors.append(x[i])
                    ids.append(members)
                else:
                    queries.append(x[i])
                    own.append(query)
        search()
        yield from out(0)

    return run


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("embedding")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding")).where("vec_id is not null").where(usable)
    # -0.0 and 0.0 are one value, so that equal vectors are one class.
    return rows.select("vec_id", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("double")).alias("embedding"))


def nearest_vectors(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found to each query, by inner product in double precision.

    is_query: a condition on the column vec_id. Null, empty and zero vectors and those with null or
    non-finite components take no part, nor do vectors of another than the most frequent length (the
    shorter of equals) or null ids; ids must be unique. Fewer than k candidates are all returned; ties
    go to the smaller id. An empty table or no query gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    n = partitions_of(spark)
    sound = _sound(df, key, vector)
    lengths = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    sound = sound.where(F.size("embedding") == lengths["n"])
    # Of equal vectors the k + 1 smallest ids are enough for any query, which may be one of them.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    classes = sound.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sample = np.array([r[0] for r in sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()])
    rows = lengths["count"]  # whole rows of vectors of this length
    tree = Tree(sample, min(max(LEAVES, rows // LEAF), MOST_LEAVES))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column("embedding"), batch.column("ids")], names=["leaf", "embedding", "ids"])

    index = checkpointed(classes.mapInArrow(assign, "leaf long, embedding array<double>, ids array<long>"))
    counts = index.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()  # LEAVES rows
    sizes, held = {r.leaf: r["rows"] for r in counts}, {r.leaf: r["ids"] for r in counts}
    queries = sound.where(is_query)
    probes = queries.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not probes:
        return empty
    visits = _calibrate(index, tree, probes, k, recall, n)
    blocks = {leaf: -(-size // BLOCK) for leaf, size in sizes.items()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            who, leaf, block = [], [], []
            for i in range(len(x)):
                for v in shared.value.visits(x[i], visits, held, k + 1):
                    for b in range(blocks.get(v, 0)):
                        who.append(i)
                        leaf.append(v)
                        block.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(block, pa.int64()), batch.column("vec_id").take(pa.array(who, pa.int64())), batch.column("embedding").take(pa.array(who, pa.int64()))], names=["leaf", "block", "query_id", "embedding"])

    per_leaf = F.create_map(*(F.lit(x) for item in blocks.items() for x in item))
    stored = index.select(F.col("leaf"), F.pmod(F.xxhash64("embedding"), F.element_at(per_leaf, F.col("leaf"))).cast("long").alias("block"), F.lit(None).cast("long").alias("query_id"), "embedding", "ids")
    asked = queries.mapInArrow(spread, "leaf long, block long, query_id long, embedding array<double>").select("leaf", "block", "query_id", "embedding", F.lit(None).cast("array<long>").alias("ids"))
    found = stored.union(asked).withColumn("task", F.xxhash64("leaf", "block")).repartition(n, "task").sortWithinPartitions("task", F.col("query_id").asc_nulls_first()).select("task", "query_id", "embedding", "ids").mapInArrow(_search(k), "query_id long, scores array<double>, ids array<long>")
    pairs = F.flatten(F.collect_list(F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))))  # k rows from each task at most
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(pairs), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _calibrate(index: DataFrame, tree: Tree, probes: list, k: int, recall: float, n: int) -> int:
    """The fewest leaf visits with which the probes find the wanted share of their k nearest over all rows."""
    x = np.array([p["embedding"] for p in probes])
    own = np.array([p["vec_id"] for p in probes])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in probes]
        for batch in batches:
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
            ids = batch.column("ids").to_pylist()
            of = {i: int(v) for v, members in zip(leaf, ids, strict=True) for i in members}
            for q, scores, found in _nearest(x, own, _matrix(batch.column("embedding")), ids, k):
                best[q] = sorted([*best[q], *((-s, i, of[i]) for s, i in zip(scores, found, strict=True))])[:k]
        for q, rows in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([[s for s, _, _ in rows]], pa.list_(pa.float64())), pa.array([[i for _, i, _ in rows]], pa.list_(pa.int64())), pa.array([[v for _, _, v in rows]], pa.list_(pa.int64()))], names=["q", "s", "i", "leaf"])

    rows = index.mapInArrow(brute, "q long, s array<double>, i array<long>, leaf array<long>")
    zipped = F.flatten(F.collect_list(F.arrays_zip("s", "i", "leaf")))
    truth = rows.groupBy("q").agg(F.transform(F.slice(F.array_sort(zipped), 1, k), lambda t: t["leaf"]).alias("leaves")).collect()  # CALIBRATION rows of k numbers
    reached = np.zeros(tree.leaves + 1)
    total = 0
    for r in truth:
        place = {leaf: j + 1 for j, leaf in enumerate(tree.visits(x[r.q], tree.leaves))}
        for leaf in r.leaves:
            reached[place[leaf]] += 1
            total += 1
    return int(np.searchsorted(np.cumsum(reached), recall * total)) if total else tree.leaves
