"""Jaccard join of word-shingle sets by PartEnum signatures.

A set's size falls in a band; bands grow by the inverse of the threshold, so similar sets lie in the
same or in neighbouring bands, and each set signs for the two pairings it can be in. In a pairing,
similar sets differ in at most k elements. The feature domain is cut into parts. Large k: more than
k parts, each signed alone. Small k: groups of three parts, more groups than k / 2, and in each the
three subsets of two parts are signed. By the pigeonhole one signature is shared. A part that holds
nothing can't carry a signature, so a few parts are added; a set with too many empty parts also signs
a prefix of its elements, which two such sets share if they are similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import checkpointed, list_array, mix, shingle_sets, whole
from mutalake.llm.components import connected_components
from mutalake.llm.simjoin import TASKS, candidate_edges, parity_sketch, similar_components

WIDTH, PERCENT = 5, 80
#: Up to this distance, subsets of two of three parts are signed instead of single parts.
SUBSETS_UP_TO = 24
_U = np.uint64


@lru_cache(maxsize=100_000)
def band(size: int, percent: int) -> tuple[int, int, int]:
    """(number, least size, largest size) of the band that holds a size."""
    i, low = 0, 1
    while (high := low * 100 // percent) < size:
        i, low = i + 1, high + 1
    return i, low, high


def _sign(x: np.ndarray, tag: int, k: int, percent: int) -> np.ndarray:
    """The signatures of one sorted set for one pairing of bands, whose similar sets differ in k elements at most."""
    seed = int(mix(np.array([tag * 2 + 1], dtype=_U))[0])
    subsets = 0 < k <= SUBSETS_UP_TO
    need = k // 2 + 1 if subsets else k + 1
    groups = need + 1 + need // 24 if k else 1
    parts = groups * (3 if subsets else 1)
    part = ((x >> _U(32)) * _U(parts)) >> _U(32)
    heads = np.flatnonzero(np.diff(part, prepend=_U(parts)))
    sums = np.add.reduceat(mix(x ^ _U(seed)), heads)
    if subsets:
        cell = np.zeros(parts, dtype=_U)
        cell[part[heads].astype(np.int64)] = sums
        cell = cell.reshape(groups, 3)
        full = np.zeros(parts, dtype=bool)
        full[part[heads].astype(np.int64)] = True
        full = full.reshape(groups, 3)
        good = int((full.sum(1) >= 2).sum())
        left = full.sum(1, keepdims=True) - full > 0
        content = (cell.sum(1, dtype=_U, keepdims=True) - cell)[left]
        place = np.arange(parts, dtype=_U).reshape(groups, 3)[left]
    else:
        good, content, place = len(heads), sums, part[heads]
    signed = mix(content ^ mix(place + _U(seed)))
    if good >= need:
        return signed
    prefix = x[: len(x) - (percent * len(x) + 99) // 100 + 1]
    return np.concatenate([signed, mix(prefix ^ _U(seed ^ 0x5DEECE66D))])


def signatures(x: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All PartEnum signatures of a sorted distinct set of 64-bit hashes; none for the empty set."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    i, low, high = band(len(x), percent)
    k = lambda smaller: smaller * (100 - percent) // percent  # noqa: E731  the smaller set's size bounds the difference
    made = [_sign(x, i + 1, k(high), percent)]
    if i:
        made.append(_sign(x, i, k(low - 1), percent))
    return np.concatenate(made).view(np.int64)


def _key(x: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that stand for a set."""
    return np.array([mix(x).sum(dtype=_U), mix(x ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U) + _U(len(x))])


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = (batch.column(x) for x in ("doc_id", "h", "text"))
            sizes, keys, sketches = [], [], []
            for _, x in shingle_sets(texts, width):
                sizes.append(len(x))
                keys.append(_key(x))
                sketches.append(parity_sketch(x))
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([int(x.view(np.int64)[0]) for x in keys], pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "h", "n_shingles", "key", "node", "sketch"])

    return run


def _signed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                nodes, sigs = [], []
                for _, x in shingle_sets(texts.slice(at, 1000), width):
                    nodes.append(int(_key(x).view(np.int64)[0]))
                    sigs.append(signatures(x, percent))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), list_array(sigs, pa.int64())], names=["node", "sigs"])

    return run


def _items(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tasks = batch.column("node"), batch.column("text"), batch.column("tasks")
            for at in range(0, len(ids), 1000):
                sets = [x.view(np.int64) for _, x in shingle_sets(texts.slice(at, 1000), width)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), tasks.slice(at, 1000), list_array(sets, pa.int64())], names=["node", "tasks", "items"])

    return run


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Null and empty texts have no shingles and stand alone. Equal sets are one class, whose smallest
    id stands for it, so copies cost one row each. A row with a null id has its set's size, but no
    links and a null component. Rows that share an id are documents of their own: each has the
    component of its own text. Ties can't arise: component_id is the smallest id. An empty table
    gives no rows; further columns are neither read nor returned.
    """
    source = whole(docs, key, text).withColumn("h", F.xxhash64("text"))
    seen = checkpointed(source.mapInArrow(_features(width), "doc_id long, h long, n_shingles long, key binary, node long, sketch binary"))
    named = seen.where("doc_id is not null")
    repeated_ids = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    full = named.where("n_shingles > 0")
    # Candidates are sought among the first halves of the keys; two classes with one half only share candidates.
    classes = full.groupBy("key", "node").agg(F.min(F.struct("doc_id", "h", "n_shingles", "sketch")).alias("r")).select("key", "node", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("h"), F.col("r.n_shingles").alias("n"), F.col("r.sketch").alias("x"))
    # Where one id stands for two classes they are told apart by numbers, which a checkpoint settles.
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()) if repeated_ids else classes.withColumn("class", F.col("rep")))

    def items_of(wanted: DataFrame) -> DataFrame:
        named = wanted.withColumnRenamed("node", "class")
        if repeated_ids:  # a text may come several times under one id
            found = source.join(named.join(classes.select("class", F.col("rep").alias("doc_id"), "h"), "class"), ["doc_id", "h"]).dropDuplicates(["class"])
        else:
            found = source.join(named.withColumnRenamed("class", "doc_id"), "doc_id").withColumnRenamed("doc_id", "class")
        return found.select(F.col("class").alias("node"), "text", "tasks").mapInArrow(_items(width), f"node long, tasks {TASKS}, items array<long>")

    edges = candidate_edges(source.where("doc_id is not null").select("text").mapInArrow(_signed(width, percent), "node long, sigs array<long>"), classes.select("node", "n", "x"), percent)
    groups = connected_components(edges).join(classes.select("node", "class", F.col("n").alias("weight")), "node").select(F.col("class").alias("node"), "root", "weight")
    linked = similar_components(groups, items_of, percent).withColumnRenamed("node", "class")
    if repeated_ids:  # a component is called by its smallest id
        members = checkpointed(linked.join(classes.select("class", "rep"), "class"))
        linked = members.join(members.groupBy("root").agg(F.min("rep").alias("least")), "root").select("class", F.col("least").alias("root"))
    roots = classes.join(linked, "class", "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    done = seen.select("doc_id", "n_shingles", "key").join(roots, "key", "left")
    return done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
