"""Vector code compression: product codes from integer k-means over the columns of part blocks.

Vectors become integers and travel as columnar blocks, one row of a block a dimension. A task goes
through its blocks part by part: squared distances to all entries of the part's codebook accumulate
dimension by dimension, the nearest entry is taken, and np.add.at gathers its sums and counts in
int64 tensors. The tensors of all tasks merge through a reduction tree (RDD.treeAggregate), so what
reaches the driver is a codebook's size, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import checkpointed, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components saturate here, so that 64-bit distances and sums are exact (to 2**37 vectors).
MOST = 1 << 26
#: Vectors whose distances are held together, and labels up to which their sums are broadcast.
BLOCK, BROADCAST_LABELS = 2048, 100_000


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """Columns of int32 floor(SCALE x), one row a dimension; zeros fill the last part."""
    n = len(vectors)
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1 if n else 0)
    x = np.clip(np.floor(x * SCALE), -MOST, MOST).astype(np.int32).T
    return np.ascontiguousarray(np.pad(x, ((0, -len(x) % PARTS), (0, 0))))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of a block's parts, both parts x vectors; ties go to the lower entry."""
    parts, _, width = books.shape
    entries = np.empty((parts, block.shape[1]), dtype=np.int64)
    least = np.empty_like(entries)
    for p in range(parts):
        far = np.zeros((books.shape[1], block.shape[1]), dtype=np.int64)
        for j in range(width):
            gap = block[p * width + j].astype(np.int64)[None, :] - books[p, :, j, None]
            far += gap * gap
        entries[p] = far.argmin(axis=0)
        least[p] = np.take_along_axis(far, entries[p][None, :], 0)[0]
    return entries, least


def _gather(books: np.ndarray):
    """The fold of one block into (sums, counts) of each part's entries."""

    def fold(total: tuple[np.ndarray, np.ndarray] | None, row) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total or (np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64))
        block = np.frombuffer(row.block, dtype=np.int32).reshape(books.shape[0] * books.shape[2], row.n)
        entries, _ = nearest(block, books)
        for p, own in enumerate(entries):
            np.add.at(sums[p], own, block[p * books.shape[2] : (p + 1) * books.shape[2]].T)
            np.add.at(counts[p], own, 1)
        return sums, counts

    return fold


def _merge(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray] | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = whole_numbers(batch.column("embedding").slice(at, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["n", "block"])


def fit_codebooks(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x width integers after the rounds, from vectors of one length."""
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # so many rows
    first = whole_numbers(pa.array([r[0] for r in seeds], pa.list_(pa.float64()))).astype(np.int64)
    books = first.reshape(PARTS, -1, len(seeds)).transpose(0, 2, 1).copy()
    blocks = kept.select("embedding").mapInArrow(_blocks, "n long, block binary").rdd
    for _ in range(rounds):
        sums, counts = blocks.treeAggregate(None, _gather(books), _merge)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Null vectors and those with null or non-finite components are dropped, as are vectors of another
    than the most frequent length (the shorter of equals). A length that sixteen doesn't divide is
    filled with zeros. Components beyond 2**18 in size are taken as that. Codebooks begin with the
    smallest ids (null ids last, rows that share an id by their components); fewer than 64 vectors
    make fewer entries. Repeated rows and rows without an id are coded each. label_error sums over
    equal labels, null labels together, and is null beyond 64 bits. An empty table gives no rows;
    other columns are neither read nor returned.
    """
    spark = df.sparkSession
    sound = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    sound = sound.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    length = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kinds = {f.name: f.dataType.simpleString() for f in sound.schema}
    if length is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string")
    kept = sound.where(F.size("embedding") == length.n)
    books = fit_codebooks(kept)
    shared = spark.sparkContext.broadcast(books)  # ENTRIES vectors

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                entries, least = nearest(whole_numbers(part.column("embedding")), shared.value)
                codes = [row.tobytes().hex() for row in np.ascontiguousarray(entries.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(least.sum(0))], names=["vec_id", "label", "code", "error"])

    coded = stored(kept.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    sums = checkpointed(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    few = sums.count() <= BROADCAST_LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
