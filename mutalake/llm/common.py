"""Helpers shared by the text operators: checkpoints, column names, Arrow batches and vectorised hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that the vectorised code looks at together.
SLICE_BYTES = 1 << 18

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's; one is made only on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mutalake-")
        context.setCheckpointDir(folder)
    return folder


def release(df: DataFrame) -> None:
    """Delete the shuffle files of a plan whose result has been written."""
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint(eager=True)
    release(df)
    return done


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through Parquet in the shared folder, for wide tables of which a reader needs few columns."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/mutalake-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(discard, spark, at)
    done = spark.read.schema(df.schema).parquet(at)
    done.stored_at_ = at
    return done


def discard_with(df: DataFrame) -> None:
    """Delete what stored wrote, when nothing will read it any more."""
    discard(df.sparkSession, df.stored_at_)


def discard(spark: SparkSession, at: str) -> None:
    """Delete an intermediate table, if the session still lives."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(large: DataFrame, small: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """Inner join on a key that may be hot in large: its rows are dealt by another column, those of small repeated."""
    left = large.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = small.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "salt_"]).drop("salt_")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that other columns can't clash; null text is empty."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's root and of its inverse modulo 2**64; grown when a longer text comes."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n + n // 2, 2 * SLICE_BYTES)
        for name, root in (("up", _ROOT), ("down", _ROOT_INVERSE)):
            powers = np.full(size, root, dtype=_U)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            _POWERS[name] = powers
    return _POWERS["up"], _POWERS["down"]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of a run of texts, as arrays: byte ranges, documents and 64-bit hashes of the A-Z lower-cased words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~_IS_SPACE[data]
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | fresh[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, dtype=_U)
        np.cumsum((_LOWER[self.data].astype(_U) + _U(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of about SLICE_BYTES: first row, bytes, offsets of the rows in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


_STEPS = [_U(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(64)]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words; the caller drops the windows that cross a text's end."""
    total = hashes[: len(hashes) - width + 1] * _STEPS[0]
    for j in range(1, width):
        total = total + hashes[j : len(hashes) - width + 1 + j] * _STEPS[j]
    return mix(total)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; fewer words than the width make one shingle, none make none."""
    for first, data, offsets in slices(texts):
        words = Words(data, offsets)
        hashes = words.hashes()
        windows = shingle_hashes(hashes, width) if len(hashes) >= width else np.zeros(0, dtype=_U)
        for k in range(len(offsets) - 1):
            a, b = int(words.bounds[k]), int(words.bounds[k + 1])
            if b - a >= width:
                yield first + k, np.unique(windows[a : b - width + 1])
            elif b > a:
                short = hashes[a:b] * np.array(_STEPS[: b - a], dtype=_U)
                yield first + k, mix(np.array([short.sum(dtype=_U) + _U(b - a)], dtype=_U))
            else:
                yield first + k, np.zeros(0, dtype=_U)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A column of lists from numpy parts."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
