"""Joins of ranges and points within files, cut into buckets so that a long file is the work of many tasks.

A range is a row in each bucket that it meets; ranges and points meet on (file, bucket). Of the ranges
that cover a whole bucket only those can matter there that hold no other such range, so deep nesting
doesn't pile up. Within a bucket numpy looks at all its points together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.functions.session import dealt

#: Lines and bytes of a bucket.
LINES, BYTES = 1024, 4096
#: Point and range pairs that are looked at together.
CELLS = 4_000_000


def covered_lines(spans: DataFrame, lines: DataFrame, width: int = LINES, tasks: int | None = None) -> DataFrame:
    """(file, start_line, end_line, hit, executable) of distinct spans that hold lines(file, line, hits).

    A span's buckets in full take the bucket's totals, those it cuts look at their lines; a bucket has
    one row of at most so many lines as it is wide, whatever the number of spans. tasks: how many join and
    group them, null for the session's number.
    """
    bucket = F.floor(F.col("line") / width)
    each = dealt(lines, tasks, "file", "line").groupBy("file", "line").agg(F.count_if(F.col("hits") > 0).alias("hit"), F.count("*").alias("n"))
    held = dealt(each.withColumn("bucket", bucket), tasks, "file", "bucket").groupBy("file", "bucket").agg(F.collect_list(F.struct("line", "hit", "n")).alias("own"), F.sum("hit").alias("hit"), F.sum("n").alias("n"))  # one entry a line of a bucket
    cut = spans.where("start_line <= end_line").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    inside = (F.col("start_line") <= F.col("bucket") * width) & (F.col("end_line") >= F.col("bucket") * width + width - 1)
    part = F.filter("own", lambda x: x["line"].between(F.col("start_line"), F.col("end_line")))
    total = lambda name: F.when(inside, F.col(name)).otherwise(F.aggregate(F.transform(part, lambda x: x[name]), F.lit(0).cast("long"), lambda a, x: a + x))
    found = dealt(cut, tasks, "file", "bucket").join(held, ["file", "bucket"]).select("file", "start_line", "end_line", total("hit").alias("hit"), total("n").alias("n"))
    return dealt(found, tasks, "file", "start_line", "end_line").groupBy("file", "start_line", "end_line").agg(F.sum("hit").alias("hit"), F.sum("n").alias("executable")).where("executable > 0")


def _matters(wide: list[tuple[int, int]], s: int, e: int, named: bool) -> bool:
    """Whether a range that covers its bucket can matter beside the shorter ones that do; the shortest alone if named."""
    return not wide if named else not any(s <= a and b <= e and (a, b) != (s, e) for a, b in wide)


def _groups(batches: Iterator[pa.RecordBatch], width: int, named: bool) -> Iterator[tuple[str, list[tuple], np.ndarray, np.ndarray]]:
    """(file, ranges, points, their numbers) of each bucket, from rows sorted by file, bucket, length; points have no length and come last."""
    here, ranges, wide, points, counts = None, [], [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "bucket", "s", "e", "name", "n")]
        for file, bucket, s, e, name, n in zip(*columns, strict=True):
            if (file, bucket) != here:
                if here and ranges and points:
                    yield here[0], ranges, np.array(points), np.array(counts)
                here, ranges, wide, points, counts = (file, bucket), [], [], [], []
            if e is None:
                points.append(s)
                counts.append(n)
            elif s > bucket * width or e < (bucket + 1) * width:
                ranges.append((s, e, name))
            elif _matters(wide, s, e, named):
                ranges.append((s, e, name))
                wide.append((s, e))
    if here and ranges and points:
        yield here[0], ranges, np.array(points), np.array(counts)


def _buckets(ranges: DataFrame, points: DataFrame, width: int, named: bool, run: Callable, schema: str) -> DataFrame:
    """ranges(file, s, e, name) and points(file, at, n) brought together; ranges are half open."""
    first, last = F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)
    cut = ranges.where("s < e").select("file", F.explode(F.sequence(first, last)).alias("bucket"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "name", F.lit(None).cast("long").alias("n"))
    placed = points.select("file", F.floor(F.col("at") / width).alias("bucket"), F.col("at").cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("string").alias("name"), F.col("n").cast("long").alias("n"))
    size = (F.col("e") - F.col("s")).asc_nulls_last()
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = cut.union(placed).repartition(tasks, "file", "bucket").sortWithinPartitions("file", "bucket", size, "s", "name")
    return together.mapInArrow(lambda batches: run(_groups(batches, width, named)), schema)


def points_of_innermost(ranges: DataFrame, points: DataFrame, width: int = BYTES) -> DataFrame:
    """(file, start_byte, end_byte, n): how many points each range(file, start_byte, end_byte) holds that no range strictly within it holds.

    points: (file, at), repeated ones count each; ranges must be distinct. Ranges may cross.
    """

    def run(groups) -> Iterator[pa.RecordBatch]:
        for file, ranges, at, n in groups:
            # From the latest start on, a range is innermost at a point if it ends before all that start later.
            own = np.array(sorted(((s, e) for s, e, _ in ranges), key=lambda r: (-r[0], r[1])), dtype=np.int64)
            total = np.zeros(len(own), dtype=np.int64)
            step = max(1, CELLS // len(own))
            for k in range(0, len(at), step):
                p = at[k : k + step, None]
                ends = np.where((own[:, 0] <= p) & (p < own[:, 1]), own[:, 1], np.iinfo(np.int64).max)
                before = np.minimum.accumulate(ends, axis=1)
                lowest = np.concatenate([np.full((len(p), 1), np.iinfo(np.int64).max), before[:, :-1]], axis=1)
                total += ((ends < lowest) * n[k : k + step, None]).sum(0)
            hit = total > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([file] * int(hit.sum()), pa.string()), pa.array(own[hit, 0]), pa.array(own[hit, 1]), pa.array(total[hit])], names=["file", "start_byte", "end_byte", "n"])

    counted = points.groupBy("file", "at").agg(F.count("*").alias("n"))
    named = ranges.select("file", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"), F.lit(None).cast("string").alias("name"))
    found = _buckets(named, counted, width, False, run, "file string, start_byte long, end_byte long, n long")
    return found.groupBy("file", "start_byte", "end_byte").agg(F.sum("n").alias("n"))


def smallest_around(ranges: DataFrame, points: DataFrame, width: int = BYTES) -> DataFrame:
    """(file, at, name) of the shortest range(file, s, e, name) around each distinct point(file, at); of equal ones the first, then the smallest name."""

    def run(groups) -> Iterator[pa.RecordBatch]:
        for file, ranges, at, _ in groups:
            own = np.array([r[:2] for r in ranges], dtype=np.int64)  # shortest first
            names = [r[2] for r in ranges]
            step = max(1, CELLS // len(own))
            for k in range(0, len(at), step):
                p = at[k : k + step, None]
                around = (own[:, 0] <= p) & (p < own[:, 1])
                hit = around.any(axis=1)
                if hit.any():
                    best = around.argmax(axis=1)[hit]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(best), pa.string()), pa.array(p[hit, 0]), pa.array([names[i] for i in best], pa.string())], names=["file", "at", "name"])

    distinct = points.select("file", "at").distinct().withColumn("n", F.lit(1))
    return _buckets(ranges.select("file", "s", "e", "name"), distinct, width, True, run, "file string, at long, name string")
