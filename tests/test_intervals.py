"""Range and path joins against all pairs, over files that are cut into buckets and paths that share their names."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mutalake.operators import intervals, scoring

RANGE = "file string, start_byte int, end_byte int"


def ranges_of(rng, n, most):
    out = set()
    for _ in range(n):
        a = rng.randrange(most)
        out.add((rng.choice("xxy"), a, min(most, a + rng.choice([1, 3, 40, 400, most]))))
    return sorted(out)


@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_ranges_and_points(spark, width):
    rng = random.Random(width)
    ranges = ranges_of(rng, 120, 1000) + [("x", 10, 10), ("z", 0, 5)]
    points = [(rng.choice("xxyw"), rng.randrange(-5, 1010)) for _ in range(400)]
    at = spark.createDataFrame(points, "file string, at int").repartition(3)
    got = {(r.file, r.start_byte, r.end_byte): r.n for r in intervals.points_of_innermost(spark.createDataFrame(ranges, RANGE).repartition(2), at, width).collect()}
    want = {}
    for f, s, e in ranges:
        n = sum(g == f and s <= p < e and not any(h == f and s <= a and b <= e and (a, b) != (s, e) and a <= p < b for h, a, b in ranges) for g, p in points)
        if n:
            want[f, s, e] = n
    assert got == want
    named = spark.createDataFrame([(f, s, e, f"n{i % 7}") for i, (f, s, e) in enumerate(ranges)], "file string, s int, e int, name string")
    near = {(r.file, r.at): r.name for r in intervals.smallest_around(named, at, width).collect()}
    best = {}
    for f, p in points:
        around = [(e - s, s, f"n{i % 7}") for i, (g, s, e) in enumerate(ranges) if g == f and s <= p < e]
        if around:
            best[f, p] = min(around)[2]
    assert near == best


@pytest.mark.parametrize("width", [5, 1024])
def test_lines_in_spans(spark, width):
    rng = random.Random(3)
    spans = [(f, s, e - 1) for f, s, e in ranges_of(rng, 60, 300)] + [("x", 9, 3)]
    lines = [(rng.choice("xyw"), rng.randrange(310), rng.randrange(3)) for _ in range(500)]
    got = {tuple(r)[:3]: (r.hit, r.executable) for r in intervals.covered_lines(spark.createDataFrame(spans, "file string, start_line int, end_line int"), spark.createDataFrame(lines, "file string, line int, hits int"), width).collect()}
    inside = {(f, s, e): [h for g, x, h in lines if g == f and s <= x <= e] for f, s, e in spans}
    assert got == {k: (sum(h > 0 for h in v), len(v)) for k, v in inside.items() if v}


def test_a_long_file_is_many_tasks(spark):
    """Two million lines and points of one file, spans over all of it: no task holds more than a share."""
    n = 2_000_000
    lines = spark.range(n).select(F.lit("big").alias("file"), F.col("id").cast("int").alias("line"), (F.col("id") % 2).alias("hits"))
    spans = spark.range(2000).select(F.lit("big").alias("file"), (F.col("id") * 1000).cast("int").alias("start_line"), (F.col("id") * 1000 + 999).cast("int").alias("end_line")).union(spark.createDataFrame([("big", 0, n - 1), ("big", 1, n - 2)], "file string, start_line int, end_line int"))
    found = scoring.span_coverage(spans, lines)
    assert {(r.start_line, r.coverage) for r in found.where("start_line < 2").collect()} == {(0, 50.0), (1, 50.0)} and found.where("coverage = 50").count() == 2002
    ranges = spans.where("start_line <> 1").select("file", F.col("start_line").alias("start_byte"), (F.col("end_line") + 1).alias("end_byte"))
    own = intervals.points_of_innermost(ranges, lines.select("file", F.col("line").alias("at")))
    assert own.agg(F.sum("n")).first()[0] == n

    def held(groups):
        from pyspark import TaskContext

        total = sum(int(counts.sum()) for *_, counts in groups)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total])], names=["task", "n"])

    named = ranges.select("file", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"), F.lit("").alias("name"))
    tasks = intervals._buckets(named, lines.select("file", F.col("line").alias("at"), F.lit(1).alias("n")), intervals.BYTES, False, held, "task long, n long").collect()
    assert sum(r.n for r in tasks) == n and len(tasks) == 4 and max(r.n for r in tasks) < n / 2


def paths_by_pairs(sources, covered):
    parts = lambda p: [x for x in p.replace("\\", "/").split("/") if x not in ("", ".")]
    out = {}
    for f in sources:
        best = None
        for c in covered:
            n = min(len(parts(f)), len(parts(c)))
            if n and parts(f)[-n:] == parts(c)[-n:]:
                best = min(best or (1, 0, ""), (f != c, -n, c)) if best else (f != c, -n, c)
        if best:
            out[f] = best[2]
    return out


def test_paths_match_as_in_pairs(spark):
    rng = random.Random(9)
    path = lambda: rng.choice(["", "/", "./", "\\"]) + "/".join(rng.choice(["a", "b", "src", "mod.rs"]) for _ in range(rng.randint(1, 4)))
    sources, covered = [path() for _ in range(80)] + ["", "/", "./"], [path() for _ in range(80)] + ["."]
    got = {r.file: r.coverage_file for r in scoring.match_files(spark.createDataFrame([(x,) for x in sources], "file string"), spark.createDataFrame([(x,) for x in covered], "file string")).collect()}
    assert got == paths_by_pairs(set(sources), set(covered))


def test_paths_of_one_name_are_linear(spark):
    """Forty thousand files called mod.rs on each side, under the same folder: no pairs of them meet."""
    side = lambda root: spark.range(40_000).select(F.concat(F.lit(root), "id", F.lit("/src/mod.rs")).alias("file"))
    began = time.monotonic()
    found = scoring.match_files(side("a/"), side("/ci/a/").union(side("b/")))
    assert found.where(F.concat(F.lit("/ci/"), "file") == F.col("coverage_file")).count() == 40_000 and time.monotonic() - began < 90
