"""Coverage in spans, change-risk scores, path matching and scan attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.functions.session import dealt
from mutalake.operators.intervals import covered_lines, points_of_innermost, smallest_around

#: How hits of one line combine, by report format.
MERGES = {"lcov": F.sum, "cobertura": F.max, "go_cover": F.max}


def merge_hits(lines: DataFrame, how: str = "sum", tasks: int | None = None) -> DataFrame:
    """One row a (file, line): hits summed, largest, or the last by seq. tasks: how many group them, null for the session's number."""
    if how == "last":
        hits = F.max_by("hits", "seq")
    else:
        hits = {"sum": F.sum, "max": F.max}[how]("hits")
    return dealt(lines, tasks, "file", "line").groupBy("file", "line").agg(hits.alias("hits"))


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """(file, line, hits) of blocks (file, first, last, count); a block that ends before it starts covers nothing."""
    lines = blocks.where("first <= last").select("file", F.explode(F.sequence("first", "last")).alias("line"), F.col("count").alias("hits"))
    return merge_hits(lines, "max")


def span_coverage(functions: DataFrame, lines: DataFrame, files: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """functions(file, function, start_line, end_line, …) with coverage in percent.

    A covered file's span without executable lines counts 100, a function of a file without
    coverage 0. files: covered files that may have no lines. Spans meet lines by buckets of a file.
    tasks: how many join and group them, null for the session's number; what a task holds grows with its rows.
    """
    covered = lines.select("file", "hits")
    if files is not None:
        covered = covered.union(files.select("file", F.lit(None)))
    known = dealt(covered, tasks, "file").groupBy("file").agg(F.count("hits").alias("has_coverage"))  # counts hits, so as to share covered_lines' shuffles of what lines are made of
    keys = ["file", "start_line", "end_line"]
    counts = covered_lines(dealt(functions.select(*keys), tasks, *keys).distinct(), lines, tasks=tasks)
    joined = dealt(dealt(functions, tasks, "file").join(known, "file", "left"), tasks, *keys).join(counts, keys, "left")
    percent = F.when(F.col("has_coverage").isNull(), F.lit(0.0)).when(F.coalesce("executable", F.lit(0)) == 0, F.lit(100.0)).otherwise(F.col("hit") / F.col("executable") * 100.0)
    return joined.withColumn("coverage", percent).drop("has_coverage", "hit", "executable")


def crap(cyclomatic: Column, coverage: Column) -> Column:
    """c * c * (1 - coverage)**3 + c, with coverage held to 0..100 percent."""
    c = cyclomatic.cast("double")
    u = 1.0 - F.least(F.greatest(coverage, F.lit(0.0)), F.lit(100.0)) / 100.0
    return c * c * (u * u * u) + c


def score_functions(functions: DataFrame, lines: DataFrame | None = None, files: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Functions with coverage and crap; without lines coverage is 0 for all."""
    covered = functions.withColumn("coverage", F.lit(0.0)) if lines is None else span_coverage(functions, lines, files, tasks)
    return covered.withColumn("crap", crap(F.col("cyclomatic"), F.col("coverage")))


def by_risk(scores: DataFrame, tasks: int | None = None) -> DataFrame:
    """Scores from the highest crap on, then by path and function; tasks: how many sort them, null for the session's number."""
    order = [F.desc("crap"), path_parts("file"), F.col("function")]
    return scores.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if tasks else scores.orderBy(*order)


def path_parts(path: str | Column) -> Column:
    """Components of a path, without empty ones and single dots; paths sort by them."""
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))


def match_files(sources: DataFrame, covered: DataFrame) -> DataFrame:
    """(file, coverage_file): the equal path, else the covered path of which one is the other's tail.

    Several tails: the longest common one, then the smallest path. A path is looked up by its whole list
    of components from the last on, among the beginnings of such lists on the other side; each beginning
    has one row there, so files that share a name, or any part of a path, don't meet in pairs.
    """
    turned = lambda path: F.reverse(path_parts(path))
    key = lambda parts: (F.xxhash64(parts).alias("key"), F.xxhash64(F.lit("other"), parts).alias("key2"))
    left = sources.select("file").distinct().withColumn("turned", turned("file")).where(F.size("turned") > 0)
    right = covered.select(F.col("file").alias("coverage_file")).distinct().withColumn("turned", turned("coverage_file")).where(F.size("turned") > 0)
    begun = lambda df, name, most: df.select(name, "turned", F.explode(F.sequence(F.lit(1), most)).alias("n")).select(name, "n", *key(F.slice("turned", F.lit(1), F.col("n"))))
    on = ["n", "key", "key2"]
    whole = right.select("coverage_file", F.size("turned").alias("n"), *key(F.col("turned"))).groupBy(*on).agg(F.min("coverage_file").alias("coverage_file"))
    shorter = begun(left, "file", F.size("turned")).join(whole, on).select("file", "n", "coverage_file")
    beginnings = begun(right.where(F.size("turned") > 1), "coverage_file", F.size("turned") - 1).groupBy(*on).agg(F.min("coverage_file").alias("coverage_file"))
    longer = left.select("file", F.size("turned").alias("n"), *key(F.col("turned"))).join(beginnings, on).select("file", "n", "coverage_file")
    equal = left.join(right.withColumn("file", F.col("coverage_file")).select("file", "coverage_file"), "file").select("file", F.lit(1 << 30).alias("n"), "coverage_file")
    best = F.min(F.struct((-F.col("n")).alias("less"), "coverage_file"))
    return shorter.union(longer).union(equal).groupBy("file").agg(best.alias("b")).select("file", "b.coverage_file")


def match_report(sources: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: how many files of either side found a match."""
    found = match_files(sources, covered)
    a = sources.select("file").distinct().join(found, "file", "left").agg(F.count("coverage_file").alias("matched_sources"), F.count_if(F.col("coverage_file").isNull()).alias("unmatched_sources"))
    hit = found.select(F.col("coverage_file").alias("file")).distinct().withColumn("hit", F.lit(1))
    b = covered.select("file").distinct().join(hit, "file", "left").agg(F.count("hit").alias("matched_coverage"), F.count_if(F.col("hit").isNull()).alias("unmatched_coverage"))
    return a.crossJoin(b)  # two rows of totals


def attribute_branches(functions: DataFrame, branches: DataFrame) -> DataFrame:
    """functions(file, start_byte, end_byte, …) with cyclomatic = 1 + branches inside but not inside a nested function.

    functions: (file, start_byte, end_byte, ...) ; branches: (file, at). A function is nested in
    another if its range lies within and isn't the same.
    """
    own = points_of_innermost(functions.select("file", "start_byte", "end_byte").distinct(), branches.select("file", "at"))
    return functions.join(own, ["file", "start_byte", "end_byte"], "left").withColumn("cyclomatic", 1 + F.coalesce("n", F.lit(0))).drop("n")


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, at, name) of the smallest range(file, s, e, name) around each point(file, at); points outside have no row."""
    return smallest_around(ranges, points)
