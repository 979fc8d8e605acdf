"""Coverage reports as rows (file, line, hits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutalake.operators.scoring import expand_blocks, merge_hits

FORMATS = ("lcov", "cobertura", "jacoco", "go")


def detect_format(path: str, head: str) -> str:
    """By name or by the first 4096 characters."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    extension = name.rpartition(".")[2].lower() if "." in name.lstrip(".") else ""
    head = head[:4096]
    if extension == "info":
        return "lcov"
    if name in ("coverage.out", "cover.out") or head.lstrip().startswith("mode:"):
        return "go"
    if extension == "xml" or "<" in head:
        if "<report" in head:
            return "jacoco"
        if "<coverage" in head:
            return "cobertura"
    raise ValueError(f"unknown coverage format: {path}")


def parse_spec(spec: str) -> tuple[str | None, str]:
    """(format or None, path) of format:path; other prefixes, as drive letters, belong to the path."""
    head, sep, path = spec.partition(":")
    known = {"lcov": "lcov", "cobertura": "cobertura", "jacoco": "jacoco", "go-cover": "go", "gocover": "go", "go": "go"}
    return (known[head.lower()], path) if sep and head.lower() in known else (None, spec)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, line) of text files; line order needs whole files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path)
    opens = F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 30)).when(F.col("line") == "end_of_record", F.lit(""))
    order = Window.partitionBy("path").orderBy("seq")
    held = lines.withColumn("file", F.last(opens, ignorenulls=True).over(order)).where("line like 'DA:%' and file <> ''")
    fields = F.split(F.substring("line", 4, 1 << 30), ",")
    parsed = held.select("file", fields[0].cast("long").alias("line"), fields[1].cast("long").alias("hits"))
    return merge_hits(parsed, "sum")


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    schema = "_filename string, lines struct<line: array<struct<_number: string, _hits: string>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    lines = rows.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("x"))
    parsed = lines.select("file", F.expr("try_cast(x._number as long)").alias("line"), F.expr("try_cast(x._hits as long)").alias("hits"))
    return merge_hits(parsed.where("file is not null and line is not null and hits is not null"), "max")


def read_jacoco(spark: SparkSession, path: str) -> DataFrame:
    schema = "_name string, sourcefile array<struct<_name: string, line: array<struct<_nr: string, _ci: string>>>>"
    rows = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path)
    files = rows.select(F.col("_name").alias("package"), F.monotonically_increasing_id().alias("p"), F.posexplode("sourcefile").alias("f", "s"))
    lines = files.select(F.when(F.coalesce("package", F.lit("")) == "", F.col("s._name")).otherwise(F.concat_ws("/", "package", "s._name")).alias("file"), "p", "f", F.posexplode("s.line").alias("k", "x"))
    parsed = lines.select("file", F.expr("try_cast(x._nr as long)").alias("line"), F.when(F.expr("try_cast(x._ci as long)") > 0, 1).otherwise(0).cast("long").alias("hits"), F.struct("p", "f", "k").alias("seq"))
    return merge_hits(parsed.where("line is not null"), "last")


def read_go(spark: SparkSession, path: str) -> DataFrame:
    pattern = r"^(.*):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return expand_blocks(lines.select(part(1).alias("file"), part(2).cast("long").alias("first"), part(3).cast("long").alias("last"), part(4).cast("long").alias("count")))


READERS = {"lcov": read_lcov, "cobertura": read_cobertura, "jacoco": read_jacoco, "go": read_go}


def read_coverage(spark: SparkSession, *specs: str) -> DataFrame:
    """(file, line, hits) of all reports, hits of one line summed over them."""
    parts = []
    for spec in specs:
        kind, path = parse_spec(spec)
        if kind is None:
            head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4096)).first()
            kind = detect_format(path, head[0] if head else "")
        parts.append(READERS[kind](spark, path))
    if not parts:
        return spark.createDataFrame([], "file string, line long, hits long")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return merge_hits(out, "sum")
