"""Source files of a project, and globs over paths."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.sources.ignore import excludes as rules
from mutalake.sources.ignore import glob_body
from mutalake.sources.project import Project, opened

# Folders left out by default.
DEFAULT_EXCLUDES = ["target/**", ".mutalake/**", ".git/**", "node_modules/**", "vendor/**", "__pycache__/**", ".gradle/**"]


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: trimmed, without blanks, comments and leading slashes."""
    return [x.lstrip("/") for raw in text.splitlines() if (x := raw.strip()) and not x.startswith("#")]


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression over whole relative paths and what lies below them; a pattern without a slash fits at any depth."""
    body = pattern.rstrip("/")
    anchor = "" if "/" in body else "(?:.*/)?"
    return f"^{anchor}{glob_body(body)}(?:/.*)?$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits; one expression for all."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def root_excludes(root: str) -> list[str]:
    """The lines of the ignore file in a project's root, which a plan leaves out wherever they fit; none without the file."""
    try:
        lines = ignore_lines(opened(root).read(".gitignore").decode("utf-8", "replace"))
    except FileNotFoundError:
        return []
    return [x for x in lines if not x.startswith("!")]


def read_sources(spark: SparkSession, root: str, excludes: list[str] = (), languages: list[str] = ()) -> DataFrame:
    """(file, text, language, error, bytes) of a project's source files, with paths relative to its root.

    Left out, and never read: excluded paths, hidden names, links, what ignore files name, files of no
    known language or of none of those wanted. A file that isn't UTF-8 or can't be read is a row
    without a text whose error says why. ValueError for a bad glob, FileNotFoundError without a folder.
    """
    patterns = [*DEFAULT_EXCLUDES, *excludes]
    rules(patterns)
    opened(root)
    spark.dataSource.register(Project)
    rows = spark.read.format("project").option("excludes", "\n".join(patterns)).option("languages", ",".join(languages)).load(root if "://" in root else os.path.abspath(root))
    return rows.select("file", "text", "language", "error", "bytes")
