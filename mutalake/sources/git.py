"""What a git work tree says: the commit, and the files that changed. Both run git on the driver."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GitError(RuntimeError):
    """git failed."""


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {' '.join(args)} failed")
    return done.stdout


def head_commit(root: str) -> str | None:
    """The hash of HEAD; none outside a repository or before the first commit."""
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except (GitError, FileNotFoundError):
        return None


def changed_files(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(file): paths below root, relative to it, that differ from where HEAD left base, or in the work tree, or aren't tracked.

    Files that are gone are left out; each path once. GitError where git fails.
    """
    top = os.path.realpath(_git(root, "rev-parse", "--show-toplevel").strip())
    here = os.path.realpath(root)
    sets = [_git(top, "diff", "--name-only", "-z", f"{base}...HEAD"), _git(top, "diff", "--name-only", "-z", "HEAD"), _git(top, "ls-files", "--others", "--exclude-standard", "-z")]
    parts = [spark.createDataFrame([(x,) for x in one.split("\0") if x], "path string") for one in sets]
    found = parts[0].union(parts[1]).union(parts[2]).distinct()
    real = [(os.path.relpath(full, here),) for r in found.collect() if os.path.exists(full := os.path.realpath(os.path.join(top, r.path))) and full.startswith(here + os.sep)]  # the paths that the driver's git named
    return spark.createDataFrame(sorted(set(real)), "file string")


def only_changed(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose file changed; paths are compared without a leading ./ and with forward slashes."""
    key = F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^\./", "")
    return rows.withColumn("key_", key).join(changed.select(key.alias("key_")).distinct(), "key_", "left_semi").drop("key_")
