"""Ordered documents: rows of text in order become one file that any reader opens, without one task or the driver's memory holding it.

Range partitions of the rows are written as text files, each sorted; their names follow the order, so
the document is their bytes one after the other. Stores that join files do that themselves; else the
bytes stream through the driver in small blocks. The document appears whole or not at all.
"""

from __future__ import annotations

import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.functions.session import discard

#: Bytes that the driver copies at a time.
BLOCK = 1 << 20


def write_document(lines: DataFrame, path: str, order: list[str | Column] = ("part", "place"), text: str = "text") -> None:
    """The text of all rows, a line each, in order, as one file; an existing file is replaced, null texts are left out.

    An empty table gives an empty file.
    """
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path if "://" in path else os.path.abspath(path))
    folder = f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        lines.where(F.col(text).isNotNull()).repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.col(text).alias("value")).write.text(f"{folder}/parts")
        fs = target.getFileSystem(conf)
        parts = sorted((s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/parts")) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        whole = jvm.org.apache.hadoop.fs.Path(f"{folder}/whole")
        _joined(spark, fs, parts, whole)
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(whole, target):
            raise OSError(f"{path} can't be written")
    finally:
        discard(spark, folder)


def _joined(spark, fs, parts: list, whole) -> None:
    """The parts as one file: by the store itself if it can, else byte by byte."""
    out = fs.create(whole, True)
    try:
        if parts and fs.hasPathCapability(whole, "fs.capability.paths.concat"):
            out.close()
            array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
            for i, p in enumerate(parts):
                array[i] = p
            fs.concat(whole, array)
            return
        for p in parts:
            source = fs.open(p)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BLOCK, False)
            finally:
                source.close()
    finally:
        out.close()


def run_id(now: datetime | None = None, process: int | None = None) -> str:
    """run-YYYYMMDD-HHMMSS-process, in UTC."""
    return f"run-{(now or datetime.now(UTC)).astimezone(UTC):%Y%m%d-%H%M%S}-{os.getpid() if process is None else process}"


def started_at(now: datetime | None = None) -> str:
    return f"{(now or datetime.now(UTC)).astimezone(UTC):%Y-%m-%dT%H:%M:%SZ}"
