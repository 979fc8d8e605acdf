"""Parsed sources kept by content: a text is parsed once for all files, plans and runs that hold it."""

from __future__ import annotations

import hashlib
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.functions.patterns import Pattern
from mutalake.functions.session import settled
from mutalake.operators import discovery

#: Files whose texts are new, up to which their names are broadcast to the sources.
BROADCAST_FILES = 100_000
_SCHEMA = f"key string, {discovery.PARSED}"


def catalog_version(catalog: dict[str, list[Pattern]]) -> str:
    """A name for what a parse depends on beside the text: the patterns, and the code that parses and matches."""
    code = hashlib.sha256(repr(sorted(catalog.items())).encode())
    for package in ("mutalake.syntax", "mutalake.operators"):
        for file in sorted(resources.files(package).iterdir(), key=lambda f: f.name):
            if file.name.endswith(".py"):
                code.update(file.read_bytes())
    return code.hexdigest()[:16]


def parsed_by_content(sources: DataFrame, catalog: dict[str, list[Pattern]], store: str) -> DataFrame:
    """discovery.parse_sources of sources with unique files, from a store in which each distinct text is parsed once.

    store: a folder that all machines share; a version of the catalog or the code has a folder of its own
    there. Only texts that it doesn't hold are parsed; they are added in one commit, so a failed or a
    concurrent call leaves whole rows, at worst one twice, which is read once.
    """
    spark = sources.sparkSession
    at = f"{store.rstrip('/')}/version={catalog_version(catalog)}"
    known = sources.where("text is not null").where(F.col("language").isin(*discovery.languages()))
    keys = settled(known.select("file", "language", F.sha2(F.concat_ws(":", "language", "text"), 256).alias("key")))
    held = _read(spark, at)
    fresh = keys if held is None else keys.join(held.select("key"), "key", "left_anti")
    fresh = settled(fresh.groupBy("key").agg(F.min("file").alias("file")))
    new = fresh.count()
    if new:
        named = F.broadcast(fresh) if new <= BROADCAST_FILES else fresh
        texts = known.join(named, "file").select(F.col("key").alias("file"), "language", "text")
        discovery.parse_sources(texts, catalog).select(F.col("file").alias("key"), "functions", "sites").write.mode("append").parquet(at)
    elif held is None:
        return discovery.parse_sources(sources, catalog)  # nothing to parse
    return keys.join(_read(spark, at).dropDuplicates(["key"]), "key").select("file", "language", "functions", "sites")


def _read(spark, at: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return spark.read.schema(_SCHEMA).parquet(at) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
