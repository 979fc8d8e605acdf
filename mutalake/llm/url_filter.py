"""URL verdicts from a trie over reversed host labels and path segments.

A rule is (verdict, host, path prefix). It fits its host and all subdomains if the path starts with
its path. The longest match decides: first the rule with more host labels, then the longer path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules whose trie is broadcast; beyond, rules are joined by host and path prefix length.
BROADCAST_RULES = 1_000_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_RULES_END = ""


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested tables by host label from the right; under the key "" the path trie, by segment; there, under None, the prefixes that end in a segment."""
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_RULES_END, {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        node.setdefault(None, {})[last] = (f"{host}{path}", verdict)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match, or None."""
    if not host:
        return None
    found, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label) if label else None
        if node is None:
            break
        if _RULES_END in node:
            found = _path_match(node[_RULES_END], path) or found
    return found


def _path_match(node: dict, path: str) -> tuple[str, str] | None:
    found = None
    for segment in path.split("/"):
        ends = node.get(None)
        if ends:
            best = max((x for x in ends if segment.startswith(x)), key=len, default=None)
            found = ends[best] if best is not None else found
        node = node.get(segment)
        if node is None:
            break
    return found


def url_parts(url: str = "url") -> tuple:
    """(host, path) columns: the host follows the first ://, with A-Z lower-cased; both are empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_join(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same verdicts through an equi join on (host suffix, path prefix), for rule lists too long to broadcast."""
    spark = parts.sparkSession
    longest = max(len(path) for _, _, path in rules)
    table = spark.createDataFrame([(host, path, len(host.split(".")), len(path), f"{host}{path}", verdict) for verdict, host, path in rules], "rule_host string, rule_path string, labels int, path_chars int, rule string, verdict string").dropDuplicates(["rule_host", "rule_path"])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(longest))), lambda i: F.substring(F.col("path"), F.lit(1), i))
    urls = parts.where("host <> ''").select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).select("host", "path", "rule_host", F.explode(prefixes).alias("rule_path"))
    best = tried.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("labels", "path_chars")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; without a fitting rule rule is null and the verdict allow.

    Null urls and urls without :// have empty host and path and fit no rule. Of rules with the same
    host and path the last counts. Repeated rows are judged each; an empty table gives no rows;
    other columns are neither read nor returned.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts("url")
    parts = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) > BROADCAST_RULES:
        return _by_join(parts, rules)
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [match(shared.value, h, p) or (None, "allow") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
