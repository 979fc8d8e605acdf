"""Ordering strategies, their explanations, seeded ranks and limits over candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.functions.blake3 import blake3, blake3_many
from mutalake.operators.outcomes import one_entry
from mutalake.operators.rank import with_place
from mutalake.operators.scoring import path_parts

#: The name that is hashed into every ranking key.
RANKING = "ranked-v1"

_INT_MIN = -(2**31)


def _one_decimal(column: str) -> Column:
    return F.expr(f"format_number({column}, '0.0')")


def _rules() -> list[tuple[Column, int, Column]]:
    """(condition, points, reason) of the actionable strategy, in order. Ranges include both ends."""
    crap, c, cov = F.col("crap"), F.col("cyclomatic"), F.col("coverage")
    return [
        (crap.between(15, 40), 100, F.concat(F.lit("crap "), _one_decimal("crap"), F.lit(" lies in [15,40]"))),
        (c.between(5, 15), 50, F.concat(F.lit("complexity "), c.cast("string"), F.lit(" lies in [5,15]"))),
        (cov.between(60, 90), 50, F.concat(F.lit("coverage "), _one_decimal("coverage"), F.lit("% lies in [60,90]"))),
        (cov <= 0, -80, F.lit("function isn't covered")),
        (crap > 80, -50, F.concat(F.lit("crap "), _one_decimal("crap"), F.lit(" exceeds 80"))),
    ]


def with_entries(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with cyclomatic, coverage and crap of their function, null without one; rows never multiply."""
    entry = one_entry(scores).select("file", "function", "cyclomatic", "coverage", "crap")
    return candidates.join(entry, ["file", "function"], "left")


def actionable_score() -> Column:
    points = sum((F.when(F.coalesce(when, F.lit(False)), n).otherwise(0) for when, n, _ in _rules()), F.lit(0))
    return F.when(F.col("crap").isNull(), -80).otherwise(points)


def reasons(strategy: str) -> Column:
    if strategy == "actionable":
        fired = F.filter(F.array(*(F.when(when, text) for when, _, text in _rules())), lambda x: x.isNotNull())
        fired = F.when(F.col("crap").isNull(), F.array(F.lit("function has no entry"))).otherwise(fired)
    elif strategy == "highest-crap":
        fired = F.array(F.when(F.col("crap").isNull(), "function has no entry").otherwise(F.concat(F.lit("crap "), _one_decimal("crap"))))
    else:
        fired = F.array(F.lit("discovery order"))
    return F.when(F.size(fired) == 0, F.array(F.lit("no scoring rules matched"))).otherwise(fired)


def selection_score(strategy: str) -> Column:
    """0 for discovery; the rules' sum; crap rounded half away from zero, the least int without an entry."""
    if strategy == "actionable":
        return actionable_score().cast("int")
    if strategy == "highest-crap":
        return F.coalesce(F.round("crap").cast("int"), F.lit(_INT_MIN))
    return F.lit(0)


def strategy_order(strategy: str, seeded: bool = False) -> list[Column]:
    tie = [F.asc("ranking_key"), F.asc("stable_id")] if seeded else []
    if strategy == "discovery":
        return [*tie, F.asc("discovery_seq")]
    if strategy == "actionable":
        return [F.desc("selection_score"), *tie, F.asc("id")]
    if strategy == "highest-crap":
        return [F.desc_nulls_last("crap"), *tie, F.asc("id")]
    raise ValueError(strategy)


def plan(candidates: DataFrame, scores: DataFrame, strategy: str = "discovery", limit: int | None = None, seed: str | None = None, commit: str = "") -> DataFrame:
    """Candidates in plan order with plan_index from 0, selection_score and selection_reasons.

    candidates: id, file, function, discovery_seq, and with a seed operator, start_byte, end_byte,
    original, replacement. A smaller limit gives a prefix of a larger one's plan.
    """
    known = with_entries(candidates, scores).withColumn("selection_score", selection_score(strategy)).withColumn("selection_reasons", reasons(strategy))
    if seed is not None:
        known = seeded(known, seed, commit)
    order = strategy_order(strategy, seed is not None)
    if limit is not None:
        known = known.orderBy(*order).limit(limit)
    return with_place(known, order, "plan_index").withColumn("plan_index", F.col("plan_index") - 1)


def stable_id() -> Column:
    path = F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^\./", "")
    return F.concat_ws("\0", path, "operator", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), "original", "replacement")


def framed(*fields: bytes) -> bytes:
    """Fields each after its length as eight little-endian bytes, so that no two lists of fields are alike."""
    return b"".join(len(x).to_bytes(8, "little") + x for x in fields)


def ranking_key(seed: str, commit: str, stable: str, version: str = RANKING) -> str:
    return blake3(framed(version.encode(), commit.encode(), seed.encode(), stable.encode())).hex()


def seeded(candidates: DataFrame, seed: str, commit: str = "", version: str = RANKING) -> DataFrame:
    """Candidates with stable_id (fields joined by NUL) and ranking_key, a keyed order that version, seed and commit fix."""
    @F.pandas_udf("string")
    def key(stable: pd.Series) -> pd.Series:
        fields = (version.encode(), commit.encode(), seed.encode())
        return pd.Series([x.hex() for x in blake3_many([framed(*fields, x.encode()) for x in stable])])

    return candidates.withColumn("stable_id", stable_id()).withColumn("ranking_key", key("stable_id"))


def discovery_order() -> list[Column]:
    return [path_parts("file"), F.col("line"), F.col("column"), F.col("implementation")]
