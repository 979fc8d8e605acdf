"""Edits of source text: byte offsets, canonical spans, de-duplication, splicing, and skip rules."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalake.functions.catalog import LOW_PRIORITY
from mutalake.operators.scoring import innermost

#: Macros whose calls are assertions, and those that end the program: fixed values.
ASSERTIONS = ["assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne", "matches"]
PANICS = ["panic", "unreachable", "todo", "unimplemented"]


def byte_column(text: Column, char_offset: Column) -> Column:
    """The byte offset of a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), char_offset))


def _common(a: Column, b: Column) -> Column:
    """Characters that two strings share at their start."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.array_min(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.coalesce(first - 1, n)


def canonical_edit(df: DataFrame) -> DataFrame:
    """df with edit_start, edit_end, edit_text: the smallest changed span, in bytes, of original -> replacement at start_byte.

    The common prefix goes first, then the common suffix of what remains.
    """
    step = df.withColumn("p_", _common(F.col("original"), F.col("replacement")))
    step = step.withColumn("a_", F.expr("substring(original, p_ + 1)")).withColumn("b_", F.expr("substring(replacement, p_ + 1)"))
    step = step.withColumn("s_", _common(F.reverse("a_"), F.reverse("b_")))
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - F.col("s_"))
    step = step.withColumn("edit_start", F.col("start_byte") + F.octet_length(F.substring("original", F.lit(1), F.col("p_"))))
    return step.withColumn("edit_end", F.col("edit_start") + F.octet_length(cut(F.col("a_")))).withColumn("edit_text", cut(F.col("b_"))).drop("p_", "a_", "b_", "s_")


def edit_priority(operator: Column) -> Column:
    return F.when(operator.isin(*LOW_PRIORITY), 0).otherwise(1)


def dedupe_overlapping(candidates: DataFrame) -> DataFrame:
    """One candidate a canonical edit of a file: the operator of higher priority, then the first found."""
    edited = canonical_edit(candidates).withColumn("priority_", edit_priority(F.col("operator")))
    order = Window.partitionBy("file", "edit_start", "edit_end", "edit_text").orderBy(F.desc("priority_"), "discovery_seq")
    return edited.withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_", "priority_")


def first_per_site(matches: DataFrame) -> DataFrame:
    """One match an (implementation, start_byte, end_byte) of a file: that of the first function in scan order."""
    order = Window.partitionBy("file", "implementation", "start_byte", "end_byte").orderBy("scan_seq")
    return matches.withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_")


def widen_deletions(candidates: DataFrame) -> DataFrame:
    """An empty replacement after a space (column before, the byte before the edit) takes the space with it."""
    wide = (F.col("replacement") == "") & F.coalesce(F.col("before") == " ", F.lit(False))
    return candidates.withColumn("start_byte", F.when(wide, F.col("start_byte") - 1).otherwise(F.col("start_byte"))).withColumn("column", F.when(wide, F.col("column") - 1).otherwise(F.col("column"))).withColumn("original", F.when(wide, F.concat(F.lit(" "), "original")).otherwise(F.col("original")))


def splice(df: DataFrame) -> DataFrame:
    """df(text, start_byte, end_byte, original, replacement) with mutated_text, null where the span doesn't hold original."""
    raw = F.encode("text", "UTF-8")
    part = lambda a, n: F.decode(F.substring(raw, a, n), "UTF-8")
    held = part(F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    good = (F.col("start_byte") >= 0) & (F.col("end_byte") >= F.col("start_byte")) & (F.col("end_byte") <= F.octet_length("text")) & (held == F.col("original"))
    return df.withColumn("mutated_text", F.when(good, F.concat(part(F.lit(1), F.col("start_byte")), "replacement", part(F.col("end_byte") + 1, F.octet_length("text")))))


def diff_text(path: str, before: str, after: str) -> str:
    """Changed lines with three lines around them, under --- and +++, without hunk headers."""
    lines = difflib.unified_diff(before.splitlines(), after.splitlines(), path, path, n=3, lineterm="")
    return "\n".join(x for x in lines if not x.startswith("@@"))


def with_diff(df: DataFrame) -> DataFrame:
    """df(file, text, mutated_text) with diff."""
    @F.pandas_udf("string")
    def diff(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else diff_text(p, x, y) for p, x, y in zip(path, a, b, strict=True)])

    return df.withColumn("diff", diff("file", "text", "mutated_text"))


def is_generated(text: Column) -> Column:
    """A comment in the first 15 lines says so."""
    head = F.slice(F.split(text, "\n"), 1, 15)
    return F.exists(head, lambda x: x.rlike(r"^\s*(//|/\*|\*|#)") & (x.contains("@generated") | x.contains("DO NOT EDIT")))


def is_test_file(path: Column) -> Column:
    """By a folder's name, the file's stem, or conftest.py."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.arrays_overlap(parts, F.array(*map(F.lit, ("tests", "__tests__", "spec", "specs")))) | stem.rlike(r"^tests$|(_test|_tests|_spec|_specs|\.test|\.spec)$|^(test_|spec_)") | (name == "conftest.py")


def skip_rules(candidates: DataFrame, sources: DataFrame, macros: DataFrame) -> DataFrame:
    """candidates(file, start_byte, …) with skip_rule: generated_file, test_file, assertion_macro, panic_macro or null, in that order.

    Only the innermost macro around an edit counts. Files without a source row are kept.
    """
    flags = sources.select("file", is_generated(F.col("text")).alias("generated_"))
    around = innermost(candidates.select("file", F.col("start_byte").alias("at")).distinct(), macros).select("file", F.col("at").alias("start_byte"), F.col("name").alias("macro_"))
    joined = candidates.join(flags, "file", "left").join(around, ["file", "start_byte"], "left")
    readable = F.col("generated_").isNotNull()
    rule = F.when(F.col("generated_"), "generated_file").when(readable & is_test_file(F.col("file")), "test_file").when(readable & F.col("macro_").isin(*ASSERTIONS), "assertion_macro").when(readable & F.col("macro_").isin(*PANICS), "panic_macro")
    return joined.withColumn("skip_rule", rule).drop("generated_", "macro_")


_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*")
_SKIPPED = re.compile(rb'"(?:[^"\\]|\\.)*+"?|//[^\n]*', re.S)
_NESTED = re.compile(rb"/\*|\*/")
_OPENS = {40: 41, 91: 93, 123: 125}


def _not_code(raw: bytes, i: int) -> int:
    """Behind the string or comment that begins at i; i itself if none does."""
    if raw[i] == 34 or raw[i : i + 2] == b"//":
        return _SKIPPED.match(raw, i).end()
    if raw[i : i + 2] != b"/*":
        return i
    level, i = 1, i + 2
    while level and (m := _NESTED.search(raw, i)):
        level += 1 if m.group() == b"/*" else -1
        i = m.end()
    return len(raw) if level else i


def macro_ranges(text: str) -> list[tuple[str, int, int]]:
    """(name, first byte inside the brackets, byte of the closing one) of macro calls name!(…), outside strings and comments.

    Calls inside a call aren't listed, nor calls that never close. Linear in the text.
    """
    out: list[tuple[str, int, int]] = []
    raw, i, name, begin = text.encode(), 0, "", 0
    closers: list[int] = []
    while i < len(raw):
        if (after := _not_code(raw, i)) > i:
            i = after
            continue
        c = raw[i]
        if not closers and (m := _NAME.match(raw, i)):
            i = m.end()
            if raw[i : i + 1] == b"!":
                j = i + 1
                while j < len(raw) and raw[j] in b" \t\r\n\f":
                    j += 1
                if j < len(raw) and raw[j] in _OPENS:
                    name, begin, closers, i = m.group().decode(), j + 1, [_OPENS[raw[j]]], j + 1
            continue
        if closers and c in _OPENS:
            closers.append(_OPENS[c])
        elif closers and c == closers[-1]:
            closers.pop()
            if not closers:
                out.append((name, begin, i))
        i += 1
    return out


def macro_table(sources: DataFrame) -> DataFrame:
    """(file, name, s, e) of the macro calls of sources (file, text); null texts have none."""
    @F.pandas_udf("array<struct<name: string, s: int, e: int>>")
    def ranges(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"name": n, "s": a, "e": b} for n, a, b in macro_ranges(x)] if x is not None else [])

    return sources.select("file", F.explode(ranges("text")).alias("m")).select("file", "m.*")
