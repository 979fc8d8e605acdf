"""Replacement texts of all mutation operators: token swaps by a broadcast join, the rest by column expressions or scanners."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.functions.catalog import OPERATORS, swap_map, swaps
from mutalake.functions.scanners import SCANNERS

_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def _ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}+", "")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _rest(c: Column, n: int) -> Column:
    return F.substring(c, n + 1, 1 << 30)


def _prefixed(c: Column, sign: str) -> Column:
    """The text after a leading sign."""
    return F.when(c.startswith(sign), _filled(_ltrim(_rest(c, len(sign)))))


def _negated(c: Column, sign: str, opening: str) -> Column:
    return F.when(c.startswith(sign), trim(_rest(c, len(sign)))).otherwise(F.concat(F.lit(opening), trim(c), F.lit(")")))


def _len_zero(c: Column) -> Column:
    t = trim(c)
    out = F.lit(None).cast("string")
    for old, new in (("> 0", "== 0"), ("!= 0", "== 0"), ("== 0", "!= 0")):
        out = F.when(t.endswith(old), F.concat(F.substring(t, F.lit(1), F.length(t) - len(old)), F.lit(new))).otherwise(out)
    return F.when(t.startswith("len("), out)


def _string_empty(c: Column) -> Column:
    q = F.substring(c, 1, 1)
    quoted = q.isin('"', "'", "`") & (F.substring(c, -1, 1) == q) & (F.length(c) > 2) & ~((q == "`") & c.contains("${"))
    return F.when(quoted, F.concat(q, q))


def _bracketed(c: Column, pair: str) -> Column:
    t = trim(c)
    return F.when(t.startswith(pair[0]) & t.endswith(pair[1]) & (t != pair), F.lit(pair))


#: Operators whose replacement is an expression of the node's text; a language's own form comes first.
EXPRESSIONS = {
    "remove_not": lambda c: _prefixed(c, "!"),
    "remove_unary_minus": lambda c: _prefixed(c, "-"),
    "rust.negate_predicate_method": lambda c: F.concat(F.lit("!"), c),
    "negate_predicate_method": lambda c: _negated(c, "not ", "not ("),
    "truthiness_negation": lambda c: _negated(c, "not ", "not ("),
    "len_zero_boundary": _len_zero,
    "comprehension_filter_removal": lambda c: F.lit(""),
    "none_return": lambda c: F.when(trim(c) != "None", F.lit("None")),
    "option_some_none": lambda c: F.when(c.startswith("Some"), F.lit("None")),
    "remove_try": lambda c: F.when(c.endswith("?"), _filled(F.substring(c, F.lit(1), F.length(c) - 1))),
    "match_wildcard_to_panic": lambda c: F.lit('panic!("mutated wildcard arm")'),
    "empty_vec_macro": lambda c: F.when(c.startswith("vec!"), F.lit("vec![]")),
    "expect_to_unwrap_or_default": lambda c: F.when(c.contains(".expect("), F.concat(F.substring_index(c, ".expect(", 1), F.lit(".unwrap_or_default()"))),
    "includes_negation": lambda c: _negated(c, "!", "!("),
    "ternary_condition_negation": lambda c: _negated(c, "!", "!("),
    "optional_chaining_removal": lambda c: F.replace(F.replace(c, F.lit("?.("), F.lit("(")), F.lit("?."), F.lit(".")),
    "array_empty_literal": lambda c: _bracketed(c, "[]"),
    "object_empty_literal": lambda c: _bracketed(c, "{}"),
    "string_empty_literal": _string_empty,
    "await_removal": lambda c: _filled(F.regexp_extract(c, r"(?s)^\s*await\s+(.+)$", 1)),
    "null_forgiving_removal": lambda c: F.when(c.endswith("!"), _filled(F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - 1), f"{_BLANK}+$", ""))),
    "throw_expression_to_null": lambda c: F.when(c.startswith("throw"), F.lit("null")),
}

TOKEN_OPERATORS = sorted({impl.split(".")[1] for impl, _, _ in swaps()})


def kind_of(operator: str) -> str:
    """swap, expression or scanner."""
    if operator in TOKEN_OPERATORS:
        return "swap"
    return "scanner" if operator in SCANNERS else "expression"


def rewrite_text(operator: str, text: Column, language: str | None = None) -> Column:
    """The replacement of an expression or scanner operator; null for none."""
    own = EXPRESSIONS.get(f"{language}.{operator}") or EXPRESSIONS.get(operator)
    if own:
        return own(text)
    scan = SCANNERS[operator]

    @F.pandas_udf("string")
    def scanned(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else scan(x))

    return scanned(text)


def _scanned(operator: Column, text: Column) -> Column:
    """The replacement of a scanner operator's text, null for null: one call for all scanners, and a filter of its result doesn't call it again."""
    @F.pandas_udf("string")
    def scan(operators: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([SCANNERS[o](x) if isinstance(x, str) else None for o, x in zip(operators, texts, strict=True)], dtype=object)

    return scan.asNondeterministic()(operator, text)


def rewrite_targets(targets: DataFrame, operators: list[str] | None = None) -> DataFrame:
    """targets(implementation, original, …) with replacement; targets without one are dropped.

    operators: those that occur, so that other rewrites stay out of the plan; null for all.
    """
    spark = targets.sparkSession
    out = targets.join(F.broadcast(swap_map(spark).withColumnRenamed("replacement", "swapped_")), ["implementation", "original"], "left")  # a fixed table
    out = out.withColumn("operator_", F.substring_index("implementation", ".", -1))
    names = [name for name, *_ in OPERATORS if kind_of(name) != "swap" and (operators is None or name in operators)]
    operator, language = F.col("operator_"), F.substring_index("implementation", ".", 1)
    scanners = [name for name in names if kind_of(name) == "scanner"]
    out = out.withColumn("scanned_", _scanned(operator, F.when(operator.isin(*scanners), F.col("original")))) if scanners else out
    def other(text: Column) -> Column:
        value = F.lit(None).cast("string")
        for name in names:
            if name in scanners:
                continue
            value = F.when(operator == name, rewrite_text(name, text)).otherwise(value)
            if f"rust.{name}" in EXPRESSIONS:
                value = F.when((operator == name) & (language == "rust"), rewrite_text(name, text, "rust")).otherwise(value)
        return value

    # Swaps are operators of their own. The rest stands in a lambda: code generated for so many branches is more than the JVM compiles, and all rows would pay.
    value = F.coalesce("swapped_", *(["scanned_"] if scanners else []), F.transform(F.array("original"), other)[0])
    return out.withColumn("replacement", value).drop("swapped_", "operator_", "scanned_").where("replacement is not null")
