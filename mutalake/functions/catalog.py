"""Dimensions: mutation operators, their implementations by language, token swaps, and languages.

The names, categories, defaults, extensions and swaps below are fixed values of the domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SHORT = {"rs": "rust", "cs": "c_sharp", "py": "python", "js": "javascript", "ts": "typescript", "go": "go"}

# Operator, category, on by default, languages.
OPERATORS = [
    ("comparison_boundary", "comparison", True, "rs cs py js ts go"),
    ("comparison_negation", "comparison", True, "rs cs py js ts"),
    ("negate_equality", "equality", True, "rs cs py js ts go"),
    ("swap_logical", "logical", True, "rs cs py js ts go"),
    ("swap_boolean", "boolean_literal", True, "rs cs py js ts go"),
    ("remove_not", "logical", True, "rs cs js ts"),
    ("integer_zero_one", "numeric_literal", False, "rs cs py js ts go"),
    ("range_inclusive_exclusive", "range_boundary", True, "rs"),
    ("swap_predicate_method", "method", True, "rs"),
    ("negate_predicate_method", "method", True, "rs py"),
    ("return_boolean", "return_value", True, "rs cs py js ts"),
    ("is_none_negation", "nullability", True, "py"),
    ("in_negation", "membership", True, "py"),
    ("truthiness_negation", "truthiness", True, "py"),
    ("len_zero_boundary", "collection_boundary", False, "py"),
    ("dict_get_default_removal", "dict", False, "py"),
    ("comprehension_filter_removal", "comprehension", False, "py"),
    ("none_return", "return_value", False, "py"),
    ("empty_collection_literal", "collection", False, "py"),
    ("iterator_any_all", "method", True, "rs py js ts"),
    ("match_bool_pattern", "pattern_matching", True, "rs"),
    ("ok_err_boolean", "error_handling", True, "rs"),
    ("some_boolean", "nullability", True, "rs"),
    ("option_some_none", "nullability", False, "rs"),
    ("remove_try", "error_handling", False, "rs"),
    ("unwrap_to_unwrap_or_default", "error_handling", False, "rs"),
    ("min_max_swap", "method", False, "rs py"),
    ("match_wildcard_to_panic", "pattern_matching", False, "rs"),
    ("empty_vec_macro", "collection", False, "rs"),
    ("saturating_checked_swap", "arithmetic", False, "rs"),
    ("expect_to_unwrap_or_default", "error_handling", False, "rs"),
    ("string_boundary_method_swap", "method", True, "js ts"),
    ("includes_negation", "membership", True, "js ts"),
    ("sorted_reverse_flip", "method", False, "py"),
    ("dict_get_to_index", "dict", False, "py"),
    ("nullish_coalescing_removal", "nullability", False, "cs js ts"),
    ("optional_chaining_removal", "nullability", False, "js ts"),
    ("ternary_arm_swap", "conditional", False, "cs js ts"),
    ("ternary_condition_negation", "conditional", False, "cs"),
    ("array_empty_literal", "collection", False, "js ts"),
    ("object_empty_literal", "object", False, "js ts"),
    ("string_empty_literal", "string", False, "cs js ts"),
    ("await_removal", "statement", False, "js ts"),
    ("swap_arithmetic", "arithmetic", True, "cs"),
    ("swap_assignment", "assignment", True, "cs"),
    ("remove_unary_minus", "arithmetic", True, "cs"),
    ("plus_to_minus", "arithmetic", True, "cs"),
    ("null_forgiving_removal", "nullability", True, "cs"),
    ("nullable_access_to_member_access", "nullability", False, "cs"),
    ("is_pattern_negation", "pattern_matching", True, "cs"),
    ("as_expression_to_direct_cast", "nullability", False, "cs"),
    ("checked_unchecked_swap", "arithmetic", True, "cs"),
    ("throw_expression_to_null", "error_handling", False, "cs"),
    ("default_literal_to_null", "nullability", False, "cs"),
]

# Language, support, extensions, in registry order.
LANGUAGES = [
    ("bash", "scan_only", "sh bash"), ("javascript", "mutate_experimental", "js jsx mjs cjs"), ("typescript", "mutate_experimental", "ts tsx"),
    ("python", "mutate_experimental", "py"), ("java", "scan_only", "java"), ("c_sharp", "mutate_experimental", "cs"),
    ("cpp", "scan_only", "cpp cc cxx hpp hh hxx"), ("c", "scan_only", "c h"), ("dart", "scan_only", "dart"), ("elixir", "scan_only", "ex exs"),
    ("erlang", "scan_only", "erl"), ("gleam", "scan_only", "gleam"), ("go", "mutate_experimental", "go"), ("haskell", "scan_only", "hs"),
    ("julia", "scan_only", "jl"), ("lua", "scan_only", "lua"), ("ocaml", "scan_only", "ml"), ("rust", "mutate_stable", "rs"),
    ("ruby", "scan_only", "rb"), ("php", "scan_only", "php"), ("scala", "scan_only", "scala"), ("swift", "scan_only", "swift"), ("zig", "scan_only", "zig"),
]

# Operator, pairs that swap both ways.
_SWAPS = {
    "comparison_boundary": [("<", "<="), (">", ">=")],
    "comparison_negation": [("<", ">="), (">", "<=")],
    "negate_equality": [("==", "!=")],
    "swap_logical": [("&&", "||")],
    "swap_boolean": [("true", "false")],
    "integer_zero_one": [("0", "1")],
    "range_inclusive_exclusive": [("..", "..=")],
    "swap_predicate_method": [("is_some", "is_none"), ("is_ok", "is_err")],
    "return_boolean": [("true", "false")],
    "is_none_negation": [("is", "is not")],
    "in_negation": [("in", "not in")],
    "iterator_any_all": [("any", "all")],
    "match_bool_pattern": [("true", "false")],
    "ok_err_boolean": [("true", "false")],
    "some_boolean": [("true", "false")],
    "min_max_swap": [("min", "max")],
    "saturating_checked_swap": [("checked_add", "saturating_add"), ("checked_sub", "saturating_sub")],
    "string_boundary_method_swap": [("startsWith", "endsWith")],
    "swap_arithmetic": [("+", "-"), ("*", "/")],
    "swap_assignment": [("+=", "-="), ("*=", "/=")],
    "checked_unchecked_swap": [("checked", "unchecked")],
}
# Swaps that go one way.
_ONE_WAY = {"unwrap_to_unwrap_or_default": [("unwrap", "unwrap_or_default")], "swap_arithmetic": [("%", "*")], "plus_to_minus": [("+", "-")], "default_literal_to_null": [("default", "null")]}
# A language's own spellings.
_OWN = {
    ("python", "swap_logical"): [("and", "or")],
    ("python", "swap_boolean"): [("True", "False")],
    ("python", "return_boolean"): [("True", "False")],
    ("javascript", "iterator_any_all"): [("some", "every")],
    ("typescript", "iterator_any_all"): [("some", "every")],
    ("javascript", "negate_equality"): [("==", "!="), ("===", "!==")],
    ("typescript", "negate_equality"): [("==", "!="), ("===", "!==")],
}

#: Operators whose edits give way to another operator's with the same result.
LOW_PRIORITY = ("swap_boolean", "negate_equality")


def implementations() -> list[tuple[str, str, str]]:
    """(implementation, operator, language), one for each operator and language."""
    return [(f"{_SHORT[x]}.{name}", name, _SHORT[x]) for name, _, _, langs in OPERATORS for x in langs.split()]


def swaps() -> list[tuple[str, str, str]]:
    """(implementation, original, replacement) of all token swaps."""
    out = []
    for impl, operator, language in implementations():
        both = _OWN.get((language, operator), _SWAPS.get(operator, []))
        out += [(impl, a, b) for x, y in both for a, b in ((x, y), (y, x))]
        out += [(impl, a, b) for a, b in _ONE_WAY.get(operator, [])]
    return out


def operator_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, name, category, on) for i, (name, category, on, _) in enumerate(OPERATORS)]
    return spark.createDataFrame(rows, "ordinal int, operator string, category string, default_enabled boolean")


def implementation_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(implementations(), "implementation string, operator string, language string")


def language_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, name, support, extensions.split()) for i, (name, support, extensions) in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "ordinal int, language string, support string, extensions array<string>")


def swap_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(swaps(), "implementation string, original string, replacement string")


def enabled_operators(spark: SparkSession, include: list[str] | None = None, exclude: list[str] = (), categories: list[str] = ()) -> DataFrame:
    """Operators that run: those named (or of a named category) if any are, else the defaults; minus the excluded."""
    from pyspark.sql import functions as F

    known = {name for name, *_ in OPERATORS}
    if unknown := ({*(include or ()), *exclude} - known) | ({*categories} - {c for _, c, _, _ in OPERATORS} - {"regex"}):
        raise ValueError(f"unknown: {sorted(unknown)}")
    catalog = operator_catalog(spark)
    chosen = F.col("operator").isin(list(include or ())) | F.col("category").isin(list(categories)) if include or categories else F.col("default_enabled")
    return catalog.where(chosen & ~F.col("operator").isin(list(exclude)))
