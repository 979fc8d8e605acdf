"""A query and its SQL twin for each mutation operator, over texts composed from the part table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.functions.catalog import OPERATORS, implementations, swaps
from mutalake.functions.rewrites import kind_of, rewrite_targets
from mutalake.plans.adapters import load

#: Texts of the operators that aren't token swaps; {n} is the part's name.
TEMPLATES = {
    "remove_not": ["!{n}", "{n}", "!  {n}", "!"],
    "remove_unary_minus": ["-{n}", "{n}", "- {n}"],
    "negate_predicate_method": ["{n}.isdigit()", "not {n}.isdigit()", " {n}.isalpha() "],
    "truthiness_negation": ["{n}", "not {n}", "not  {n}"],
    "len_zero_boundary": ["len({n}) == 0", "len({n}) != 0", "len({n}) > 0", "len({n}) > 1", "{n} == 0"],
    "comprehension_filter_removal": ["if {n}"],
    "none_return": ["{n}", "None", " None "],
    "option_some_none": ["Some({n})", "Ok({n})"],
    "remove_try": ["{n}?", "{n}"],
    "match_wildcard_to_panic": ["{n}"],
    "empty_vec_macro": ["vec![{n}]", "[{n}]"],
    "expect_to_unwrap_or_default": ["{n}.expect(\"m\")", "{n}.unwrap()"],
    "includes_negation": ["a.includes({n})", "!a.includes({n})"],
    "ternary_condition_negation": ["{n} > 1", "!{n}"],
    "optional_chaining_removal": ["a?.{n}", "f?.({n})", "a?.[{n}]", "{n}"],
    "array_empty_literal": ["[{n}]", "[]", "{n}"],
    "object_empty_literal": ["{ a: {n} }", "{}", "{n}"],
    "string_empty_literal": ['"{n}"', "'{n}'", '""', "`{n}`", "`${{n}}`", "{n}"],
    "await_removal": ["await {n}", "{n}", "await  f({n})"],
    "null_forgiving_removal": ["{n}!", "{n} !", "{n}", "!"],
    "throw_expression_to_null": ["throw {n}", "{n}"],
    "dict_get_default_removal": ["d.get({n}, 0)", "d.get({n})", "d.get(f({n}, 1), 2)"],
    "dict_get_to_index": ["d.get({n})", "d.get({n}, 1)", "d.get(f({n}, 1))"],
    "empty_collection_literal": ["[{n}]", "{a: {n}}", "{{n}}", "[]", "{'a:b', {n}}"],
    "sorted_reverse_flip": ["sorted({n})", "sorted({n}, reverse=True)", "sorted({n}, key=f, reverse=False)", "sorted({n}, reverse=r)"],
    "nullish_coalescing_removal": ["{n} ?? b", "f(a ?? b) ?? {n}", "{n}"],
    "ternary_arm_swap": ["a ? {n} : c", "a ?? b ? {n} : d", "a ? b ? 1 : 2 : {n}", "{n}"],
    "nullable_access_to_member_access": ["{n}?.Name", "{n}?[0]", "'a?.b' + {n}", "{n}"],
    "is_pattern_negation": ["x is {n}", "x is not {n}", "f(x is y)", "a is b is {n}"],
    "as_expression_to_direct_cast": ["x as T", "{n} + 1 as T", "f(x as y)"],
}

#: The same rewrites as DuckDB expressions of t.
_TWINS = {
    "remove_not": "CASE WHEN starts_with(t, '!') THEN nullif(ltrim(substr(t, 2)), '') END",
    "remove_unary_minus": "CASE WHEN starts_with(t, '-') THEN nullif(ltrim(substr(t, 2)), '') END",
    "negate_predicate_method": "CASE WHEN implementation = 'rust.negate_predicate_method' THEN '!' || t WHEN starts_with(t, 'not ') THEN trim(substr(t, 5)) ELSE 'not (' || trim(t) || ')' END",
    "truthiness_negation": "CASE WHEN starts_with(t, 'not ') THEN trim(substr(t, 5)) ELSE 'not (' || trim(t) || ')' END",
    "len_zero_boundary": "CASE WHEN NOT starts_with(t, 'len(') THEN NULL WHEN ends_with(t, '== 0') THEN t[:-5] || '!= 0' WHEN ends_with(t, '!= 0') THEN t[:-5] || '== 0' WHEN ends_with(t, '> 0') THEN t[:-4] || '== 0' END",
    "comprehension_filter_removal": "''",
    "none_return": "CASE WHEN trim(t) <> 'None' THEN 'None' END",
    "option_some_none": "CASE WHEN t LIKE 'Some%' THEN 'None' END",
    "remove_try": "CASE WHEN t LIKE '%?' THEN nullif(left(t, -1), '') END",
    "match_wildcard_to_panic": "'panic!(\"mutated wildcard arm\")'",
    "empty_vec_macro": "CASE WHEN t LIKE 'vec!%' THEN 'vec![]' END",
    "expect_to_unwrap_or_default": "CASE WHEN contains(t, '.expect(') THEN split_part(t, '.expect(', 1) || '.unwrap_or_default()' END",
    "includes_negation": "CASE WHEN starts_with(t, '!') THEN trim(substr(t, 2)) ELSE '!(' || trim(t) || ')' END",
    "ternary_condition_negation": "CASE WHEN starts_with(t, '!') THEN trim(substr(t, 2)) ELSE '!(' || trim(t) || ')' END",
    "optional_chaining_removal": "replace(replace(t, '?.(', '('), '?.', '.')",
    "array_empty_literal": "CASE WHEN trim(t) LIKE '[%]' AND trim(t) <> '[]' THEN '[]' END",
    "object_empty_literal": "CASE WHEN trim(t) LIKE '{%}' AND trim(t) <> '{}' THEN '{}' END",
    "string_empty_literal": "CASE WHEN length(t) > 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN ('\"', '''', '`') AND NOT (left(t, 1) = '`' AND contains(t, '${')) THEN left(t, 1) || left(t, 1) END",
    "await_removal": "nullif(regexp_extract(t, '^\\s*await\\s+(.+)$', 1, 's'), '')",
    "null_forgiving_removal": "CASE WHEN t LIKE '%!' THEN nullif(rtrim(left(t, -1)), '') END",
    "throw_expression_to_null": "CASE WHEN t LIKE 'throw%' THEN 'null' END",
}


#: What the scanner operators must make of their TEMPLATES, worked out by hand; null for no edit.
_CASES = {
    "dict_get_default_removal": ["d.get({n})", None, "d.get(f({n}, 1))"],
    "dict_get_to_index": ["d[{n}]", None, "d[f({n}, 1)]"],
    "empty_collection_literal": ["[]", "{}", "set()", None, "set()"],
    "sorted_reverse_flip": ["sorted({n}, reverse=True)", "sorted({n}, reverse=False)", "sorted({n}, key=f, reverse=True)", None],
    "nullish_coalescing_removal": ["{n}", "f(a ?? b)", None],
    "ternary_arm_swap": ["a ? c : {n}", "a ?? b ? d : {n}", "a ? {n} : b ? 1 : 2", None],
    "nullable_access_to_member_access": ["{n}.Name", "{n}[0]", None, None],
    "is_pattern_negation": ["x is not {n}", "x is {n}", None, "a is b is not {n}"],
    "as_expression_to_direct_cast": ["(T)x", "(T)({n} + 1)", None],
}
for _name, _made in _CASES.items():
    _TWINS[_name] = f"CASE p_partkey % {len(_made)} " + " ".join(f"WHEN {i} THEN replace('{x}', '{{n}}', p_name)" for i, x in enumerate(_made) if x is not None) + " END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _texts(operator: str) -> list[str]:
    if kind_of(operator) == "swap":
        return [*dict.fromkeys(x for impl, x, _ in swaps() if impl.endswith(f".{operator}")), "other"]
    return TEMPLATES[operator]


def targets(spark: SparkSession, sf_dir: str, operator: str) -> DataFrame:
    """A target for each part and implementation of the operator."""
    texts = _texts(operator)
    case = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        case = F.when(F.col("p_partkey") % len(texts) == i, F.replace(F.lit(text), F.lit("{n}"), F.col("p_name"))).otherwise(case)
    impls = F.explode(F.array(*(F.lit(i) for i, name, _ in implementations() if name == operator)))
    return load(spark, sf_dir, "part").select("p_partkey", case.alias("original"), impls.alias("implementation"))


def _query(operator: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rewrite_targets(targets(spark, sf_dir, operator), [operator]).select("p_partkey", "implementation", "original", "replacement")


def _sql(operator: str) -> str:
    texts = _texts(operator)
    cases = " ".join(f"WHEN {i} THEN replace({_quoted(x)}, '{{n}}', p_name)" for i, x in enumerate(texts))
    impls = ", ".join(f"({_quoted(i)})" for i, name, _ in implementations() if name == operator)
    base = f"WITH targets AS (SELECT p_partkey, CASE p_partkey % {len(texts)} {cases} END AS t, implementation, p_name FROM part, (VALUES {impls}) AS i(implementation))"
    if kind_of(operator) == "swap":
        rows = ", ".join(f"({', '.join(map(_quoted, x))})" for x in swaps() if x[0].endswith(f".{operator}"))
        return f"{base}, swap(implementation, t, replacement) AS (VALUES {rows}) SELECT p_partkey, implementation, t AS original, replacement FROM targets JOIN swap USING (implementation, t)"
    return f"{base} SELECT * FROM (SELECT p_partkey, implementation, t AS original, {_TWINS[operator]} AS replacement FROM targets) WHERE replacement IS NOT NULL"


REWRITES = {f"rewrite_{name}": _query(name) for name, *_ in OPERATORS}
REWRITES_SQL = {f"rewrite_{name}": _sql(name) for name, *_ in OPERATORS if kind_of(name) == "swap" or name in _TWINS}
