"""Functions, their complexity, and mutation candidates, found while a text is parsed."""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from mutalake.functions.catalog import implementation_catalog, operator_catalog
from mutalake.functions.patterns import Pattern, pattern_catalog
from mutalake.functions.rewrites import rewrite_targets
from mutalake.operators.definitions import Definitions
from mutalake.operators.edits import dedupe_overlapping, widen_deletions
from mutalake.operators.scoring import path_parts
from mutalake.syntax.automaton import Automaton
from mutalake.syntax.nodes import Node, Rows, in_order
from mutalake.syntax.parsers import PARSERS
from mutalake.syntax.table import languages, tree

_SCRIPT_FUNCTIONS = "function_declaration function_expression arrow_function method_definition"
_SCRIPT_BRANCHES = "if_statement for_statement for_in_statement while_statement do_statement switch_case switch_default catch_clause ternary_expression"
_C_BRANCHES = "if_statement for_statement while_statement do_statement case_statement conditional_expression preproc_if preproc_ifdef preproc_elif preproc_elifdef"
# Language to kinds of functions, kinds of decisions, and operators that are decisions: fixed values.
CONVENTIONS: dict[str, tuple[str, str, str]] = {
    "rust": ("function_item closure_expression", "if_expression for_expression while_expression match_arm try_expression let_chain", "&& ||"),
    "python": ("function_definition", "if_statement elif_clause for_statement while_statement except_clause conditional_expression case_clause if_clause boolean_operator", ""),
    "javascript": (_SCRIPT_FUNCTIONS, _SCRIPT_BRANCHES, "&& || ??"),
    "typescript": (f"{_SCRIPT_FUNCTIONS} method_signature", _SCRIPT_BRANCHES, "&& || ??"),
    "go": ("function_declaration method_declaration func_literal", "if_statement for_statement expression_case type_case communication_case default_case", "&& ||"),
    "c_sharp": ("method_declaration constructor_declaration local_function_statement lambda_expression", "if_statement for_statement foreach_statement while_statement do_statement switch_section switch_expression_arm catch_clause catch_filter_clause when_clause conditional_expression", "&& || ??"),
    "java": ("method_declaration constructor_declaration lambda_expression", "if_statement for_statement enhanced_for_statement while_statement do_statement switch_block_statement_group switch_rule catch_clause ternary_expression binary_expression", ""),
    "cpp": ("function_definition lambda_expression", f"{_C_BRANCHES} for_range_loop catch_clause binary_expression", ""),
    "c": ("function_definition", f"{_C_BRANCHES} binary_expression", ""),
    "bash": ("function_definition", "if_statement elif_clause for_statement c_style_for_statement while_statement case_item ternary_expression binary_expression", ""),
    "dart": ("function_declaration method_declaration constructor_signature local_function_declaration function_expression", "if_statement for_statement for_element while_statement do_statement switch_statement_case switch_statement_default switch_expression_case catch_clause conditional_expression if_null_expression logical_and_expression logical_or_expression", ""),
    "elixir": ("call anonymous_function", "catch_block rescue_block stab_clause binary_operator", ""),
    "erlang": ("function_clause anonymous_fun", "if_expr if_clause case_expr cr_clause catch_clause catch_expr try_expr maybe_expr receive_expr receive_after binary_op_expr", ""),
    "gleam": ("function anonymous_function", "case_clause assert let_assert binary_expression", ""),
    "haskell": ("function lambda", "conditional guard alternative multi_way_if list_comprehension infix", ""),
    "julia": ("function_definition arrow_function_expression macro_definition", "if_statement elseif_clause for_statement while_statement catch_clause finally_clause ternary_expression", ""),
    "lua": ("function_declaration function_definition", "if_statement elseif_statement for_statement while_statement repeat_statement binary_expression", ""),
    "ocaml": ("value_definition function_expression fun_expression", "if_expression while_expression for_expression match_case try_expression infix_expression", ""),
    "ruby": ("method singleton_method", "if elsif unless when in_clause while until for rescue conditional if_modifier unless_modifier while_modifier until_modifier binary", ""),
    "php": ("function_definition method_declaration arrow_function anonymous_function", "if_statement else_if_clause for_statement foreach_statement while_statement do_statement case_statement default_statement catch_clause match_conditional_expression match_default_expression conditional_expression binary_expression", ""),
    "scala": ("function_definition lambda_expression", "if_expression while_expression do_while_expression for_expression case_clause catch_clause finally_clause try_expression infix_expression", ""),
    "swift": ("function_declaration init_declaration deinit_declaration subscript_declaration lambda_literal", "if_statement guard_statement for_statement while_statement repeat_while_statement switch_entry catch_block ternary_expression nil_coalescing_expression conjunction_expression disjunction_expression", ""),
    "zig": ("function_declaration test_declaration", "if_expression if_statement while_expression while_statement for_expression for_statement switch_case try_expression catch_expression binary_expression", ""),
}
#: Kinds that are functions only with a body and a name of one of these kinds.
_NAMED = {"function_item": "identifier", "method_definition": "property_identifier", "method_signature": "property_identifier"}
_BODIED = ("function_item", "function_definition", "function_declaration", "method_declaration", "constructor_declaration", "local_function_statement")


def _kinds(language: str, which: int) -> frozenset[str]:
    return frozenset(CONVENTIONS[language][which].split())


def _name_of(node: Node, text: str) -> tuple[str, str] | None:
    """(kind, text) of the first child without children that names a node."""
    return next(((k.kind, text[k.start : k.end]) for k in node.children if k.field == "name" and not k.children), None)


def is_function(node: Node, language: str, text: str) -> bool:
    """Whether a node of a function's kind is one: in languages that are parsed whole some need a body, others a plain name."""
    if language not in PARSERS:
        return True
    if node.kind in _BODIED and not any(k.field == "body" for k in node.children):
        return False
    return node.kind not in _NAMED or (_name_of(node, text) or ("", ""))[0] == _NAMED[node.kind]


def own_points(starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many points lie in each range [start, end) but in no range strictly within it."""
    points = np.sort(points)
    held = lambda a, b: int(np.searchsorted(points, b) - np.searchsorted(points, a))
    order = np.lexsort((-ends, starts))
    out, stack = np.zeros(len(starts), dtype=np.int64), []
    inside: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in order.tolist():
        own = (int(starts[k]), int(ends[k]))
        if own in inside:
            continue
        while stack and not (stack[-1][0] <= own[0] and own[1] <= stack[-1][1]):
            stack.pop()
        if stack:
            inside[stack[-1]].append(own)
        inside[own] = []
        stack.append(own)
    for k in range(len(starts)):
        a, b = int(starts[k]), int(ends[k])
        out[k], at = held(a, b), a
        for s, e in inside[a, b]:
            out[k] -= held(max(s, at), max(e, at))
            at = max(at, e)
    return out


_FUNCTION = "function: string, start_line: int, end_line: int, start_byte: int, end_byte: int, scan_seq: int, cyclomatic: bigint"
_SITE = "implementation: string, root_start: int, root_end: int, match_seq: int, start_byte: int, end_byte: int, line: int, column: int, scan_seq: int, function: string, original: string, before: string"
#: What a parse of a text keeps.
PARSED = f"functions array<struct<{_FUNCTION}>>, sites array<struct<{_SITE}>>"
#: Functions and sites of a batch of parsed texts.
BATCH = 20_000
#: Characters of a short text, and short texts whose parse a task remembers for their copies.
SHORT, REMEMBERED = 1_000, 4_096


def parsed_text(language: str, text: str, automaton: Automaton | None) -> tuple[list[tuple], list[tuple]]:
    """The functions and sites of one text, in the order of their nodes; see PARSED.

    A function without a name is called <anonymous>: and its first line. Its complexity is one more than
    the decisions inside, those of nested functions left aside. A site counts for the outermost function
    that holds its whole match, and has no function where none does.
    """
    return _parsed(language, text, automaton)[:2]


def _parsed(language: str, text: str, automaton: Automaton | None) -> tuple[list[tuple], list[tuple], list[Node]]:
    """parsed_text, and the nodes in order."""
    rows = Rows("", language, text, tree(language, text))
    order = in_order(rows.root)
    if automaton is not None:
        automaton.run(order, text)
    functions_kinds, decisions, signs = (_kinds(language, i) for i in range(3))
    functions, points, sites = [], [], []
    outer, ends = None, -1  # the outermost function that is open, where it ends
    for me, node in enumerate(order):
        if not node.named:
            continue
        if node.kind in decisions or signs and node.kind == "binary_expression" and any(not k.named and k.kind in signs for k in node.children):
            points.append(rows.byte(node.start))
        if node.kind in functions_kinds and is_function(node, language, text):
            line = rows.place(node.start)[0]
            name = (_name_of(node, text) or ("", f"<anonymous>:{line}"))[1]
            functions.append((name, line, bisect_right(rows.lines, node.end), rows.byte(node.start), rows.byte(node.end), me))
            if node.start >= ends:
                outer, ends = (me, name), node.end
        if automaton is not None and node.states & automaton.root_bits:
            held = outer if node.end <= ends else (None, None)
            for name, t in automaton.found(node):
                line, column = rows.place(t.start)
                sites.append((name, rows.byte(node.start), rows.byte(node.end), me, rows.byte(t.start), rows.byte(t.end), line, column, *held, text[t.start : t.end], text[t.start - 1] if t.start else None))
    if functions:
        own = own_points(np.array([f[3] for f in functions]), np.array([f[4] for f in functions]), np.array(points, dtype=np.int64))
        functions = [(*f, 1 + int(n)) for f, n in zip(functions, own, strict=True)]
    return functions, sites, order


def _automata(catalog: dict[str, list[Pattern]]) -> dict[str, Automaton]:
    by_language: dict[str, list[tuple[str, Pattern]]] = {}
    for impl, found in catalog.items():
        by_language.setdefault(impl.split(".")[0], []).extend((impl, p) for p in found)
    return {language: Automaton(found) for language, found in by_language.items()}


def _listed(groups: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """A column of lists of rows."""
    offsets = np.cumsum([0, *map(len, groups)]).astype(np.int32)
    flat = [row for group in groups for row in group]
    columns = list(zip(*flat, strict=True)) if flat else [[]] * kind.value_type.num_fields
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), rows, type=kind)


def parse_sources(sources: DataFrame, catalog: dict[str, list[Pattern]] | None = None) -> DataFrame:
    """(file, language, functions, sites) of sources (file, language, text): one parse a text, functions and matches alone leave it.

    catalog: the patterns to look for, null for none. Null texts and languages without a parser have no
    row; others have one, with empty lists where nothing is found. Odd syntax gives an odd tree, never
    an error. Repeated files give repeated rows. A task parses copies of a short text once, if not too many others lie between,
    and equal lines of plain definitions once; see definitions.
    """
    names = f"file string, language string, {PARSED}"
    schema = to_arrow_schema(_parse_datatype_string(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(catalog or {})
        plain = Definitions(lambda language, text: _parsed(language, text, automata.get(language)), automata)

        def parsed(language: str, text: str) -> tuple[list[tuple], list[tuple]]:
            gc.disable()  # a tree has no cycles, but so many objects that looking for them takes a quarter of the time
            try:
                return plain.parsed(language, text) or parsed_text(language, text, automata.get(language))
            finally:
                gc.enable()

        short = lru_cache(REMEMBERED)(parsed)
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)] + [_listed([r[i] for r in rows], schema.field(i).type) for i in (2, 3)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for file, language, text in zip(*(batch.column(x).to_pylist() for x in ("file", "language", "text")), strict=True):
                functions, sites = (short if len(text) <= SHORT else parsed)(language, text)
                rows.append((file, language, functions, sites))
                size += len(functions) + len(sites) + 1
                if size >= BATCH:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    known = sources.where("text is not null").where(F.col("language").isin(*languages()))
    return known.select("file", "language", "text").mapInArrow(run, names)


def functions_of(parsed: DataFrame) -> DataFrame:
    """(file, language, function, start_line, end_line, start_byte, end_byte, scan_seq, cyclomatic) of parsed sources."""
    return parsed.select("file", "language", F.explode("functions").alias("f")).select("file", "language", "f.*")


def scan_programs(sources: DataFrame) -> DataFrame:
    """functions_of sources (file, language, text), without looking for patterns."""
    return functions_of(parse_sources(sources))


def candidate_sites(sources: DataFrame, catalog: dict[str, list[Pattern]] | None = None) -> DataFrame:
    """(file, language, implementation, root_start, root_end, match_seq, start_byte, end_byte, line, column, scan_seq, function, original, before) of every capture."""
    return _sites(parse_sources(sources, pattern_catalog() if catalog is None else catalog))


def _sites(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", "language", F.explode("sites").alias("s")).select("file", "language", "s.*")


def discover(sources: DataFrame, catalog: dict[str, list[Pattern]] | None = None, operators: DataFrame | None = None, overrides: dict[str, bool] | None = None) -> DataFrame:
    """candidates_of sources (file, language, text), with the patterns of a catalog, null for all of the library's.

    A language without patterns has no candidates, so its texts aren't parsed.
    """
    patterns = pattern_catalog() if catalog is None else catalog
    sought = sources.where(F.col("language").isin(*sorted({name.split(".")[0] for name in patterns})))
    return candidates_of(parse_sources(sought, patterns), operators, overrides)


def candidates_of(parsed: DataFrame, operators: DataFrame | None = None, overrides: dict[str, bool] | None = None) -> DataFrame:
    """Mutation candidates of parsed sources, one an edit:

    id, file, language, function, operator, operator_category, implementation, line, column, start_byte,
    end_byte, original, replacement, discovery_seq. A site counts for the first function in scan order
    that holds its whole match. operators: those that run (a column operator), null for all; overrides:
    implementation to whether it runs, whatever its operator's default says. Sources without functions or
    sites have no rows; equal edits are one candidate, of the operator with the higher priority. Files
    must be unique. Sites are shuffled by file, texts aren't.
    """
    spark = parsed.sparkSession
    implementations = implementation_catalog(spark).withColumn("impl_seq", F.monotonically_increasing_id())
    if operators is not None:
        implementations = implementations.join(operators.select("operator", F.lit(True).alias("on_")), "operator", "left")
        on = F.coalesce("on_", F.lit(False))
        for impl, runs in (overrides or {}).items():
            on = F.when(F.col("implementation") == impl, F.lit(runs)).otherwise(on)
        implementations = implementations.where(on).drop("on_")
    sites = _sites(parsed).where("scan_seq is not null")
    flat = sites.join(F.broadcast(implementations.drop("language")), "implementation")  # a fixed table
    rewritten = widen_deletions(rewrite_targets(flat).withColumn("at_column", F.col("column")))
    order = Window.partitionBy("file").orderBy("scan_seq", "impl_seq", "match_seq", "start_byte")
    kept = dedupe_overlapping(rewritten.withColumn("discovery_seq", F.row_number().over(order)))
    category = operator_catalog(spark).select("operator", F.col("category").alias("operator_category"))
    out = kept.join(F.broadcast(category), "operator")  # a fixed table
    return out.select(
        F.concat_ws(":", "file", F.col("line").cast("string"), F.col("at_column").cast("string"), "implementation").alias("id"), "file", "language", "function", "operator", "operator_category", "implementation",
        "line", F.col("at_column").alias("column"), "start_byte", "end_byte", "original", "replacement", "discovery_seq")


def discovery_order(candidates: DataFrame) -> DataFrame:
    """In the order of path components, line, column and implementation."""
    return candidates.orderBy(path_parts("file"), "line", "column", "implementation")
