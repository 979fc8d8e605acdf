"""Patterns over syntax nodes, and the patterns of all mutation implementations.

A pattern names kinds of a node, its field, texts it may have, and parts that its children must
match in order, to any depth; one part is the target. syntax.automaton matches all patterns of a
language at once while a text is parsed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from mutalake.functions.catalog import implementations


@dataclass(frozen=True)
class Pattern:
    #: Kinds of the node; empty for any named node.
    kinds: tuple[str, ...] = ()
    parts: tuple[Pattern, ...] = ()
    field: str | None = None
    #: Texts of the whole node: any of these, or a regular expression; denied, none of them.
    texts: tuple[str, ...] = ()
    like: str | None = None
    denied: bool = False
    #: Whether it is a named node; tokens have their text as kind.
    named: bool = True
    target: bool = False
    #: Whether no named child may stand between it and the part before it, or before it at all; whether it must be the last named child.
    next: bool = False
    last: bool = False
    #: Whether it may be missing.
    optional: bool = False

    def at(self, field: str) -> Pattern:
        return replace(self, field=field)

    @property
    def aim(self) -> Pattern:
        return replace(self, target=True)

    @property
    def has_target(self) -> bool:
        return self.target or any(p.has_target for p in self.parts)


def node(kinds: str = "", *parts: Pattern, **options) -> Pattern:
    """A named node of one of the kinds (separated by spaces) with these parts."""
    return Pattern(tuple(kinds.split()), parts, **options)


def token(*texts: str, **options) -> Pattern:
    """An unnamed token with one of the texts."""
    return Pattern(texts, named=False, **options)


_ANY = node()
_COMPARE, _EQUAL = ("<", ">", "<=", ">="), ("==", "!=")


def _operator(kinds: str, *texts: str) -> Pattern:
    return node(kinds, token(*texts, target=True))


def _rust_method(*names: str, **options) -> Pattern:
    """The name of a called method."""
    return node("call_expression", node("field_expression", node("field_identifier", texts=names, field="field", target=True), field="function"), **options)


def _method_call(call: str, member: str, name: str, field: str, names: tuple[str, ...], *more: Pattern) -> Pattern:
    """A whole call of one of the methods."""
    return node(call, node(member, node(name, texts=names, field=field), field="function"), *more, target=True)


_JS_ARGUMENTS = node("arguments", _ANY, field="arguments")
_PY_ARGUMENTS = [node("argument_list", _ANY, field="arguments"), node("generator_expression", field="arguments")]


def _js_method(*names: str) -> Pattern:
    return node("call_expression", node("member_expression", node("property_identifier", texts=names, field="property", target=True), field="function"), _JS_ARGUMENTS)


def _py_builtin(*names: str) -> list[Pattern]:
    return [node("call", node("identifier", texts=names, field="function", target=True), x) for x in _PY_ARGUMENTS]


# Operator to the patterns of each language; a key may name several languages. What they match is fixed.
_SCRIPT = "javascript typescript"
_PATTERNS: dict[str, dict[str, list[Pattern]]] = {
    "comparison_boundary": {"rust c_sharp javascript typescript go": [_operator("binary_expression", *_COMPARE)], "python": [_operator("comparison_operator", *_COMPARE)]},
    "comparison_negation": {"rust c_sharp javascript typescript": [_operator("binary_expression", *_COMPARE)], "python": [_operator("comparison_operator", *_COMPARE)]},
    "negate_equality": {"rust c_sharp go": [_operator("binary_expression", *_EQUAL)], _SCRIPT: [_operator("binary_expression", *_EQUAL, "===", "!==")], "python": [_operator("comparison_operator", *_EQUAL)]},
    "swap_logical": {"rust c_sharp javascript typescript go": [_operator("binary_expression", "&&", "||")], "python": [_operator("boolean_operator", "and", "or")]},
    "swap_boolean": {"rust c_sharp": [node("boolean_literal").aim], "python javascript typescript go": [node("true false").aim]},
    "remove_not": {"rust javascript typescript": [node("unary_expression", token("!")).aim], "c_sharp": [node("prefix_unary_expression", token("!")).aim]},
    "integer_zero_one": {"rust c_sharp": [node("integer_literal").aim], "python": [node("integer").aim], _SCRIPT: [node("number").aim], "go": [node("int_literal").aim]},
    "range_inclusive_exclusive": {"rust": [node("range_expression", token("..", "..=", target=True), node(last=True))]},
    "swap_predicate_method": {"rust": [_rust_method()]},
    "negate_predicate_method": {"rust": [_method_call("call_expression", "field_expression", "field_identifier", "field", ("is_empty", "contains", "starts_with", "ends_with"))], "python": [_method_call("call", "attribute", "identifier", "attribute", tuple("isdigit isdecimal isnumeric isalpha isalnum islower isupper isspace".split()), node("argument_list", field="arguments"))]},
    "return_boolean": {"rust": [node("return_expression", node("boolean_literal").aim)], "c_sharp": [node("return_statement", node("boolean_literal").aim)], "python javascript typescript": [node("return_statement", node("true false").aim)]},
    "is_none_negation": {"python": [node("comparison_operator", token("is", "is not", target=True), node("none"))]},
    "in_negation": {"python": [_operator("comparison_operator", "in", "not in")]},
    "truthiness_negation": {"python": [node("if_statement while_statement", _ANY.at("condition").aim)]},
    "len_zero_boundary": {"python": [node("comparison_operator", node("call", node("identifier", field="function")), node("integer")).aim]},
    "dict_get_default_removal": {"python": [node("call", node("attribute", node("identifier", field="attribute"), field="function"), node("argument_list", field="arguments")).aim]},
    "comprehension_filter_removal": {"python": [node("if_clause").aim]},
    "none_return": {"python": [node("return_statement", _ANY.aim)]},
    "empty_collection_literal": {"python": [node("list dictionary set").aim]},
    "iterator_any_all": {"rust": [_rust_method("any", "all")], "python": _py_builtin("any", "all"), _SCRIPT: [_js_method("some", "every")]},
    "match_bool_pattern": {"rust": [node("match_arm", node("match_pattern", node("boolean_literal").aim, field="pattern"))]},
    "ok_err_boolean": {"rust": [node("call_expression", node("identifier", texts=("Ok", "Err"), field="function"), node("arguments", node("boolean_literal").aim, field="arguments"))]},
    "some_boolean": {"rust": [node("call_expression", node("identifier", texts=("Some",), field="function"), node("arguments", node("boolean_literal").aim, field="arguments"))]},
    "option_some_none": {"rust": [node("call_expression", node("identifier", texts=("Some",), field="function"), node("arguments", _ANY, field="arguments")).aim]},
    "remove_try": {"rust": [node("try_expression").aim]},
    "unwrap_to_unwrap_or_default": {"rust": [_rust_method("unwrap")]},
    "min_max_swap": {"rust": [_rust_method("min", "max"), node("call_expression", node("identifier", texts=("min", "max"), field="function").aim)], "python": _py_builtin("min", "max")},
    "match_wildcard_to_panic": {"rust": [node("match_arm", node("match_pattern", token("_"), field="pattern"), _ANY.at("value").aim)]},
    "empty_vec_macro": {"rust": [node("macro_invocation", node("identifier", texts=("vec",), field="macro")).aim]},
    "saturating_checked_swap": {"rust": [_rust_method("checked_add", "checked_sub", "saturating_add", "saturating_sub")]},
    "expect_to_unwrap_or_default": {"rust": [_method_call("call_expression", "field_expression", "field_identifier", "field", ("expect",), node("arguments", _ANY, field="arguments"))]},
    "string_boundary_method_swap": {_SCRIPT: [_js_method("startsWith", "endsWith")]},
    "includes_negation": {_SCRIPT: [_method_call("call_expression", "member_expression", "property_identifier", "property", ("includes",), _JS_ARGUMENTS)]},
    "sorted_reverse_flip": {"python": [node("call", node("identifier", texts=("sorted",), field="function")).aim]},
    "dict_get_to_index": {"python": [_method_call("call", "attribute", "identifier", "attribute", ("get",), node("argument_list", field="arguments"))]},
    "nullish_coalescing_removal": {"c_sharp javascript typescript": [node("binary_expression", token("??")).aim]},
    "optional_chaining_removal": {"javascript": [node("member_expression call_expression subscript_expression", node("optional_chain")).aim], "typescript": [node("member_expression subscript_expression", node("optional_chain")).aim, node("call_expression", token("?.")).aim]},
    "ternary_arm_swap": {"c_sharp": [node("conditional_expression").aim], _SCRIPT: [node("ternary_expression").aim]},
    "ternary_condition_negation": {"c_sharp": [node("conditional_expression", _ANY.at("condition").aim)]},
    "array_empty_literal": {_SCRIPT: [node("array", _ANY).aim]},
    "object_empty_literal": {_SCRIPT: [node("object", _ANY).aim]},
    "string_empty_literal": {"c_sharp": [node("string_literal").aim], _SCRIPT: [node("string template_string").aim]},
    "await_removal": {_SCRIPT: [node("await_expression").aim]},
    "swap_arithmetic": {"c_sharp": [_operator("binary_expression", "+", "-", "*", "/", "%")]},
    "swap_assignment": {"c_sharp": [_operator("assignment_expression", "+=", "-=", "*=", "/=")]},
    "remove_unary_minus": {"c_sharp": [node("prefix_unary_expression", token("-")).aim]},
    "plus_to_minus": {"c_sharp": [_operator("prefix_unary_expression", "+")]},
    "null_forgiving_removal": {"c_sharp": [node("postfix_unary_expression", token("!")).aim]},
    "nullable_access_to_member_access": {"c_sharp": [node("conditional_access_expression").aim]},
    "is_pattern_negation": {"c_sharp": [node("is_expression is_pattern_expression").aim]},
    "as_expression_to_direct_cast": {"c_sharp": [node("as_expression").aim]},
    "checked_unchecked_swap": {"c_sharp": [_operator("checked_expression checked_statement", "checked", "unchecked")]},
    "throw_expression_to_null": {"c_sharp": [node("throw_expression").aim]},
    "default_literal_to_null": {"c_sharp": [node("default_expression").aim]},
}


def pattern_catalog(extra: dict[str, list[Pattern]] | None = None) -> dict[str, list[Pattern]]:
    """Implementation to its patterns; extra adds or replaces some. Patterns without a target are left out."""
    out = {}
    for impl, operator, language in implementations():
        out[impl] = next(found for langs, found in _PATTERNS[operator].items() if language in langs.split())
    return {impl: kept for impl, found in (out | (extra or {})).items() if (kept := [p for p in found if p.has_target])}


_QUERY = re.compile(r"""\s*(?:;[^\n]*|(?P<mark>[()\[\].?])|(?P<string>"(?:\\.|[^"\\])*")|(?P<capture>@[\w.]+)|(?P<predicate>\#[\w-]+\?)|(?P<word>[\w-]+)(?P<colon>:)?|(?P<other>\S))""")
_PREDICATES = {"eq", "any-of", "match"}


def parse_pattern(text: str) -> list[Pattern]:
    """Patterns written as nested lists: (kind field: (kind "token" @target . (_) .) [(a) (b)] (#eq? @name "text")).

    One list a pattern, or a group of one pattern and its predicates; alternatives give one pattern
    each. Predicates compare a captured node's whole text with texts: #eq? #any-of? #match?, also with not-.
    ValueError for what isn't written so, as repetitions, several patterns in a group or a field's absence.
    """
    words = [(m.lastgroup if m.lastgroup != "colon" else "field", (m.group("word") if m.lastgroup == "colon" else m.group(m.lastgroup))) for m in _QUERY.finditer(text) if m.lastgroup]
    at = 0

    def look() -> tuple[str, str]:
        if at >= len(words):
            raise ValueError(f"a bracket isn't closed: {text}")
        return words[at]

    def predicate() -> tuple[str, str, tuple[str, ...], bool]:
        nonlocal at
        name = look()[1][1:-1]
        at += 1
        values = []
        while look() != ("mark", ")"):
            values.append(words[at])
            at += 1
        at += 1
        if name.removeprefix("not-") not in _PREDICATES or len(values) < 2 or values[0][0] != "capture" or any(kind != "string" for kind, _ in values[1:]):
            raise ValueError(f"a predicate compares a capture with texts: #{name}?")
        return name.removeprefix("not-"), values[0][1], tuple(_unquoted(v) for _, v in values[1:]), name.startswith("not-")

    def read(field: str | None = None) -> tuple[list[Pattern], list]:
        """The alternatives that begin here, and the predicates inside."""
        nonlocal at
        kind, word = look()
        at += 1
        if kind == "field":
            return read(word)
        checks: list = []
        if kind == "string":
            found = [token(_unquoted(word))]
        elif word == "[":
            found = []
            while look() != ("mark", "]"):
                more, inner = read()
                found += more
                checks += inner
            at += 1
            if len(found) > 1 and len({(p.named, p.parts, p.texts) for p in found}) == 1 and not any(p.target for p in found):
                found = [replace(found[0], kinds=tuple(k for p in found for k in p.kinds))]
        elif word == "(" and look()[0] == "predicate":
            return [], [predicate()]
        elif word == "(":
            group = look()[1] in "([" and look()[0] == "mark"
            if not group:
                kinds, named = ((_unquoted(words[at][1]),), False) if words[at][0] == "string" else (() if words[at][1] == "_" else (words[at][1],), True)
                if words[at][0] not in ("string", "word"):
                    raise ValueError(f"unexpected {words[at][1]}")
                at += 1
            ways: list[list[Pattern]] = [[]]
            close = False
            while look() != ("mark", ")"):
                if words[at] == ("mark", "."):
                    at += 1
                    close = True
                    continue
                more, inner = read()
                checks += inner
                if more:
                    ways = [[*way, replace(p, next=close)] for way in ways for p in more]
                    close = False
            at += 1
            if group and (close or any(len(way) != 1 or way[0].next for way in ways)):
                raise ValueError("a group holds one pattern and its predicates")
            if close:
                if not ways[0]:
                    raise ValueError("an anchor needs a neighbour")
                ways = [[*way[:-1], replace(way[-1], last=True)] for way in ways]
            found = [way[0] for way in ways] if group else [Pattern(kinds, tuple(way), named=named) for way in ways]
        else:
            raise ValueError(f"unexpected {word}")
        while at < len(words) and words[at][0] in ("capture",) or at < len(words) and words[at] == ("mark", "?"):
            if words[at] == ("mark", "?"):
                found = [replace(p, optional=True) for p in found]
            elif words[at][1] == "@target":
                found = [p.aim for p in found]
            else:
                found = [replace(p, like=p.like or f"{words[at][1]}") for p in found]
            at += 1
        return [p.at(field) if field else p for p in found], checks

    def settle(p: Pattern, checks: dict) -> Pattern:
        """Captured names become what the predicates say of them."""
        found = checks.get("@target") if p.target else None
        if p.like and p.like.startswith("@"):
            found, p = checks.get(p.like, found), replace(p, like=None)
        if found:
            name, values, denied = found
            p = replace(p, like=values[0], denied=denied) if name == "match" else replace(p, texts=values, denied=denied)
        return replace(p, parts=tuple(settle(x, checks) for x in p.parts))

    out = []
    while at < len(words):
        found, checks = read()
        out += [settle(p, {of: (name, values, denied) for name, of, values, denied in checks}) for p in found]
    return out


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if text[:1] == '"' else text
