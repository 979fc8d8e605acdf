"""The automaton against all assignments of parts to children, and what a caller may write."""

import itertools
import random

import pytest

from mutalake.functions.patterns import Pattern, node, parse_pattern, token
from mutalake.operators import discovery
from mutalake.syntax.automaton import Automaton
from mutalake.syntax.nodes import Node, in_order
from mutalake.syntax.table import syntax_nodes, tree

SOURCES = "file string, language string, text string"


def all_targets(n, p, text):
    """Every child sequence tried: the targets of each way in which a pattern matches at a node; None if it doesn't."""
    own = text[n.start : n.end]
    if n.named != p.named or p.kinds and n.kind not in p.kinds or p.texts and (own in p.texts) == p.denied:
        return None
    found, matched = set(), False
    parts = [x for x in p.parts if not x.optional]
    named = [i for i, k in enumerate(n.children) if k.named]
    for way in itertools.combinations(range(len(n.children)), len(parts)):
        inner = []
        for j, (i, x) in enumerate(zip(way, parts, strict=True)):
            kid, before = n.children[i], way[j - 1] if j else -1
            got = all_targets(kid, x, text)
            if got is None or x.field and kid.field != x.field or x.last and i != max(named, default=-1) or x.next and any(before < k < i for k in named):
                break
            inner.append({(kid.start, kid.end)} if x.target else got)
        else:
            matched = True
            found |= set().union(*inner)
    return found if matched else None


def random_tree(rng, at, depth):
    if not depth or rng.random() < 0.25:
        return Node(rng.choice("abc"), at, at + 1, named=rng.random() < 0.7, field=rng.choice([None, None, "f", "g"])), at + 1
    kids, end = [], at
    for _ in range(rng.randint(1, 4)):
        kid, end = random_tree(rng, end, depth - 1)
        kids.append(kid)
    return Node(rng.choice("abc"), at, end, kids, field=rng.choice([None, "f"])), end


def random_pattern(rng, depth, aim):
    kinds = tuple(sorted(rng.sample("abc", rng.choice([0, 1, 1, 2]))))
    parts = []
    if depth and (aim or rng.random() < 0.6):
        n = rng.randint(1, 3)
        where = rng.randrange(n) if aim and rng.random() < 0.8 else -1
        parts = [random_pattern(rng, depth - 1, i == where) for i in range(n)]
        aim = aim and where < 0
    options = {"field": rng.choice([None, None, None, "f"]), "next": rng.random() < 0.25, "last": rng.random() < 0.15, "texts": ("x",) if rng.random() < 0.1 else (), "denied": rng.random() < 0.5, "named": bool(parts) or rng.random() < 0.8}
    return Pattern(kinds or (() if options["named"] else ("a",)), tuple(parts), target=aim, **options)


def test_automaton_matches_all_assignments():
    rng = random.Random(5)
    hits = 0
    for _ in range(1500):
        root, n = random_tree(rng, 0, 4)
        text = "".join(rng.choice("xyz") for _ in range(n))
        patterns = [p for p in (random_pattern(rng, 3, True) for _ in range(4)) if p.has_target]
        automaton = Automaton([(str(i), p) for i, p in enumerate(patterns)])
        order = in_order(root)
        automaton.run(order, text)
        for x in order:
            got = {}
            for name, t in automaton.found(x):
                got.setdefault(name, set()).add((t.start, t.end))
            for i, p in enumerate(patterns):
                want = all_targets(x, p, text)
                if want is not None and p.target:
                    want = {(x.start, x.end)}
                assert got.get(str(i), set()) == (want or set())
                hits += bool(want)
    assert hits > 500


RUST = "fn f() { g(a, b, c); h(\"s\", [1, [2, [3]]]); if x { return Some(true); } k(p.q.r()); }"


@pytest.mark.parametrize(("pattern", "found"), [
    ("(arguments . (identifier) @target)", ["a"]),
    ("(arguments (identifier) @target .)", ["c"]),
    ("(arguments (identifier) . (identifier) @target)", ["b", "c"]),
    ("(arguments (identifier) @target . (identifier) .)", ["b"]),
    ("(arguments . (identifier) . (identifier) . (identifier) @target .)", ["c"]),
    ("(array_expression (array_expression (array_expression (integer_literal) @target)))", ["3"]),
    ("(call_expression (arguments (array_expression (array_expression (array_expression) @target))))", ["[3]"]),
    ('((call_expression function: (identifier) @name) @target (#eq? @name "g"))', ["g(a, b, c)"]),
    ('((call_expression) @target (#match? @target "Some\\\\(t"))', ["Some(true)"]),
    ('((call_expression) @target (#eq? @target "p.q.r()"))', ["p.q.r()"]),
    ('((identifier) @target (#not-any-of? @target "a" "b" "c" "f" "g" "h" "k" "x" "p"))', ["Some"]),
    ('(call_expression arguments: (arguments [(string_literal) (identifier)] @target .))', ["c"]),
    ('(call_expression function: (identifier) arguments: (arguments [(string_literal) @target (identifier)] . (array_expression)))', ["\"s\""]),
    ("(return_expression (_) @target)", ["Some(true)"]),
])
def test_patterns_of_a_caller(pattern, found):
    automaton = Automaton([("x", p) for p in parse_pattern(pattern) if p.has_target])
    order = in_order(tree("rust", RUST))
    automaton.run(order, RUST)
    assert [RUST[t.start : t.end] for n in order for _, t in automaton.found(n)] == found


@pytest.mark.parametrize("pattern", ["(a", "(a (b)* @target)", "((a) (b) @target)", "(a !field @target)", "(a .)", "(a @x (#eq? @x @y) @target)", "(a (#is? @x \"y\"))", ")", "[(a)"])
def test_what_is_not_supported_says_so(pattern):
    with pytest.raises(ValueError):
        parse_pattern(pattern)


def test_sites_and_functions_leave_in_one_parse(spark):
    table = spark.createDataFrame([("a.rs", "rust", RUST), ("b.rs", "rust", "x == y; fn g() { 1 == 2 }"), ("n.rs", "rust", None)], SOURCES)
    parsed = {r.file: r for r in discovery.parse_sources(table, {"rust.negate_equality": [node("binary_expression", token("==", target=True))]}).collect()}
    assert set(parsed) == {"a.rs", "b.rs"} and not parsed["a.rs"].sites and [f.function for f in parsed["a.rs"].functions] == ["f"]
    assert [(s.function, s.original, s.before, s.line, s.column) for s in parsed["b.rs"].sites] == [(None, "==", " ", 1, 2), ("g", "==", " ", 1, 19)]
    assert parsed["a.rs"].functions[0].cyclomatic == 2


def test_nodes_carry_their_children(spark):
    table = spark.createDataFrame([("a.rs", "rust", "fn f() { a == b }")], SOURCES)
    rows = {r.node: r for r in syntax_nodes(table).collect()}
    kids = {r.node: [k.kind for k in r.kids] for r in rows.values()}
    assert all([rows[c].kind for c in sorted(rows) if rows[c].parent == n] == kids[n] for n in rows) and rows[0].parent == -1
