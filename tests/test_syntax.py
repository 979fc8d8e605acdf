"""Parsing, complexity, patterns and candidates, on snippets of all languages."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest

from mutalake.functions.catalog import enabled_operators
from mutalake.functions.patterns import node, parse_pattern, pattern_catalog, token
from mutalake.operators import discovery
from mutalake.plans.cases import CASES, COMPLEXITY, WRAP
from mutalake.syntax import lexer, parsers
from mutalake.syntax.languages import RULES
from mutalake.syntax.table import languages, tree

SOURCES = "file string, language string, text string"

def test_all_languages_are_here():
    assert sorted(COMPLEXITY) == languages() and len(languages()) == 23


@pytest.fixture(scope="module")
def scanned(spark):
    table = spark.createDataFrame([(k, k, text) for k, (text, *_) in COMPLEXITY.items()], SOURCES)
    out = collections.defaultdict(list)
    for r in discovery.scan_programs(table).collect():
        out[r.language].append(r)
    return out


@pytest.mark.parametrize("language", sorted(COMPLEXITY))
def test_complexity(scanned, language):
    _, named, anonymous = COMPLEXITY[language]
    got = {r.function: r.cyclomatic for r in scanned[language] if not r.function.startswith("<anonymous>:")}
    if language == "erlang":  # clauses of one name are functions of their own
        assert sorted(r.cyclomatic for r in scanned[language] if r.function == "a") == [1, 8]
    else:
        assert got == named
    assert sorted(r.cyclomatic for r in scanned[language] if r.function.startswith("<anonymous>:")) == sorted(anonymous)


def test_every_implementation_has_a_case():
    assert sorted(CASES) == sorted(pattern_catalog()) and len(CASES) == 107


@pytest.fixture(scope="module")
def discovered(spark):
    rows = [(f"{impl}/{k}", impl.split(".")[0], WRAP[impl.split(".")[0]] % case[at]) for impl, case in CASES.items() for k, at in (("hit", 0), ("miss", 3))]
    out = collections.defaultdict(set)
    for r in discovery.discover(spark.createDataFrame(rows, SOURCES).repartition(4)).collect():
        out[r.file, r.implementation].add((r.original, r.replacement))
    return out


@pytest.mark.parametrize("impl", sorted(CASES))
def test_implementation(discovered, impl):
    _, original, replacement, _ = CASES[impl]
    assert (original, replacement) in discovered[f"{impl}/hit", impl] or impl.endswith(".swap_boolean")
    assert not discovered[f"{impl}/miss", impl]


def test_candidates_in_full(spark):
    text = "fn é() {\n    let c = |x| x == 1; // ==\n    if a > 0 { Some(true) }\n}\n"
    table = spark.createDataFrame([("src/a.rs", "rust", text), ("src/empty.rs", "rust", ""), ("src/null.rs", "rust", None), ("x.md", "markdown", "a == b")], SOURCES)
    got = discovery.discovery_order(discovery.discover(table)).collect()
    raw = text.encode()
    assert all(raw[r.start_byte : r.end_byte].decode() == r.original for r in got)
    assert [(r.id, r.function, r.original) for r in got][:2] == [("src/a.rs:2:18:rust.negate_equality", "é", "=="), ("src/a.rs:2:21:rust.integer_zero_one", "é", "1")]
    assert {(r.operator, r.replacement) for r in got if r.line == 3} == {("comparison_boundary", ">="), ("comparison_negation", "<="), ("integer_zero_one", "1"), ("some_boolean", "false"), ("option_some_none", "None")}
    only = discovery.discover(table, operators=enabled_operators(spark), overrides={"rust.integer_zero_one": True, "rust.comparison_negation": False})
    assert {r.operator for r in only.collect()} == {"negate_equality", "integer_zero_one", "comparison_boundary", "some_boolean"}


def test_own_patterns(spark):
    """A caller adds an implementation of its own, written as a pattern or as text."""
    mine = parse_pattern('(call_expression function: (identifier) @name arguments: (arguments (_) @target .) (#any-of? @name "push" "pop"))')
    assert mine == [node("call_expression", node("identifier", texts=("push", "pop"), field="function"), node("arguments", node("", last=True, target=True), field="arguments"))]
    assert parse_pattern('[(a) (b)] @target') == [node("a b").aim] or len(parse_pattern('[(a) (b)] @target')) == 2
    assert parse_pattern('(x "=="  @target (y)?)') == [node("x", token("==", target=True), node("y", optional=True))]
    table = spark.createDataFrame([("a.rs", "rust", "fn f() { push(a, b + c); push(); put(d) }")], SOURCES)
    sites = discovery.candidate_sites(table, {"rust.mine": mine}).collect()
    assert [(r.start_byte, r.end_byte) for r in sites] == [(17, 22)]


def test_odd_texts(spark):
    """No text stops the parser: broken syntax, unclosed marks, deep nesting, nulls."""
    odd = ["", "}}}}", "((((", '"', "'", "/*", "`${", "fn", "def f(", "class", "if if if", "\x00", "é" * 10, "{" * 3000, "(" * 3000 + ")" * 3000, "a ? b : " * 500, "x" * 100_000, "a.b()" * 300, "<" * 500, "=>" * 100, "@ # $ \\"]
    rows = [(f"{language}/{k}", language, text) for language in languages() for k, text in enumerate(odd)]
    assert discovery.parse_sources(spark.createDataFrame(rows, SOURCES).repartition(8), pattern_catalog()).count() == len(rows)


@pytest.mark.parametrize("language", sorted(parsers.PARSERS))
def test_tree_covers_tokens(language):
    """Leaves come in order, none twice, and no token but separators of lines is lost."""
    text = COMPLEXITY[language][0]
    leaves = []

    def walk(n):
        assert all(n.start <= c.start and c.end <= n.end for c in n.children)
        if not n.children and n.end > n.start and n.kind not in ("member_binding_expression",):
            leaves.append((n.start, n.end))
        for c in n.children:
            walk(c)

    walk(tree(language, text))
    assert leaves == sorted(set(leaves))
    found = {(t.start, t.end) for t in lexer.tokens(text, RULES[language]) if t.kind not in (lexer.LINE, lexer.STRING) and t.text not in (":", ";", "?.")}
    assert len(found - set(leaves)) <= 0.02 * len(found)


def test_own_points():
    starts, ends = np.array([0, 10, 12, 10, 50]), np.array([40, 30, 20, 30, 60])
    points = np.array([5, 11, 13, 19, 25, 35, 55, 70])
    assert discovery.own_points(starts, ends, points).tolist() == [2, 2, 2, 2, 1]


@pytest.mark.parametrize(("language", "form", "function"), [
    ("rust", "impl A { pub const fn a() {} fn b() {} fn c() { x; } fn d() {} }", "abcd"),
    ("rust", 'extern "C" { fn q(); }\nextern "C" fn a() {}\npub(crate) const unsafe extern "C" fn b<T>(x: T) -> u8 { 1 }\nconst X: u8 = 1;\nasync fn c() {}\nunsafe impl Z for Y {}\ndefault fn d() {}\nconst fn e() {}', "abcde"),
    ("javascript", "x = { async *a() {}, *b() {}, async c() {}, get d() { return 1 }, async: 1, get: 2, [x]() {}, async [y]() {}, e() {} }; class A { async *f() {} *g() {} static async *h() {} }", "abcdefgh"),
    ("c_sharp", "class A { public static A operator +(A a, A b) => a; public static implicit operator int(A a) => 1; public static bool operator ==(A a, B b) { return 1; } int a(int q) => q; public static A operator checked -(A a) => a; static explicit operator List<int>(A a) { return a; } List<int> b<T>() where T : A {} }", "ab"),
])
def test_function_forms(language, form, function):
    found, _ = discovery.parsed_text(language, form, None)
    assert [f[0] for f in found] == list(function)


def test_visibility_belongs_to_a_function():
    found, _ = discovery.parsed_text("rust", "#[x]\npub(crate) const fn a() {}", None)
    assert [(f[0], f[1], f[3]) for f in found] == [("a", 2, 5)]


def test_operators_hold_decisions_of_no_function():
    found, sites = discovery.parsed_text("c_sharp", "class A { public static bool operator <(A a, A b) => a && b; int f() => 1; }", None)
    assert [(f[0], f[6]) for f in found] == [("f", 1)] and not sites


_LONG = [("c_sharp", "a\n"), ("c_sharp", "a<b,"), ("c_sharp", "public "), ("c_sharp", "a b() where "), ("c_sharp", "("), ("c_sharp", "a ? "), ("typescript", "a<b,"), ("typescript", "a?["), ("javascript", "! "), ("rust", "a<b,"), ("rust", "if a "), ("rust", "{"), ("go", "("), ("python", "("), ("bash", "(("), ("bash", "[[ "), ("bash", "case "),
         ("java", "a ? "), ("java", "-> "), ("c", "do "), ("cpp", "class A "), ("ruby", "if a "), ("dart", "a b() where "), ("erlang", "a -> "), ("php", "case a: "), ("swift", "do "), ("scala", "=> "), ("zig", "pub "), ("julia", "(for ")]


@pytest.mark.parametrize(("language", "piece"), _LONG)
def test_time_is_linear(language, piece):
    """Twice the text takes little more than twice the time: what looks ahead from each token looks once."""
    def took(size):
        began = time.process_time()
        discovery.parsed_text(language, piece * (size // len(piece)), None)
        return time.process_time() - began

    took(2000)
    small = max(took(60_000), 0.05)
    assert took(240_000) < 9 * small


def test_lexer_is_linear():
    text = '"a' * 50_000 + "/* x " * 50_000
    assert lexer.tokens(text, RULES["rust"])


def test_copies_of_short_texts_are_parsed_once(spark, monkeypatch):
    """A task parses a short text once for all its copies, and made cases are dealt to all tasks."""
    from mutalake.operators import discovery
    from mutalake.plans import cases

    seen = []
    parsed = discovery.parsed_text
    monkeypatch.setattr(discovery, "parsed_text", lambda language, text, automaton: seen.append(text) or parsed(language, text, automaton))
    rows = [(f"{i}.rs", "rust", f"fn f{i % 3}() {{ if a {{ b(); }} }}") for i in range(30)]
    runs = []

    class Sources:
        """Enough of a table to hand the batches to the function that Spark would run."""

        def __getattr__(self, name):
            return lambda *_: self

        def mapInArrow(self, run, schema):
            runs.append(run)
            return self

    discovery.parse_sources(Sources())
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["file", "language", "text"])
    made = [r for out in runs[0](iter([batch])) for r in out.to_pylist()]
    assert len(seen) == 3 and [(r["file"], r["functions"][0]["function"]) for r in made] == [(f"{i}.rs", f"f{i % 3}") for i in range(30)]
    for sources in (cases.case_sources, cases.complexity_sources):
        assert sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_lexing_matches_a_plain_scan_of_gaps():
    """Tokens keep their text and place, and what lies between them is white space or a comment."""
    from mutalake.syntax.lexer import LINE, tokens

    odd = "\t a  =b /2/ c // x\n  \"s \\\" t\" + 1.5e3\r\n\n   (x)   y /* z\n */ 'q' /r[/]e/g  \n \t "
    for rules in RULES.values():
        assert rules.pattern.match(" \t x").end() == 4  # one look a token
        at = 0
        for t in tokens(odd, rules):
            assert at <= t.start < t.end or t.kind == LINE
            if t.kind != LINE:
                assert odd[t.start : t.end] == t.text and not t.text[0].isspace()
                line = odd.rfind("\n", 0, t.start) + 1
                assert t.indent == -1 or t.indent == t.start - line
                assert t.apart or at == t.start
            at = t.end


def test_parsing_leaves_no_cycles(spark):
    """Collection of cycles pauses while a text is parsed, and goes on behind it."""
    import gc

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"on": [gc.isenabled()]})

    source = spark.createDataFrame([("a.rs", "rust", "fn a() { if x < 1 { b(); } }\n" * 400)], "file string, language string, text string")
    assert discovery.scan_programs(source).count() == 400
    assert all(r["on"] for r in spark.range(0, 16, 1, 16).mapInArrow(run, "on boolean").collect())
    gc.collect()
    gc.disable()
    try:
        discovery.parsed_text("python", "def a(x):\n    return [k for k in x if k > 1]\n" * 200, discovery._automata(pattern_catalog())["python"])
        assert gc.collect() < 2000  # a tree of some 5,000 nodes is gone without it
    finally:
        gc.enable()
