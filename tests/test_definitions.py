"""Files of plain definitions: results of their lines, moved, against a parse of the whole; rewrites of all sites in one call."""

import random

import pytest

from mutalake.functions.patterns import pattern_catalog
from mutalake.functions.rewrites import rewrite_targets
from mutalake.operators import discovery
from mutalake.operators.definitions import Definitions
from mutalake.plans.programs import FORMS

WHOLE = ["rust", "python", "javascript", "typescript", "go", "c_sharp"]
ODD = ["x = a < b && c > d;", "if a < b { c(); }", "foo<T>(a);", "} else {", "x = (;", "x);", "while (x);", "let o = { a: 1, b: 2 };", "function inner1() { return 1; }", "fn inner1() { b(); }", "a;b;", "where T: U;", "if x {", "s = 'a';", "-1;", "é();",
       "else: b()", "elif x: b()", "if x:", "x = [i for i in y if i > 0]", "def g1(): return 0", "return not x", "a \\", "x = 1  # 'a"]


def _text(language, rng, lines, functions):
    form = FORMS[language]
    indent = "    " if language == "python" else ""
    out = [form[1]]
    for _ in range(functions):
        body = [indent + x.strip() if x in ODD else x for x in (rng.choice(lines) for _ in range(rng.randint(0, 6)))]
        out += [form[2].replace("{}", str(rng.randint(0, 10**rng.randint(1, 9)))), form[3], *body, form[7]]
    return "\n".join([*out, form[8]])


@pytest.mark.parametrize("language", WHOLE)
def test_plain_files_match_the_whole(language):
    rng, automaton, parses = random.Random(7), discovery._automata(pattern_catalog())[language], []

    def parse(language, text):
        parses.append(text)
        return discovery._parsed(language, text, automaton)

    plain, forms = Definitions(parse, {language: automaton}), FORMS[language]
    for _ in range(60):
        text = _text(language, rng, forms[4:7], rng.randint(1, 6))
        assert plain.parsed(language, text) == discovery.parsed_text(language, text, automaton)
    assert len(parses) <= 8  # four lines, each once and twice a function, however many files hold them
    met = 0
    for _ in range(400):
        text = _text(language, rng, [*forms[4:7], *rng.sample(ODD, 2)], rng.randint(1, 3))
        found = plain.parsed(language, text)
        met += found is None
        assert found is None or found == discovery.parsed_text(language, text, automaton), text
    assert met


def test_texts_that_are_not_plain():
    plain = Definitions(lambda language, text: discovery._parsed(language, text, None), {})
    for text in ("", "fn f1() {\n    b();\n}", "/* \nfn f1() {\n    b();\n}\n", "fn f1() {\n    b('}');\n}\n", "fn f1() {\n    b(); // x\n}\n", "fn f1() {\n    if x {\n    }\n}\n", "fn f1() {\n    b();\n}\nstruct S;"):
        assert plain.parsed("rust", text) is None
    assert plain.parsed("java", "class A {\n}") is None
    assert plain.parsed("rust", "fn f1() {\n    b();\n}\n") == discovery.parsed_text("rust", "fn f1() {\n    b();\n}\n", None)


def test_discover_parses_languages_with_patterns_alone(spark):
    rows = [("a.rs", "rust", "fn f1() {\n    if a < 1 { b(); }\n}\n"), ("A.java", "java", "class A {\n    static void f() {\n    if (a < 1) { b(); }\n    }\n}")]
    sources = spark.createDataFrame(rows, "file string, language string, text string")
    assert {r.file for r in discovery.discover(sources).select("file").collect()} == {"a.rs"}
    assert {r.file for r in discovery.scan_programs(sources).select("file").collect()} == {"a.rs", "A.java"}
    assert discovery.discover(sources, {}).count() == 0


def test_scanners_take_one_call(spark):
    rows = [("rust.swap_boolean", "true"), ("python.dict_get_to_index", "d.get(x)"), ("python.sorted_reverse_flip", "sorted(x)"), ("python.truthiness_negation", "not x"), ("rust.negate_predicate_method", "a.is_empty()"), ("rust.integer_zero_one", "7"), ("python.dict_get_to_index", None)]
    out = rewrite_targets(spark.createDataFrame(rows, "implementation string, original string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    found = {r.implementation: r.replacement for r in out.collect()}
    assert found == {"rust.swap_boolean": "false", "python.dict_get_to_index": "d[x]", "python.sorted_reverse_flip": found["python.sorted_reverse_flip"], "python.truthiness_negation": "x", "rust.negate_predicate_method": "!a.is_empty()"}
