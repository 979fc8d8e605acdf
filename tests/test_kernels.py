"""Small cases of the kernels: formulas, edges, ties and empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from mutalake.functions import catalog, scanners
from mutalake.functions.blake3 import blake3, blake3_many
from mutalake.operators import edits, outcomes, scoring, selection
from mutalake.plans import reports
from mutalake.sources import coverage, files


def test_catalog_sizes():
    assert len(catalog.OPERATORS) == 54 and len(catalog.implementations()) == 107 and len(catalog.LANGUAGES) == 23
    assert len({x[0] for x in catalog.implementations()}) == 107


def test_crap_values(spark):
    rows = spark.createDataFrame([(6, 0.0), (6, 100.0), (6, 200.0)], "c int, v double").select(scoring.crap(F.col("c"), F.col("v")).alias("x")).collect()
    assert [r.x for r in rows] == [42.0, 6.0, 6.0]


def test_span_coverage(spark):
    functions = spark.createDataFrame([("a", "f", 1, 4, 6), ("a", "g", 9, 9, 1), ("b", "h", 1, 9, 2), ("a", "f", 1, 4, 6)], "file string, function string, start_line int, end_line int, cyclomatic int")
    lines = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 5), ("a", 4, 0)], "file string, line int, hits int")
    rows = {(r.file, r.function): r.coverage for r in scoring.span_coverage(functions, lines).collect()}
    assert rows == {("a", "f"): 50.0, ("a", "g"): 100.0, ("b", "h"): 0.0}
    assert scoring.span_coverage(functions, lines).count() == 4
    assert scoring.score_functions(functions.limit(0), lines).count() == 0


@pytest.mark.parametrize(("n", "groups"), [(1, "h"), (2, "hm"), (3, "hml"), (4, "hmll"), (5, "hmmll")])
def test_thirds(spark, n, groups):
    rows = spark.createDataFrame([(float(n - i), "a", str(i)) for i in range(n)], "priority_score double, file string, function string")
    got = outcomes.priority_groups(rows).orderBy("position").collect()
    assert "".join(r.priority_group[0] for r in got) == groups


@pytest.mark.parametrize(("values", "score"), [((None, None, None), -80), ((10, 75.0, 25.0), 200), ((10, 0.0, 25.0), 70), ((20, 95.0, 90.0), -50)])
def test_actionable(spark, values, score):
    row = spark.createDataFrame([values], "cyclomatic int, coverage double, crap double").select(selection.actionable_score().alias("s")).first()
    assert row.s == score


def test_canonical_edit(spark):
    rows = spark.createDataFrame([("true", "false", 10), ("é==", "é!=", 0), ("a", "a", 3), ("aa", "a", 0), ("", "x", 5)], "original string, replacement string, start_byte long")
    got = [(r.edit_start, r.edit_end, r.edit_text) for r in edits.canonical_edit(rows).collect()]
    assert got == [(10, 13, "fals"), (2, 3, "!"), (4, 4, ""), (1, 2, ""), (5, 5, "x")]


def test_dedupe_keeps_the_stronger_operator(spark):
    rows = [("f", "swap_boolean", 0, 4, "true", "false"), ("f", "return_boolean", 1, 4, "true", "false"), ("f", "some_boolean", 2, 4, "true", "false")]
    df = spark.createDataFrame(rows, "file string, operator string, discovery_seq int, start_byte long, original string, replacement string")
    assert [r.operator for r in edits.dedupe_overlapping(df).collect()] == ["return_boolean"]


def test_splice_rejects_a_wrong_span(spark):
    df = spark.createDataFrame([("aéb", 1, 3, "é", "x"), ("aéb", 1, 3, "e", "x"), ("ab", 1, 9, "b", "x")], "text string, start_byte int, end_byte int, original string, replacement string")
    assert [r.mutated_text for r in edits.splice(df).collect()] == ["axb", None, None]


def test_nested_functions(spark):
    functions = spark.createDataFrame([("a", 0, 100), ("a", 10, 50), ("a", 20, 30)], "file string, start_byte int, end_byte int")
    branches = spark.createDataFrame([("a", 5), ("a", 15), ("a", 25), ("a", 26), ("a", 100)], "file string, at int")
    assert {r.start_byte: r.cyclomatic for r in scoring.attribute_branches(functions, branches).collect()} == {0: 2, 10: 2, 20: 3}


def test_suffix_match_prefers_exact_then_longest(spark):
    sources = spark.createDataFrame([("src/a.rs",), ("b.rs",), ("./c/d.rs",), ("x/z.rs",)], "file string")
    covered = spark.createDataFrame([("src/a.rs",), ("app/src/a.rs",), ("p/b.rs",), ("k/b.rs",), ("c/d.rs",), ("y/z.rs",)], "file string")
    got = {r.file: r.coverage_file for r in scoring.match_files(sources, covered).collect()}
    assert got == {"src/a.rs": "src/a.rs", "b.rs": "k/b.rs", "./c/d.rs": "c/d.rs"}


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "seq long, file string, function string, operator string, status string")
    assert outcomes.run_totals(none).first().mutation_score is None
    assert outcomes.operator_summary(none).count() == 0 and outcomes.exit_code(none).first().exit_code == 0


def test_status_classes(spark):
    rows = spark.createDataFrame([(False, 0, False), (False, 1, False), (True, None, False), (False, None, True), (False, None, False)], "t boolean, e int, f boolean")
    assert [r.s for r in rows.select(outcomes.classify(F.col("t"), F.col("e"), F.col("f")).alias("s")).collect()] == ["survived", "killed", "timeout", "error", "killed"]


def test_blake3_many_is_each():
    rows = [bytes((i + j) % 251 for j in range(n)) for i, n in enumerate([0, 1, 63, 64, 65, 128, 129, 170, 1000, 1024, 1025, 3000])]
    assert blake3_many(rows) == [blake3(x) for x in rows] and blake3_many([]) == []


def test_blake3_published_values():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert len({blake3(bytes(i % 251 for i in range(n))) for n in (1, 64, 65, 1024, 1025, 3000)}) == 6


def test_seed_prefix_and_order_independence(spark):
    rows = [(f"m{i}", "a.rs", "f", "op", i, i, i + 1, "a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, file string, function string, operator string, discovery_seq int, start_byte int, end_byte int, original string, replacement string")
    scores = spark.createDataFrame([], "file string, function string, cyclomatic int, coverage double, crap double, scan_seq int")
    plan = lambda d, k: [r.id for r in selection.plan(d, scores, seed="s", limit=k).orderBy("plan_index").collect()]
    assert plan(df, 5) == plan(df.orderBy(F.desc("id")), 9)[:5]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (scanners.dict_get_default_removal, "d.get(f(a, b), 2)", "d.get(f(a, b))"), (scanners.dict_get_default_removal, "d.get(a)", None), (scanners.dict_get_to_index, "d.get(k)", "d[k]"), (scanners.dict_get_to_index, "d.get()", None),
        (scanners.empty_collection_literal, "{'a:b', c}", "set()"), (scanners.empty_collection_literal, "{**a}", "{}"), (scanners.empty_collection_literal, "[ ]", None),
        (scanners.sorted_reverse_flip, "sorted(x)", "sorted(x, reverse=True)"), (scanners.sorted_reverse_flip, "sorted(x, reverse=True)", "sorted(x, reverse=False)"),
        (scanners.nullish_coalescing_removal, "f(a ?? b) ?? c", "f(a ?? b)"), (scanners.ternary_arm_swap, "a ? b ? 1 : 2 : c", "a ? c : b ? 1 : 2"), (scanners.ternary_arm_swap, "a?.b ?? c", None),
        (scanners.nullable_access_to_member_access, "'a?.b' + x?.y", "'a?.b' + x.y"), (scanners.is_pattern_negation, "a is b is c", "a is b is not c"), (scanners.is_pattern_negation, "x is not T", "x is T"),
        (scanners.as_expression_to_direct_cast, "a + b as T", "(T)(a + b)"), (scanners.as_expression_to_direct_cast, "a as T", "(T)a"), (scanners.is_pattern_negation, "(a)is T", "(a) is not T"), (scanners.is_pattern_negation, "x is(T)", "x is not (T)"), (scanners.is_pattern_negation, "x is not(T)", "x is (T)"),
        (scanners.is_pattern_negation, "island", None), (scanners.as_expression_to_direct_cast, "f(x as Y)", None), (scanners.dict_get_default_removal, "d.get(`a, b`)", "d.get(`a)"),
    ],
)
def test_scanners(f, text, want):
    assert f(text) == want


def test_macro_ranges():
    text = 'fn f() { assert!(x(1)); // panic!()\n "todo!()"; println!("{}", vec![1]) }'
    assert [(n, text[a:b]) for n, a, b in edits.macro_ranges(text)] == [("assert", "x(1)"), ("println", '"{}", vec![1]')]
    deep = "m!(" * 3 + "assert!{ x }" + ")" * 3
    assert [(n, deep[a:b]) for n, a, b in edits.macro_ranges(deep)] == [("m", "m!(m!(assert!{ x }))")]
    long = "a" * 300 + "!(b) c!(d"
    assert [(len(n), long[a:b]) for n, a, b in edits.macro_ranges(long)] == [(300, "b")]


def test_skip_order(spark):
    sources = spark.createDataFrame([("tests/a.rs", "// @generated\n"), ("tests/b.rs", "x"), ("src/c.rs", "x")], "file string, text string")
    macros = spark.createDataFrame([("src/c.rs", 0, 50, "assert"), ("src/c.rs", 10, 20, "panic"), ("src/c.rs", 30, 40, "format")], "file string, s int, e int, name string")
    edits_ = spark.createDataFrame([("tests/a.rs", 1), ("tests/b.rs", 1), ("src/c.rs", 5), ("src/c.rs", 15), ("src/c.rs", 35), ("none.rs", 1)], "file string, start_byte int")
    got = {(r.file, r.start_byte): r.skip_rule for r in edits.skip_rules(edits_, sources, macros).collect()}
    assert got == {("tests/a.rs", 1): "generated_file", ("tests/b.rs", 1): "test_file", ("src/c.rs", 5): "assertion_macro", ("src/c.rs", 15): "panic_macro", ("src/c.rs", 35): None, ("none.rs", 1): None}


def test_coverage_readers(spark, tmp_path):
    (tmp_path / "a.info").write_text("DA:9,9\nSF:src/a.rs\nDA:1,2\nDA:1,3\nBRDA:1,0,0,1\nDA:2,0\nend_of_record\nDA:3,1\n")
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="b.py"><lines><line number="1" hits="2"/><line number="1" hits="5"/><line number="x" hits="1"/></lines></class></classes></package></packages></coverage>')
    (tmp_path / "j.xml").write_text('<report><package name="p"><sourcefile name="C.java"><line nr="3" ci="2"/><line nr="3" ci="0"/><line nr="4" ci="1"/></sourcefile></package></report>')
    (tmp_path / "cover.out").write_text("mode: set\nm/x.go:1.1,3.2 2 1\nm/x.go:2.1,2.9 1 4\nm/x.go:9.1,8.2 1 1\nbad\n")
    rows = lambda *specs: {(r.file, r.line): r.hits for r in coverage.read_coverage(spark, *specs).collect()}
    assert rows(str(tmp_path / "a.info")) == {("src/a.rs", 1): 5, ("src/a.rs", 2): 0}
    assert rows(f"cobertura:{tmp_path}/c.xml") == {("b.py", 1): 5}
    assert rows(f"{tmp_path}/j.xml") == {("p/C.java", 3): 0, ("p/C.java", 4): 1}
    assert rows(f"go:{tmp_path}/cover.out") == {("m/x.go", 1): 1, ("m/x.go", 2): 4, ("m/x.go", 3): 1}
    assert rows(f"{tmp_path}/a.info", f"lcov:{tmp_path}/a.info") == {("src/a.rs", 1): 10, ("src/a.rs", 2): 0}
    assert coverage.parse_spec("C:/x.info") == (None, "C:/x.info") and rows() == {}
    with pytest.raises(ValueError):
        coverage.detect_format("x.txt", "hello")
    assert coverage.detect_format("X.INFO", "") == "lcov" and coverage.detect_format("a.txt", "\n mode: set") == "go" and coverage.detect_format("r.XML", "<report>") == "jacoco"
    with pytest.raises(ValueError):
        coverage.detect_format("mycoverage.out", "x")


def test_sources(spark, tmp_path):
    for name in ("a.py", "sub/b.rs", ".hidden/c.py", "target/d.rs", "e.txt", "gen/f.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    got = {r.file: r.language for r in files.read_sources(spark, str(tmp_path), files.ignore_lines("# no\n/gen\n\n")).collect()}
    assert got == {"a.py": "python", "sub/b.rs": "rust"}


def test_context(spark):
    row = spark.createDataFrame([("a\nb\nc\n", 3)], "t string, l int").select(reports.context(F.col("t"), F.col("l"), 1).alias("x"), reports.context(F.col("t"), F.col("l"), 0).alias("z")).first()
    assert (row.x.start_line, row.x.end_line, row.x.snippet) == (2, 3, "     2 | b\n>    3 | c\n") and row.z is None


def test_score_tasks_grow_with_rows(spark, monkeypatch):
    """Every shuffle of the scores has as many tasks as their rows need; rows and their order stay."""
    from conftest import SF

    from mutalake.functions import session
    from mutalake.plans import registry

    names = ("crap_score", "crap_without_coverage", "coverage_merge_sum", "coverage_merge_last")
    shuffles = lambda df: {int(n) for n in re.findall(r"Exchange (?:hash|range)partitioning\(.*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
    before = {name: registry.QUERIES[name](spark, SF) for name in names}
    assert all(shuffles(df) == {4} for df in before.values())
    monkeypatch.setattr(session, "ROWS", 1_000)
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1_000)
    for name in names:
        df = registry.QUERIES[name](spark, SF)
        assert tasks > 4 and shuffles(df) == {tasks}
        assert df.collect() == before[name].collect() if name == "crap_score" else sorted(df.collect()) == sorted(before[name].collect())
