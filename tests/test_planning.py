"""Settings, git, plans, probes and rendered reports."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from mutalake import config
from mutalake.functions import catalog
from mutalake.operators import edits, outcomes, selection
from mutalake.plans import planning, probes, reports
from mutalake.sources import git


def test_config_is_strict():
    good = config.parse_config('[mutation]\nstrategy = "actionable"\nlimit = 3\n[probe]\ncommand = ["x"]\nenv = ["A={worker}"]\n')
    assert good == {"mutation.strategy": "actionable", "mutation.limit": 3, "probe.command": ["x"], "probe.env": ["A={worker}"]}
    for bad in ("[what]\nx = 1", "[mutation]\nx = 1", "[mutation]\nlimit = true", '[mutation]\nlimit = "3"', "[mutation]\nlimit = -1", '[mutation]\nstrategy = "best"', "[probe]\ncommand = [1]", "x = [", "scope = 1"):
        with pytest.raises(config.ConfigError):
            config.parse_config(bad)
    assert config.parse_config(config.starter("go"))["probe.command"] == ["go", "test", "./..."]


def test_layers(tmp_path):
    assert config.load_config(str(tmp_path)) == {}
    (tmp_path / config.FILE_NAME).write_text('[runner]\njobs = 2\n[probe]\nenv = ["TMPDIR=/own"]\n')
    with pytest.raises(config.ConfigError):
        config.preset_settings("python", str(tmp_path))
    (tmp_path / "setup.py").write_text("")
    preset = config.preset_settings("python", str(tmp_path))
    found = config.resolve({"runner.jobs": 4, "mutation.limit": None}, config.load_config(str(tmp_path)), preset)
    assert found["runner.jobs"] == 4 and found["mutation.strategy"] == "discovery" and found["probe.command"] == ["pytest"] and found["runner.warmup"] is True
    assert found["probe.env"] == ["TMPDIR=/own", "PYTHONPYCACHEPREFIX={build_cache}/pycache", "PYTEST_ADDOPTS=--cache-clear"] and "runner.warmup=True" in found.filled
    assert config.resolve({"runner.warmup": False}, {}, preset)["runner.warmup"] is False
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "yarn.lock").write_text("")
    assert config.preset_settings("node", str(tmp_path))["probe.command"] == ["yarn", "test"]


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / "src" / "a.py").write_text("def small(x):\n    return x < 1\n\n\ndef big(x):\n    if x and x > 2:\n        return True\n    return False\n")
    (root / "src" / "b.rs").write_text("fn f(a: u8) -> bool {\n    assert!(a == 1);\n    a > 0 && true\n}\n")
    (root / "tests" / "t.py").write_text("def test_it():\n    assert 1 < 2\n")
    git_ = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env={**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"})
    git_("init", "-q", "-b", "main")
    git_("add", ".")
    git_("commit", "-qm", "one")
    return root, git_


def test_git(spark, project, tmp_path):
    root, run = project
    assert len(git.head_commit(str(root))) == 40 and git.head_commit(str(tmp_path)) is None
    run("checkout", "-qb", "work")
    (root / "src" / "c.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "two")
    (root / "src" / "a.py").write_text("changed\n")
    (root / "new file.py").write_text("")
    (root / "src" / "b.rs").unlink()
    assert sorted(r.file for r in git.changed_files(spark, str(root), "main").collect()) == ["new file.py", "src/a.py", "src/c.py"]
    assert sorted(r.file for r in git.changed_files(spark, str(root / "src"), "main").collect()) == ["a.py", "c.py"]
    rows = spark.createDataFrame([("./src/a.py",), ("src/z.py",)], "file string")
    assert [r.file for r in git.only_changed(rows, git.changed_files(spark, str(root), "main")).collect()] == ["./src/a.py"]
    with pytest.raises(git.GitError):
        git.changed_files(spark, str(root), "no-such-branch")


def test_plan(spark, project):
    root, _ = project
    (root / "cov.info").write_text("SF:/ci/src/a.py\nDA:1,1\nDA:2,1\nDA:6,1\nDA:7,0\nDA:8,1\nend_of_record\n")
    settings = config.resolve({"mutation.strategy": "highest-crap", "mutation.coverage": [str(root / "cov.info")], "mutation.exclude_operators": ["swap_logical"]}, {})
    plan = planning.build_plan(spark, str(root), settings)
    rows = plan.candidates.orderBy("plan_index").collect()
    assert [r.plan_index for r in rows] == [*range(len(rows))] and {r.file for r in rows} == {"src/a.py", "src/b.rs"} and "swap_logical" not in {r.operator for r in rows}
    assert [r.crap for r in rows] == sorted((r.crap for r in rows), reverse=True)
    assert {(r.skip_rule, r.n) for r in plan.skipped_by_rule().collect()} == {("test_file", 2)}
    assert {(r.function, r.coverage) for r in plan.functions.where("file = 'src/a.py'").collect()} == {("small", 100.0), ("big", 2 / 3 * 100)}
    assert plan.summary().candidates == len(rows) and plan.summary().files == 2 and plan.candidate(rows[3].id).plan_index == 3
    with pytest.raises(LookupError):
        plan.candidate("none")
    less = planning.build_plan(spark, str(root), config.resolve({"mutation.limit": 2, "mutation.strategy": "highest-crap", "mutation.coverage": [str(root / "cov.info")], "mutation.exclude_operators": ["swap_logical"]}, {}))
    assert [r.id for r in less.candidates.orderBy("plan_index").collect()] == [r.id for r in rows[:2]]
    only = planning.build_plan(spark, str(root), config.resolve({"scope.changed_only": "main", "mutation.categories": ["comparison"], "mutation.static_skips": False}, {}))
    assert only.candidates.count() == 0 and sorted(r.file for r in only.scanned_files().collect()) == ["src/a.py", "src/b.rs", "tests/t.py"]


def test_templates():
    assert probes.filled("{worker}-{build_cache}-{x}", 3, "/c/{worker}") == "3-/c/{worker}-{x}" and probes.filled("{build_cache}", 0, None) == "{build_cache}"
    assert probes.variables(["A=1", "B={worker}", "A=2"], 5) == {"A": "2", "B": "5"}


def test_probe(tmp_path):
    ran = probes.run_probe(["sh", "-c", "echo out; echo err >&2; exit 3"], str(tmp_path))
    assert (ran.status, ran.exit_code, ran.stdout, ran.stderr) == ("killed", 3, "out\n", "err\n")
    slow = probes.run_probe(["sh", "-c", "sleep 60 & echo started; wait"], str(tmp_path), 0.5)
    assert slow.status == "timeout" and slow.exit_code is None and slow.duration_ms < 20_000
    assert probes.preflight(["sh", "-c", 'test "$A" = 1'], str(tmp_path), env={"A": "1"}).success
    assert probes.run_probe(["sh", "-c", "kill -9 $$"], str(tmp_path)).status == "killed"
    assert len(probes.run_probe(["sh", "-c", "head -c 300000 /dev/zero | tr '\\0' x; head -c 300000 /dev/zero >&2"], str(tmp_path), 30).stdout) == 300_000
    assert [r.stdout for r in probes.warm_up(["sh", "-c", "echo $W"], str(tmp_path), ["W={worker}"], 2, None)] == ["0\n", "1\n"]
    with pytest.raises(OSError):
        probes.run_probe(["/no/such/program"], str(tmp_path))


def test_mutants_are_tested(spark, project):
    root, _ = project
    before = (root / "src" / "a.py").read_text()
    at = before.index("<")
    rows = [("m1", "src/a.py", at, at + 1, "<", "<="), ("m2", "src/a.py", at, at + 1, "<", "=="), ("m3", "src/a.py", at, at + 1, ">", "<"), ("m4", "none.py", 0, 1, "x", "y")]
    candidates = spark.createDataFrame(rows, "id string, file string, start_byte int, end_byte int, original string, replacement string").repartition(2)
    done = {r.id: r for r in probes.test_mutants(candidates, str(root), ["sh", "-c", "grep -q 'x <' src/a.py"], 30).collect()}
    assert {k: r.status for k, r in done.items()} == {"m1": "survived", "m2": "killed", "m3": "error", "m4": "error"} and done["m2"].exit_code == 1
    assert "-    return x < 1" in done["m1"].diff and "+    return x <= 1" in done["m1"].diff and (root / "src" / "a.py").read_text() == before
    rows = spark.createDataFrame([(r.id, r.status, r.duration_ms, r.exit_code, "op", r.file, 1, 0) for r in done.values()], "id string, status string, duration_ms long, exit_code int, operator string, file string, line int, column int")
    events = [json.loads(r.event) for r in probes.run_events(rows, 2).orderBy("place").collect()]
    assert [e["event"] for e in events] == ["run_started", *["mutant_finished"] * 4, "run_finished"] and events[-1]["error"] == 2 and events[0]["total"] == 4 and events[1]["completed"] == 1


def test_doctor(project, tmp_path):
    root, _ = project
    checks = probes.doctor(str(root), ["sh"])
    assert [state for _, state, _ in checks] == ["ok"] * 4
    (root / config.FILE_NAME).write_text("[x]")
    assert probes.doctor_counts(probes.doctor(str(root), ["/no/program"])) == {"fail": 2, "warn": 0}


OUTCOMES = "seq long, id string, file string, function string, operator string, status string, line int, column int, original string, replacement string, description string, diff string, stdout string, stderr string"


@pytest.fixture
def run(spark):
    rows = [(1, "m1", "a/b.rs", "f", "swap_boolean", "survived", 3, 4, "true", "false", "flip", "d", "o", "e"), (2, "m2", "a/b.rs", "f", "negate_equality", "killed", 4, 0, "==", "!=", "negate", "d", "o", "e"), (3, "m3", "a-b.rs", "g", "swap_boolean", "timeout", 1, 0, "true", "false", "flip", "d", "o", "e"),
            (4, "m4", "a/b.rs", "f", "remove_not", "survived", 9, 1, "!x", "x", "drop, 100%:\n", "d", "o", "e"), (5, "m5", "a/b.rs", "f", "remove_not", "survived", 9, 1, "!x", "x", "again", "d", "o", "e")]
    scores = spark.createDataFrame([("a/b.rs", "f", 4, 50.0, 20.0, 1)], "file string, function string, cyclomatic int, coverage double, crap double, scan_seq int")
    return spark.createDataFrame(rows, OUTCOMES), scores


def lines(df):
    return [r.text for r in reports.lines_in_order(df).collect()]


def test_details(run):
    rows, _ = run
    seen = lambda **o: [(r.id, r.diff, r.stdout, r.stderr) for r in outcomes.trim(rows, **o).orderBy("seq").collect()]
    assert seen()[1] == ("m2", "d", "", "") and len(seen()) == 5 and seen(detail="full")[2] == ("m3", "d", "o", "e")
    assert seen(detail="compact") == [("m1", "", "", ""), ("m4", "", "", ""), ("m5", "", "", "")] and seen(detail="compact", diff=True, only_survivors=False)[1] == ("m2", "d", "", "")


def test_documents(spark, run):
    rows, scores = run
    sarif = json.loads("".join(lines(reports.sarif_document(rows))))
    found = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and [r["id"] for r in found["tool"]["driver"]["rules"]] == ["remove_not", "swap_boolean"] and found["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == "drop, 100%:\n"
    assert [(r["ruleId"], r["locations"][0]["physicalLocation"]["region"]) for r in found["results"]] == [("swap_boolean", {"startLine": 3, "startColumn": 5}), ("remove_not", {"startLine": 9, "startColumn": 2}), ("remove_not", {"startLine": 9, "startColumn": 2})]
    whole = json.loads("".join(lines(reports.json_report(rows, scores))))
    assert whole["totals"]["killed"] == 1 and [o["operator"] for o in whole["operators"]][0] in ("remove_not", "swap_boolean") and [f["function"] for f in whole["functions"]] == ["f", "g"] and len(whole["outcomes"]) == 5
    none = rows.limit(0)
    assert json.loads("".join(lines(reports.sarif_document(none))))["runs"][0]["results"] == [] and json.loads("".join(lines(reports.json_report(none, scores))))["outcomes"] == []
    notes = {r.id: r.annotation for r in reports.annotations(rows).collect()}
    assert notes["m1"] == "::warning file=a/b.rs,line=3,col=5,title=Survived mutant::swap_boolean true -> false survived in f"


def test_text_and_tasks(spark, run):
    rows, scores = run
    text = reports.text_report(rows, scores)
    assert text.startswith("Score 25.0%: 1 killed, 3 survived, 1 timed out, 0 failed\n") and "1. a/b.rs::f\n   crap 20.0, complexity 4, coverage 50.0%, score 25.0%, priority 107.5\n   - swap_boolean at 3:5: true -> false" in text and "2. a-b.rs::g" in text
    assert [x.split()[0] for x in text.split("\n")[3:6]] == ["swap_boolean", "remove_not", "negate_equality"]
    assert reports.text_report(rows.where("status = 'killed'"), scores).endswith("No weakly tested functions.\n")
    withs = rows.withColumn("source_context", reports.context(F.lit("x\ny\nz"), F.lit(2), 1))
    tasks = reports.agent_tasks(withs, outcomes.function_summary(rows, scores))
    first = tasks.orderBy("seq").first()
    assert (first.task_id, first.column, first.mutation, first.crap, first.focus) == ("test-task-001", 5, "true -> false", 20.0, "Function f") and first.prompt.startswith("Add a test of f (a/b.rs, line 3, column 5) that fails when true becomes false. ")
    page = "\n".join(lines(reports.tasks_markdown(tasks)))
    assert page.startswith("# Survived mutants\n\n3 survivors, 2 distinct, at 2 places.\n\n- a/b.rs: 3\n") and page.index("## High") < page.index("## Medium") and "found 2 times" in page and page.count("```\n") == 2
    assert "0 survivors" in "\n".join(lines(reports.tasks_markdown(tasks.limit(0))))


def test_catalog_texts(spark):
    text = reports.operators_text(catalog.operator_catalog(spark), catalog.implementation_catalog(spark))
    assert text.split("\n")[0].split() == ["comparison_boundary", "comparison", "on", "c_sharp,", "go,", "javascript,", "python,", "rust,", "typescript"] and len(text.split("\n")) == 54
    assert reports.languages_text(catalog.language_catalog(spark)).split("\n")[0].split() == ["bash", "scan_only", "sh,", "bash"]


def test_order_of_operators(run):
    rows, _ = run
    got = outcomes.operator_order(outcomes.operator_summary(rows)).orderBy("position").collect()
    assert [r.operator for r in got] == ["swap_boolean", "remove_not", "negate_equality"]


def test_stable_id_and_ranks(spark):
    rows = spark.createDataFrame([("./a\\b.rs", "op", 1, 2, "x", "y")], "file string, operator string, start_byte int, end_byte int, original string, replacement string")
    one, two = (selection.seeded(rows, "s", "c", version).first() for version in (selection.RANKING, "other"))
    assert one.stable_id == "a/b.rs\0op\x001\x002\0x\0y" and one.ranking_key != two.ranking_key


def test_edits_tables(spark):
    sources = spark.createDataFrame([("a.rs", "fn f() { assert!(x); }"), ("b.rs", None)], "file string, text string")
    assert [tuple(r) for r in edits.macro_table(sources).collect()] == [("a.rs", "assert", 17, 18)]
    matches = spark.createDataFrame([("a", "i", 1, 2, 5), ("a", "i", 1, 2, 3), ("a", "j", 1, 2, 9)], "file string, implementation string, start_byte int, end_byte int, scan_seq int")
    assert sorted((r.implementation, r.scan_seq) for r in edits.first_per_site(matches).collect()) == [("i", 3), ("j", 9)]
    cut = spark.createDataFrame([("", " ", 5, 4, "x"), ("", "(", 5, 4, "x"), ("y", " ", 5, 4, "x")], "replacement string, before string, start_byte int, column int, original string")
    assert [(r.start_byte, r.original) for r in edits.widen_deletions(cut).collect()] == [(4, " x"), (5, "x"), (5, "x")]
    diffed = edits.with_diff(spark.createDataFrame([("f", "a\nb\n", "a\nc\n"), ("f", "a", None)], "file string, text string, mutated_text string")).collect()
    assert diffed[0].diff == "--- f\n+++ f\n a\n-b\n+c" and diffed[1].diff is None
