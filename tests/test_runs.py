"""Runs that are followed while they go on: one probe a mutant, events as probes end, documents as single files."""

import json
import os
import re
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mutalake.plans import documents, probes, reports
from mutalake.streaming import events

CANDIDATES = "id string, file string, start_byte int, end_byte int, original string, replacement string, operator string, line int, column int"


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    for name in ("a.py", "target/t.py", "pkg/target/kept.py", "pkg/node_modules/kept.js", "node_modules/n.js"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x < 1\n" * 40)
    (root / "gone.py").symlink_to(root / "none.py")
    return root


def mutants(spark, n=12, parts=3):
    rows = [(f"m{i:02}", "a.py", 6 * i + 2, 6 * i + 3, "<", "<=" if i % 3 else ">=", "comparison_boundary", i + 1, 2) for i in range(n)] + [("bad", "none.py", 0, 1, "x", "y", "op", 1, 0)]
    return spark.createDataFrame(rows, CANDIDATES).repartition(parts)


def command(tmp_path):
    """Counts its starts; fails for a replaced >=."""
    return ["sh", "-c", f"echo x >> {tmp_path}/starts; ! grep -q '>=' a.py"]


def starts(tmp_path):
    return (tmp_path / "starts").read_text().count("x")


def test_copies_leave_out_top_names_only(project, tmp_path):
    probes.copy_project(str(project), str(tmp_path / "copy"), ("target", "node_modules"))
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "copy") for d, _, names in os.walk(tmp_path / "copy") for f in names}
    assert found == {"a.py", "pkg/target/kept.py", "pkg/node_modules/kept.js"}


def test_one_probe_a_mutant(spark, project, tmp_path):
    """Whatever is made of the outcomes, each mutant was probed once."""
    done = probes.test_mutants(mutants(spark), str(project), command(tmp_path), 30)
    assert {r.status: r.n for r in done.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"survived": 8, "killed": 4, "error": 1}
    found = [json.loads(r.event) for r in probes.run_events(done).orderBy("place").collect()]
    documents.write_document(probes.run_events(done), f"{tmp_path}/events.jsonl", ["place"], "event")
    assert done.count() == 13 and starts(tmp_path) == 12
    order = [r.id for r in done.orderBy("finished_at", "id").collect()]
    assert [e["id"] for e in found[1:-1]] == order and [e["completed"] for e in found[1:-1]] == [*range(1, 14)]
    lines = [json.loads(x) for x in (tmp_path / "events.jsonl").read_text().splitlines()]
    assert lines == found and lines[0]["event"] == "run_started" and lines[-1]["killed"] == 4


def test_a_stopped_run_goes_on(spark, project, tmp_path):
    """Mutants with an event aren't probed again; their outcome is what the event says."""
    at = str(tmp_path / "events")
    some = mutants(spark).where("id < 'm05'")
    first = {r.id: r for r in probes.test_mutants(some, str(project), command(tmp_path), 30, events=at, run="r").collect()}
    assert starts(tmp_path) == 5 and len(os.listdir(at)) == 6
    all_ = {r.id: r for r in probes.test_mutants(mutants(spark, parts=2), str(project), command(tmp_path), 30, events=at, run="r").collect()}
    assert starts(tmp_path) == 12 and len(all_) == 13 and all(all_[k] == r for k, r in first.items())
    event = probes.finished_event(at, "m03")
    assert (event["event"], event["run_id"], event["status"], event["operator"], event["line"]) == ("mutant_finished", "r", "killed", "comparison_boundary", 4) and probes.finished_event(at, "never") is None


def test_a_run_is_followed(spark, project, tmp_path):
    """completed follows the ends of the probes over several batches; started again the stream goes on, repeats come once."""
    at, out = str(tmp_path / "events"), str(tmp_path / "out")
    follow = lambda: events.follow_run(spark, at, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert events.finished_batches(spark, out) is None
    probes.test_mutants(mutants(spark).where("id < 'm05'"), str(project), command(tmp_path), 30, events=at, run="r")
    follow()
    half = [r.id for r in events.finished_batches(spark, out).orderBy("completed").collect()]
    done = probes.test_mutants(mutants(spark), str(project), command(tmp_path), 30, events=at, run="r")
    (tmp_path / "events" / "again.json").write_text((tmp_path / "events" / os.path.basename(probes.event_path(at, "m01"))).read_text())
    follow()
    follow()
    rows = events.finished_batches(spark, out).orderBy("completed").collect()
    assert [r.completed for r in rows] == [*range(1, 14)] and [r.id for r in rows] == [r.id for r in done.orderBy("finished_at", "id").collect()] and [r.id for r in rows][:6] == half
    counts = {r.status: r.n for r in events.status_counts(spark.read.schema(events.EVENT_SCHEMA).json(at)).collect()}
    assert counts == {"survived": 8, "killed": 4, "error": 1}


def test_documents_are_single_files(spark, tmp_path):
    """Rows in any order and number become one file in order; none, nulls, text in all alphabets; a second write replaces the first."""
    n = 5000
    rows = spark.range(n).select((F.col("id") % 3).alias("part"), F.col("id").alias("place"), F.concat(F.lit("é日🎉 "), "id").alias("text")).union(spark.createDataFrame([(1, 1, None)], "part long, place long, text string")).repartition(7)
    path = tmp_path / "deep" / "doc.txt"
    path.parent.mkdir()
    path.write_text("old")
    documents.write_document(rows, str(path))
    assert path.read_text().splitlines() == [f"é日🎉 {i}" for k in range(3) for i in range(k, n, 3)] and os.listdir(path.parent) in (["doc.txt"], [".doc.txt.crc", "doc.txt"], ["doc.txt", ".doc.txt.crc"])
    documents.write_document(rows.where("part > 5"), f"file://{path}")
    assert path.read_text() == ""


def test_json_documents(spark, tmp_path):
    functions = spark.createDataFrame([("b/c.py", "f", 3, 9, 2.5), ("a.py", "g", 1, 2, None), ("b.py", "h", 1, 1, 7.0)], "file string, function string, start_line int, end_line int, crap double")
    candidates = spark.createDataFrame([(1, "x", "b.py", 2, 0, "i"), (0, "y", "a.py", 1, 4, "i")], "plan_index int, id string, file string, line int, column int, implementation string")
    read = lambda frame: (documents.write_document(frame, f"{tmp_path}/x.json"), json.loads((tmp_path / "x.json").read_text()))[1]
    assert [r["file"] for r in read(reports.scan_document(functions))] == ["a.py", "b/c.py", "b.py"] and [r["crap"] for r in read(reports.crap_document(functions))] == [7.0, 2.5, None]
    assert [r["id"] for r in read(reports.candidates_document(candidates))] == ["y", "x"] and read(reports.scan_document(functions.limit(0))) == []
    plan = read(reports.plan_document(candidates, candidates.withColumn("skip_rule", F.lit("test_file")), "abc"))
    assert [c["id"] for c in plan["candidates"]] == ["y", "x"] and [c["skip_rule"] for c in plan["skipped"]] == ["test_file"] * 2 and plan["commit"] == "abc"


def test_ledger(spark, tmp_path):
    candidates = spark.createDataFrame([(0, "y", "a.py", 1, 4, "i")], "plan_index int, id string, file string, line int, column int, implementation string")
    lines = spark.createDataFrame([(1, '{"event":"b"}'), (0, '{"event":"a"}')], "place long, event string")
    report = spark.createDataFrame([(0, 0, '{"totals":'), (1, 0, "{}}")], "part int, place long, text string")
    now = datetime(2024, 2, 29, 23, 59, 58, tzinfo=timezone(timedelta(hours=-1)))
    run = documents.run_id(now, 42)
    assert run == "run-20240301-005958-42" and documents.started_at(now) == "2024-03-01T00:59:58Z" and re.fullmatch(r"run-\d{8}-\d{6}-\d+", documents.run_id()) and documents.started_at(datetime(1970, 1, 1, tzinfo=UTC)) == "1970-01-01T00:00:00Z"
    at = reports.write_ledger(str(tmp_path), run, {"started_at": documents.started_at(now), "probe": ["x", "y"], "limit": None}, reports.plan_document(candidates, candidates.limit(0)), lines, report)
    assert json.load(open(f"{at}/metadata.json")) == {"run_id": run, "started_at": "2024-03-01T00:59:58Z", "probe": ["x", "y"], "limit": None} and json.load(open(f"{at}/report.json")) == {"totals": {}}
    assert [json.loads(x)["event"] for x in open(f"{at}/events.jsonl")] == ["a", "b"] and json.load(open(f"{at}/plan.json"))["candidates"][0]["id"] == "y"
    with pytest.raises(FileExistsError):
        reports.write_ledger(str(tmp_path), run, {}, report, lines, report)


def test_every_operator_has_a_hint_of_its_own():
    from mutalake.functions.catalog import OPERATORS

    assert sorted(reports.HINTS) == sorted(name for name, *_ in OPERATORS) and len(set(reports.HINTS.values())) >= 53


def test_suggestions_and_rules(spark, tmp_path):
    rows = spark.createDataFrame([(0, "i", "a.py", "f", "swap_logical", "survived", 3, 4, "and", "or", "Swap and and or."), (1, "j", "a.py", "g", "own", "survived", 5, 0, "x", "", "Own.")], "seq int, id string, file string, function string, operator string, status string, line int, column int, original string, replacement string, description string")
    said = {r.id: r.prompt for r in reports.with_suggestion(rows).collect()}
    assert said == {"i": "Add a test of f (a.py, line 3, column 5) that fails when and becomes or. Let each operand decide alone, with the other one fixed.", "j": "Add a test of g (a.py, line 5, column 1) that fails when x becomes nothing. Assert the behaviour that this edit changes."}
    documents.write_document(reports.sarif_document(rows), f"{tmp_path}/r.sarif")
    driver = json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["tool"]["driver"]
    assert driver["informationUri"] and [r["id"] for r in driver["rules"]] == ["own", "swap_logical"]
    assert all(r["name"] and r["shortDescription"]["text"] and r["fullDescription"]["text"] and r["help"]["text"] for r in driver["rules"])


def test_pre_run(spark, tmp_path):
    """The command runs once in the project before anything is planned; a failure stops the run."""
    from mutalake import config
    from mutalake.plans import planning

    settings = lambda *command: config.resolve({"runner.pre_run": list(command), "mutation.operators": ["comparison_boundary"]}, {})
    made = planning.prepare_run(spark, str(tmp_path), settings("sh", "-c", "printf 'def f(x):\\n    return x < 1\\n' > made.py; echo x >> ran"))
    assert [r.file for r in made.candidates.collect()] == ["made.py"] and (tmp_path / "ran").read_text() == "x\n"
    for command in (["sh", "-c", "echo bad >&2; exit 3"], ["/no/such/program"]):
        with pytest.raises(probes.PreRunError):
            planning.prepare_run(spark, str(tmp_path), settings(*command))
    assert probes.pre_run(str(tmp_path), None) is None


def test_starters_and_recommendations(tmp_path):
    from mutalake import config

    assert list(config.STARTERS) == ["rust", "go", "python", "node", "java-gradle", "java-maven", "ruby"]
    for name, (command, env, jobs, *_) in config.STARTERS.items():
        found = config.parse_config(config.starter(name))
        assert (found["probe.command"], found["probe.env"], found["runner.jobs"], found["runner.preflight"]) == (command, env, jobs, True)
    assert config.parse_config(config.starter())["probe.command"] == ["true"]
    with pytest.raises(config.ConfigError):
        config.starter("cobol")
    seen = lambda: [config.recommended(str(tmp_path))[k] for k in ("project_type", "workspace_backend", "probe.command", "starter")]
    assert seen() == ["unknown", "copy", None, None]
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "yarn.lock").write_text("")
    assert seen() == ["node", "copy", ["yarn", "test"], "node"]
    (tmp_path / "a.csproj").write_text("")
    (tmp_path / ".git").mkdir()
    assert seen() == ["mixed", "worktree", None, None] and config.project_types(str(tmp_path)) == ["node", "c_sharp"]
