"""Running probes: templates of their variables, one process with a time limit, and mutants tested by partition."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import signal
import subprocess
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.functions.session import settled
from mutalake.operators.edits import diff_text

_PLACE = re.compile(r"\{worker\}|\{build_cache\}")


def filled(template: str, worker: int, build_cache: str | None) -> str:
    """{worker} and {build_cache} in one pass from the left; other braces stay, and so does {build_cache} without a cache."""
    return _PLACE.sub(lambda m: str(worker) if m.group() == "{worker}" else m.group() if build_cache is None else build_cache, template)


def variables(templates: list[str], worker: int = 0, build_cache: str | None = None) -> dict[str, str]:
    """NAME=value templates as variables; the last of a name wins."""
    return {name: filled(value, worker, build_cache) for name, _, value in (x.partition("=") for x in templates)}


@dataclass
class Ran:
    """What a process did; exit_code is null for a time-out, and for an end by a signal."""

    timed_out: bool
    exit_code: int | None
    duration_ms: int
    stdout: str
    stderr: str

    @property
    def success(self) -> bool:
        return not self.timed_out and self.exit_code == 0

    @property
    def status(self) -> str:
        return "timeout" if self.timed_out else "survived" if self.exit_code == 0 else "killed"


def run_probe(command: list[str], folder: str, timeout: float | None = None, env: dict[str, str] | None = None) -> Ran:
    """Run a command in a folder, its output read to the end; beyond the time limit the whole process group is ended.

    OSError if it can't be started.
    """
    began = time.monotonic()
    child = subprocess.Popen(command, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env={**os.environ, **(env or {})}, start_new_session=True)
    timed_out = False
    try:
        out, err = child.communicate(timeout=timeout)
    except subprocess.TimeoutExpired:
        timed_out = True
        os.killpg(child.pid, signal.SIGKILL)
        out, err = child.communicate()
    code = child.returncode
    return Ran(timed_out, None if timed_out or code < 0 else code, int((time.monotonic() - began) * 1000), out.decode("utf-8", "replace"), err.decode("utf-8", "replace"))


class PreRunError(RuntimeError):
    """The command before a run failed."""


def pre_run(root: str, command: list[str] | None) -> Ran | None:
    """The settings' command that prepares a project, once in its folder, before it is planned; PreRunError if it fails or can't be started."""
    if not command:
        return None
    try:
        ran = run_probe(command, root)
    except OSError as e:
        raise PreRunError(f"{' '.join(command)} can't be started: {e}") from e
    if not ran.success:
        raise PreRunError(f"{' '.join(command)} failed ({ran.exit_code}): {ran.stderr.strip()[-2000:]}")
    return ran


def preflight(command: list[str], folder: str, timeout: float | None = None, env: dict[str, str] | None = None) -> Ran:
    """The probe on the unchanged project; a plan only makes sense if it succeeds."""
    return run_probe(command, folder, timeout, env)


def warm_up(command: list[str], folder: str, templates: list[str], workers: int, build_cache: str | None) -> list[Ran]:
    """The probe once for each worker's cache, one after the other, without a time limit."""
    return [run_probe(command, folder, None, variables(templates, k, build_cache)) for k in range(workers)]


def mutated(text: str, start: int, end: int, original: str, replacement: str) -> str:
    """The text with one edit; ValueError where the span doesn't hold the original."""
    raw = text.encode()
    if not 0 <= start <= end <= len(raw) or raw[start:end] != original.encode():
        raise ValueError("the span doesn't hold the original text")
    return (raw[:start] + replacement.encode() + raw[end:]).decode()


_OUTCOME = "status string, exit_code int, duration_ms long, diff string, stdout string, stderr string, finished_at long"
#: What an event keeps of a candidate, if it has them.
_SHOWN = ("operator", "file", "line", "column")


def event_path(events: str, id_: str) -> str:
    return os.path.join(events, f"{hashlib.sha256(id_.encode()).hexdigest()}.json")


def finished_event(events: str, id_: str) -> dict | None:
    """What a probe that ended has left of itself; None before."""
    try:
        with open(event_path(events, id_), encoding="utf-8") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def write_event(events: str, event: dict) -> None:
    """An event appears whole, under its mutant's name."""
    os.makedirs(events, exist_ok=True)
    path = event_path(events, event["id"])
    part = f"{os.path.join(events, '.' + os.path.basename(path))}-{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(json.dumps(event) + "\n")
    os.replace(part, path)


def copy_project(root: str, copy: str, leave_out: tuple[str, ...]) -> None:
    """The project without some names directly below its root; links are left out."""
    top = os.path.realpath(root)

    def ignored(folder: str, names: list[str]) -> set[str]:
        own = {n for n in names if n in leave_out} if os.path.realpath(folder) == top else set()
        return own | {n for n in names if os.path.islink(os.path.join(folder, n))}

    shutil.copytree(root, copy, ignore=ignored, dirs_exist_ok=True)


def test_mutants(candidates: DataFrame, root: str, command: list[str], timeout: float | None = None, templates: list[str] = (), build_cache: str | None = None, leave_out: tuple[str, ...] = (".git", ".mutalake", "target", "node_modules"), work: str | None = None, events: str | None = None, run: str | None = None) -> DataFrame:
    """candidates(file, start_byte, end_byte, original, replacement, …) with their outcomes, each probed in a copy of the project.

    A partition copies the project once (root must be readable there) and restores the file after each
    mutant, so partitions are the workers: repartition candidates to set how many run. Copies lie below
    work, by default .mutalake/work of the project, and go with their task. What fails before
    the probe ends is status error with the message in stderr. The outcomes are stored: the probes run
    here, once, whatever is made of the outcomes.

    events: a folder that all workers share. A probe that ends leaves its event there at once (with id,
    status, the outcome and finished_at, nanoseconds since 1970), for streaming.events to follow. A mutant that has an event isn't probed again, so
    a lost executor's tasks, or a call after a stopped one, go on where probes ended. ids must be unique.
    """
    columns = candidates.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    names = [x.split()[0] for x in _OUTCOME.split(", ")]

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        copy, worker = None, TaskContext.get().partitionId()
        try:
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    try:
                        if events and (done := finished_event(events, row["id"])):
                            out.append(tuple(done[x] for x in names))
                            continue
                        if copy is None:
                            copy = os.path.join(work or os.path.join(root, ".mutalake", "work"), uuid.uuid4().hex)
                            copy_project(root, copy, leave_out)
                        path = os.path.join(copy, row["file"])
                        with open(path, encoding="utf-8", newline="") as f:
                            before = f.read()
                        after = mutated(before, int(row["start_byte"]), int(row["end_byte"]), row["original"], row["replacement"])
                        diff = diff_text(row["file"], before, after)
                        try:
                            with open(path, "w", encoding="utf-8", newline="") as f:
                                f.write(after)
                            ran = run_probe(command, copy, timeout, variables(list(templates), worker, build_cache))
                        finally:
                            with open(path, "w", encoding="utf-8", newline="") as f:
                                f.write(before)
                        out.append((ran.status, ran.exit_code, ran.duration_ms, diff, ran.stdout, ran.stderr, time.time_ns()))
                    except (OSError, ValueError) as e:
                        out.append(("error", None, 0, "", "", str(e), time.time_ns()))
                    if events:
                        shown = {x: row[x] if isinstance(row[x], str) else int(row[x]) for x in _SHOWN if x in columns and row[x] is not None}
                        write_event(events, {"event": "mutant_finished", "run_id": run, "id": row["id"], **shown, **dict(zip(names, out[-1], strict=True))})
                made = pd.DataFrame(out, columns=names)
                made["exit_code"] = made["exit_code"].astype("Int32")
                yield pd.concat([frame[columns].reset_index(drop=True), made], axis=1)
        finally:
            if copy is not None:
                shutil.rmtree(copy, ignore_errors=True)

    return settled(candidates.mapInPandas(probe, f"{fields}, {_OUTCOME}"))


def run_events(outcomes: DataFrame, jobs: int = 1) -> DataFrame:
    """(place, event) as JSON: the start of a run, each finished mutant, the end with its counts.

    Mutants come in the order in which their probes ended (finished_at), else in that of their ids.
    """
    from mutalake.operators.outcomes import run_totals
    from mutalake.operators.rank import with_place

    outcomes = settled(outcomes)
    numbered = with_place(outcomes, [F.asc(x) for x in ("finished_at", "id") if x in outcomes.columns], "completed")
    total = outcomes.count()
    mutant = F.to_json(F.struct(F.lit("mutant_finished").alias("event"), "completed", F.lit(total).alias("total"), "id", "status", "duration_ms", "exit_code", "operator", "file", "line", "column"))
    spark = outcomes.sparkSession
    first = spark.range(1).select(F.lit(0).cast("long").alias("place"), F.to_json(F.struct(F.lit("run_started").alias("event"), F.lit(total).alias("total"), F.lit(jobs).alias("jobs"))).alias("event"))
    last = run_totals(outcomes).select(F.lit(total + 1).cast("long").alias("place"), F.to_json(F.struct(F.lit("run_finished").alias("event"), "total", "killed", "survived", "timeout", "error")).alias("event"))
    return first.union(numbered.select(F.col("completed").cast("long"), mutant)).union(last)


def doctor(root: str, command: list[str] | None = None) -> list[tuple[str, str, str]]:
    """(check, ok, warn or fail; message) of what a run needs: the folder, git, settings and the probe's program."""
    from mutalake.config import ConfigError, load_config
    from mutalake.sources.git import head_commit

    out = [("project", "ok" if os.path.isdir(root) else "fail", root)]
    out.append(("git", "ok", commit) if os.path.isdir(root) and (commit := head_commit(root)) else ("git", "warn", "no commit found"))
    try:
        settings = load_config(root) if os.path.isdir(root) else {}
        out.append(("settings", "ok", f"{len(settings)} keys"))
    except (ConfigError, OSError) as e:
        settings = {}
        out.append(("settings", "fail", str(e)))
    command = command or settings.get("probe.command")
    if not command:
        out.append(("probe", "warn", "no probe command"))
    else:
        out.append(("probe", "ok" if shutil.which(command[0]) else "fail", command[0]))
    return out


def doctor_counts(checks: list[tuple[str, str, str]]) -> dict[str, int]:
    """How many checks failed and warned."""
    return {kind: sum(state == kind for _, state, _ in checks) for kind in ("fail", "warn")}
