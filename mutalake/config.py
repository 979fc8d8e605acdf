"""Settings: a strict TOML file, presets by project kind, and layers (arguments, then file, then preset, then default)."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

FILE_NAME = "mutalake.toml"
_STRINGS, _PATHS = "strings", "path"
# Section, key and kind of every setting: fixed values.
KEYS: dict[str, dict[str, Any]] = {
    "scope": {"exclude": _STRINGS, "changed_only": str},
    "mutation": {"strategy": str, "operators": _STRINGS, "exclude_operators": _STRINGS, "categories": _STRINGS, "exclude_categories": _STRINGS, "static_skips": bool, "context_lines": int, "lcov": _PATHS, "coverage": _STRINGS, "limit": int, "seed": str},
    "runner": {"workspace_backend": str, "jobs": int, "timeout_seconds": int, "preflight": bool, "per_worker_cache": bool, "warmup": bool, "cache_dir": _PATHS, "runs_dir": _PATHS, "build_cache_dir": _PATHS, "pre_run": _STRINGS},
    "probe": {"command": _STRINGS, "env": _STRINGS},
    "report": {"format": str, "output": _PATHS, "fail_on_survivors": bool, "allow_incomplete": bool, "detail": str, "diff": bool, "stdout": bool, "stderr": bool, "only_survivors": bool},
}
CHOICES = {"mutation.strategy": ("discovery", "actionable", "highest-crap"), "runner.workspace_backend": ("auto", "copy", "overlay", "worktree"), "report.detail": ("compact", "normal", "full"), "report.format": ("json", "human", "sarif", "github", "agent-tasks", "markdown")}
DEFAULTS = {"mutation.strategy": "discovery", "mutation.static_skips": True, "mutation.context_lines": 3, "runner.jobs": 1, "runner.workspace_backend": "auto", "runner.preflight": False, "runner.per_worker_cache": False, "runner.warmup": False,
            "runner.cache_dir": ".mutalake/cache", "runner.runs_dir": ".mutalake/runs", "report.format": "json", "report.detail": "normal", "report.fail_on_survivors": False, "report.allow_incomplete": False}


@dataclass(frozen=True)
class Preset:
    """What a kind of project recommends: files that mark it, its probe, and settings."""

    markers: tuple[str, ...]
    probe: tuple[str, ...]
    per_worker_cache: bool = False
    env: tuple[str, ...] = ()


# Test commands and caches of the usual tools: fixed values.
PRESETS = {
    "rust": Preset(("Cargo.toml",), ("cargo", "test"), True, ("CARGO_TARGET_DIR={build_cache}",)),
    "go": Preset(("go.mod",), ("go", "test", "./..."), False, ("GOCACHE={build_cache}/go-build", "GOTMPDIR={build_cache}")),
    "node": Preset(("package.json",), ("npm", "test"), False, ("npm_config_cache={build_cache}/npm",)),
    "python": Preset(("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt"), ("pytest",), False, ("PYTHONPYCACHEPREFIX={build_cache}/pycache", "PYTEST_ADDOPTS=--cache-clear", "TMPDIR={build_cache}/tmp")),
    "c_sharp": Preset((), ("dotnet", "test"), False, ("DOTNET_CLI_TELEMETRY_OPTOUT=1", "NUGET_PACKAGES={build_cache}/nuget")),
}
#: Lock files of the package managers that a node project may use instead, with their test command and cache.
_NODE = (("pnpm-lock.yaml", ("pnpm", "test"), "npm_config_store_dir={build_cache}/pnpm"), ("yarn.lock", ("yarn", "test"), "YARN_CACHE_FOLDER={build_cache}/yarn"), ("bun.lockb", ("bun", "test"), "BUN_INSTALL_CACHE_DIR={build_cache}/bun"))


class ConfigError(ValueError):
    """A settings file that doesn't say what it should."""


def _checked(section: str, key: str, value: Any) -> Any:
    kind = KEYS[section][key]
    if kind == _STRINGS:
        good = isinstance(value, list) and all(isinstance(x, str) for x in value)
    elif kind is int:
        good = isinstance(value, int) and not isinstance(value, bool) and value >= 0
    else:
        good = isinstance(value, str if kind == _PATHS else kind)
    if not good:
        raise ConfigError(f"{section}.{key}: {value!r} is of the wrong kind")
    if (allowed := CHOICES.get(f"{section}.{key}")) and value not in allowed:
        raise ConfigError(f"{section}.{key}: {value!r} is none of {', '.join(allowed)}")
    return value


def parse_config(text: str) -> dict[str, Any]:
    """Settings by section.key; unknown sections, unknown keys and wrong kinds raise ConfigError."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    out = {}
    for section, body in raw.items():
        if section not in KEYS or not isinstance(body, dict):
            raise ConfigError(f"unknown section {section}")
        for key, value in body.items():
            if key not in KEYS[section]:
                raise ConfigError(f"unknown key {section}.{key}")
            out[f"{section}.{key}"] = _checked(section, key, value)
    return out


def load_config(folder: str, path: str | None = None) -> dict[str, Any]:
    """The named file, else the folder's own if it has one, else nothing."""
    own = os.path.join(folder, FILE_NAME)
    if path is None and not os.path.isfile(own):
        return {}
    with open(path or own, encoding="utf-8") as f:
        return parse_config(f.read())


def preset_settings(name: str, folder: str) -> dict[str, Any]:
    """Settings that a preset fills in; the project must have one of the preset's marks."""
    if name not in PRESETS:
        raise ConfigError(f"unknown preset {name}")
    found, preset = os.listdir(folder), PRESETS[name]
    marks = preset.markers or tuple(x for x in found if x.endswith((".sln", ".csproj")))
    if not any(x in found for x in marks):
        raise ConfigError(f"the {name} preset needs one of {', '.join(preset.markers) or '*.sln, *.csproj'} in {folder}")
    probe, env = list(preset.probe), list(preset.env)
    if name == "node":
        probe, env = next(((list(p), [e]) for lock, p, e in _NODE if lock in found), (probe, env))
    out = {"probe.command": probe, "probe.env": env, "runner.workspace_backend": "worktree", "runner.warmup": True}
    return out | ({"runner.per_worker_cache": True} if preset.per_worker_cache else {})


@dataclass
class Settings:
    """Values by section.key, and what the preset filled in."""

    values: dict[str, Any] = field(default_factory=dict)
    filled: list[str] = field(default_factory=list)

    def __getitem__(self, key: str) -> Any:
        return self.values.get(key)


def resolve(arguments: dict[str, Any], config: dict[str, Any], preset: dict[str, Any] | None = None) -> Settings:
    """Arguments win over the file, the file over the preset, the preset over defaults; a probe's variables are joined, each once."""
    out = Settings(DEFAULTS | config | {k: _checked(*k.split(".", 1), v) for k, v in arguments.items() if v is not None})
    for key, value in (preset or {}).items():
        if key == "probe.env":
            own = [*out.values.get(key, [])]
            have = {x.partition("=")[0] for x in own}
            added = [x for x in value if x.partition("=")[0] not in have]
            out.values[key] = own + added
            out.filled += [f"probe.env += {x}" for x in added]
        elif key not in config and arguments.get(key) is None:
            out.values[key] = value
            out.filled.append(f"{key}={value}")
    for key in ("mutation.exclude_operators", "mutation.exclude_categories", "scope.exclude"):
        out.values.setdefault(key, [])
    return out


# First settings of the usual tools: probe, its variables, workers, seconds, a cache for each worker, warm-up. Fixed values.
STARTERS: dict[str, tuple[list[str], list[str], int, int, bool, bool]] = {
    "rust": (["cargo", "test", "--jobs", "1"], ["CARGO_TARGET_DIR={build_cache}"], 2, 120, True, True),
    "go": (["go", "test", "./..."], ["GOCACHE=.mutalake/cache/gocache-{worker}", "GOFLAGS=-count=1"], 4, 60, False, True),
    "python": (["pytest", "-q"], ["PYTHONDONTWRITEBYTECODE=1", "PYTEST_CACHE_DIR=.mutalake/cache/pytest-{worker}"], 4, 60, False, False),
    "node": (["npm", "test"], ["npm_config_cache=.mutalake/cache/npm-{worker}"], 2, 60, False, False),
    "java-gradle": (["./gradlew", "test", "--no-daemon"], ["GRADLE_USER_HOME=.mutalake/cache/gradle-{worker}"], 2, 300, False, True),
    "java-maven": (["mvn", "-q", "test"], ["MAVEN_OPTS=-Dmaven.repo.local=.mutalake/cache/m2-{worker}"], 2, 300, False, True),
    "ruby": (["bundle", "exec", "rake", "test"], ["BUNDLE_PATH=.mutalake/cache/bundle-{worker}"], 2, 60, False, False),
}


def starter(name: str | None = None) -> str:
    """The text of a first settings file for one of STARTERS; without a name, one whose probe does nothing."""
    if name is not None and name not in STARTERS:
        raise ConfigError(f"unknown starter {name}; known are {', '.join(STARTERS)}")
    command, env, jobs, seconds, own_cache, warmup = STARTERS[name] if name else (["true"], [], 1, 180, False, False)
    shown = lambda x: str(x).lower() if isinstance(x, bool) else json.dumps(x)
    return "\n".join([
        "# Arguments win over this file.", "", "[scope]", "# Globs beside the usual build folders and the lines of .gitignore.", "exclude = []", '# changed_only = "main"', "",
        "[mutation]", 'strategy = "actionable"', "static_skips = true", "context_lines = 3", "# limit = 50", '# coverage = ["lcov:lcov.info"]', "",
        "[runner]", 'workspace_backend = "auto"', f"jobs = {jobs}", f"timeout_seconds = {seconds}", f"preflight = {shown(name is not None)}", f"per_worker_cache = {shown(own_cache)}", f"warmup = {shown(warmup)}", 'cache_dir = ".mutalake/cache"', 'runs_dir = ".mutalake/runs"', "",
        "[probe]", f"command = {shown(command)}", f"env = {shown(env)}", "", "[report]", 'format = "human"', "fail_on_survivors = true", "allow_incomplete = false", ""])


def project_types(folder: str) -> list[str]:
    """The presets whose marks lie in a folder, in the presets' order."""
    found = os.listdir(folder)
    return [name for name, p in PRESETS.items() if any(x in found for x in p.markers) or not p.markers and any(x.endswith((".sln", ".csproj")) for x in found)]


def recommended(folder: str) -> dict[str, Any]:
    """What a project should begin with: its type (unknown, mixed or a preset), the preset's probe, a workspace and a way to write settings.

    Mixed and unknown projects have no probe; a folder under version control is worked on in worktrees, others in copies.
    """
    types = project_types(folder)
    kind = types[0] if len(types) == 1 else "mixed" if types else "unknown"
    backend = "worktree" if os.path.exists(os.path.join(folder, ".git")) else "copy"
    probe = preset_settings(kind, folder)["probe.command"] if kind in PRESETS else None
    return {"project_type": kind, "types": types, "workspace_backend": backend, "probe.command": probe, "starter": kind if kind in STARTERS else None}
