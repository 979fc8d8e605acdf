"""Ignore files and globs: which paths of a tree are left out."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Ignore files, from the one that yields to the one that wins in a folder.
IGNORE_FILES = (".gitignore", ".ignore")


def glob_body(body: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? and [...] don't."""
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[":
            end = body.find("]", i + 2 + body.startswith("!", i + 1))
            if end < 0:
                raise ValueError(f"bad glob: {body}")
            inside = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, for paths below the folder that holds it."""

    like: re.Pattern
    kept: bool
    folders_only: bool


def rule(line: str) -> Rule | None:
    """A line's rule; none for blanks and comments. Without an inner slash it fits names at any depth."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    kept = line.startswith("!")
    body = line[kept:]
    folders_only, body = body.endswith("/"), body.rstrip("/")
    anchored, body = "/" in body, body.removeprefix("/")
    return Rule(re.compile(("" if anchored else "(?:.*/)?") + glob_body(body)), kept, folders_only) if body else None


def rules(text: str) -> list[Rule]:
    """The rules of an ignore file; lines that aren't globs are left out, as are blanks and comments."""
    found = []
    for line in text.splitlines():
        try:
            found.append(rule(line))
        except (ValueError, re.error):
            continue
    return [r for r in found if r is not None]


def excludes(patterns: list[str]) -> list[Rule]:
    """The rules of globs that a user names; ValueError for one that isn't a glob."""
    try:
        return [r for p in patterns if (r := rule(p)) is not None]
    except re.error as e:
        raise ValueError(f"bad glob: {e}") from e


def verdict(own: list[Rule], path: str, is_folder: bool) -> bool | None:
    """Whether the last rule that fits leaves the path out; None if none fits."""
    for r in reversed(own):
        if (is_folder or not r.folders_only) and r.like.fullmatch(path):
            return not r.kept
    return None
