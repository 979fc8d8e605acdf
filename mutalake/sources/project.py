"""A project's source files as a Spark data source.

The tree is listed when the read is planned: folders that are left out are not entered, and only files
of a known language that stay are planned, packed by size into partitions. A task reads its files and
nothing else. Listing follows the rules of common source walkers: hidden names, symbolic links and what
the ignore files of a folder and its parents name are skipped, deeper files over shallower ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mutalake.functions.catalog import LANGUAGES
from mutalake.sources.ignore import IGNORE_FILES, Rule, excludes, rules, verdict

#: Bytes and files of a partition, bytes of a batch of rows.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 32 << 20, 5000, 8 << 20
SCHEMA = "file string, language string, text string, error string, bytes long"


def language_of(name: str) -> str | None:
    """The language of a file's extension; of several the first in the catalog."""
    extension = name.rpartition(".")[2] if "." in name.lstrip(".") else None
    return next((language for language, _, own in LANGUAGES if extension in own.split()), None)


class Local:
    """Folders of a file system that is mounted on all machines."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {root}")

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        """(name, is_folder, size) of what a folder holds, links and special files left out."""
        with os.scandir(os.path.join(self.root, folder)) as found:
            return sorted((e.name, e.is_dir(follow_symlinks=False), 0 if e.is_dir(follow_symlinks=False) else e.stat(follow_symlinks=False).st_size) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False))

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()

    def above(self) -> Iterator[tuple[str, Local]]:
        """The folders above, innermost first, each with the root's path below it."""
        at = self.root
        while (up := os.path.dirname(at)) != at:
            at = up
            yield os.path.relpath(self.root, at).replace(os.sep, "/"), Local(at)


class Remote:
    """Folders of a store that Arrow can open by its address; it has no folders above the root."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(root)
        self.folder, self.selector = fs.FileType.Directory, fs.FileSelector

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        found = self.store.get_file_info(self.selector(f"{self.root}/{folder}".rstrip("/")))
        return sorted((e.base_name, e.type == self.folder, e.size or 0) for e in found)

    def read(self, path: str) -> bytes:
        with self.store.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()

    def above(self) -> Iterator[tuple[str, Remote]]:
        return iter(())


def opened(root: str) -> Local | Remote:
    scheme = root.partition("://")[0] if "://" in root else ""
    return Remote(root) if scheme not in ("", "file") else Local(root.removeprefix("file://"))


def _own_rules(place: Local | Remote, folder: str, names: set[str], in_git: bool) -> dict[str, list[Rule]]:
    """The rules of a folder's ignore files; version control's count in a repository only."""
    out = {}
    for name in IGNORE_FILES:
        if name in names and (in_git or name != ".gitignore"):
            out[name] = rules(place.read(f"{folder}/{name}".lstrip("/")).decode("utf-8", "replace"))
    return out


def listed(place: Local | Remote, patterns: list[str], languages: set[str] | None = None) -> Iterator[tuple[str, str, int]]:
    """(path, language, size) of the files that stay, in the order of their paths within a folder."""
    own = excludes(patterns)
    names = {n for n, *_ in place.entries("")}
    above = [(below, up, {n for n, *_ in up.entries("")}) for below, up in place.above()]
    roots = [i for i, held in enumerate([names, *(x for *_, x in above)]) if ".git" in held]
    in_git = bool(roots)
    outer: list[tuple[str, dict[str, list[Rule]]]] = []  # innermost first; a path below the root gets the prefix
    for i, (below, up, held) in enumerate(above):
        outer.append((f"{below}/", _own_rules(up, "", held, in_git and i + 1 <= roots[0])))
    if in_git:  # a repository's own list yields to all files
        below, top = ("", place) if roots[0] == 0 else (f"{above[roots[0] - 1][0]}/", above[roots[0] - 1][1])
        try:
            outer.append((below, {"exclude": rules(top.read(".git/info/exclude").decode("utf-8", "replace"))}))
        except OSError:
            pass

    def out(path: str, is_folder: bool, inner: tuple) -> bool:
        if (named := verdict(own, path, is_folder)) is not None:
            return named
        for kind in (*reversed(IGNORE_FILES), "exclude"):
            for base, found in (*inner, *((None, x) for x in outer)):
                prefix, found = ("", found) if base is not None else found
                local = path.removeprefix(base) if base else prefix + path
                if kind in found and (named := verdict(found[kind], local, is_folder)) is not None:
                    return named
        return path.rpartition("/")[2].startswith(".")

    stack: list[tuple[str, tuple]] = [("", ())]
    while stack:
        folder, inner = stack.pop()
        found = place.entries(folder)
        inner = ((f"{folder}/" if folder else "", _own_rules(place, folder, {n for n, is_folder, _ in found if not is_folder}, in_git)), *inner)
        deeper = []
        for name, is_folder, size in found:
            path = f"{folder}/{name}" if folder else name
            language = None if is_folder else language_of(name)
            if not is_folder and (language is None or languages is not None and language not in languages) or out(path, is_folder, inner):
                continue
            if is_folder:
                deeper.append((path, inner))
            else:
                yield path, language, size
        stack.extend(reversed(deeper))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str]]


class ProjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.excludes = [x for x in options.get("excludes", "").split("\n") if x]
        self.languages = set(options["languages"].split(",")) if options.get("languages") else None

    def partitions(self) -> list[Files]:
        packs, size = [Files([])], 0
        for path, language, own in listed(opened(self.root), self.excludes, self.languages):
            if packs[-1].files and (size + own > PARTITION_BYTES or len(packs[-1].files) >= PARTITION_FILES):
                packs.append(Files([]))
                size = 0
            packs[-1].files.append((path, language))
            size += own
        return packs

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        place, rows, size = opened(self.root), [], 0
        for path, language in partition.files:
            text = error = None
            held = b""
            try:
                held = place.read(path)
                text = held.decode("utf-8")
            except UnicodeDecodeError as e:
                error = f"not UTF-8 at byte {e.start}"
            except OSError as e:
                error = f"can't be read: {e.strerror or e}"
            rows.append((path, language, text, error, len(held)))
            size += len(held)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "language": pa.string(), "text": pa.string(), "error": pa.string(), "bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


class Project(DataSource):
    """Options: path, excludes (globs by line), languages (by comma)."""

    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        return ProjectReader(dict(self.options))
