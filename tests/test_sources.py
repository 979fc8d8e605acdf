"""Reading a project's sources: every file that a scan sees is a row, nothing else is opened."""

import os
import subprocess

import pytest

from mutalake import config
from mutalake.plans import planning
from mutalake.sources import files, ignore, project


def write(root, names, text="x = 1\n"):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def read(spark, root, *args, **options):
    rows = files.read_sources(spark, str(root), *args, **options).collect()
    assert len({r.file for r in rows}) == len(rows)
    return {r.file: r for r in rows}


def test_every_source_is_a_row(spark, tmp_path):
    names = ["a.py", "__init__.py", "_private.rs", "__tests__/x.test.js", "pkg/__tests__/_deep/__main__.py", "with space/b c.py", "per%20cent/%41.go", "sub/target/ok.rs", "é/ü.cs"]
    write(tmp_path, [*names, ".hidden/c.py", ".hid.py", "target/d.rs", "node_modules/x/e.js", "e.txt", "noext", "a.py.bak"])
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    (tmp_path / "linked").symlink_to(tmp_path / "sub")
    got = read(spark, tmp_path)
    assert sorted(got) == sorted(names)
    assert got["with space/b c.py"].text == "x = 1\n" and got["with space/b c.py"].bytes == 6 and got["a.py"].language == "python"
    assert set(read(spark, tmp_path, languages=["rust", "go"])) == {"_private.rs", "per%20cent/%41.go", "sub/target/ok.rs"}
    assert set(read(spark, tmp_path, ["*.js", "sub/**", "/é"])) == set(names) - {"__tests__/x.test.js", "sub/target/ok.rs", "é/ü.cs"}


def test_roots(spark, tmp_path, monkeypatch):
    """A relative root, one with a slash at its end, one whose text occurs again inside, and an empty folder."""
    root = tmp_path / "app"
    write(root, ["x.py", f"lib{tmp_path}/app/y.py"])
    want = {"x.py", f"lib{tmp_path}/app/y.py"}
    assert set(read(spark, root)) == set(read(spark, f"{root}/")) == set(read(spark, f"file://{root}")) == want
    monkeypatch.chdir(tmp_path)
    assert set(read(spark, "app")) == set(read(spark, "./app/../app")) == want
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none") == {}
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, str(tmp_path / "gone"))
    with pytest.raises(ValueError):
        files.read_sources(spark, str(root), ["a["])


def test_ignore_files(spark, tmp_path):
    """Deeper files win over shallower ones, .ignore over .gitignore, the last line over earlier ones; a folder left out is not entered."""
    write(tmp_path, ["a.py", "gen/b.py", "gen/keep.py", "sub/gen/c.py", "sub/d_test.py", "sub/e_test.py", "sub/deep/f.py", "logs/g.py", "logs/h/keep.py", "x/build", "x/build.py", "y/z.go", "y/w.go", "q/r.py"])
    (tmp_path / ".ignore").write_text("# comment\n\n/gen/*\n!gen/keep.py\nlogs/\n")
    (tmp_path / "logs" / ".ignore").write_text("!h\n")  # never read: the folder is left out
    (tmp_path / "sub" / ".ignore").write_text("*_test.py\n!e_test.py\nde[a-f]p\n")
    (tmp_path / ".gitignore").write_text("y/\nq/**\nbuild/\n")
    got = {"a.py", "gen/keep.py", "sub/gen/c.py", "sub/e_test.py", "x/build.py", "y/w.go", "y/z.go", "q/r.py"}
    assert set(read(spark, tmp_path)) == got  # no repository: version control's file doesn't count
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("a.py\n")
    (tmp_path / "y" / ".ignore").write_text("w.go\n")
    assert set(read(spark, tmp_path)) == got - {"a.py", "y/z.go", "y/w.go", "q/r.py"}
    assert set(read(spark, tmp_path / "y")) == {"z.go"}  # a root is read whatever the folders above say of it
    assert set(read(spark, tmp_path / "sub")) == {"gen/c.py", "e_test.py"}


@pytest.mark.parametrize(("line", "fits", "misses"), [
    ("*.py", ["a.py", "x/b.py"], ["a.pyc", "a.py/x"]),
    ("/a", ["a"], ["x/a"]),
    ("a/b", ["a/b"], ["x/a/b", "a/b/c"]),
    ("**/b", ["b", "a/b", "a/c/b"], ["ab"]),
    ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb"]),
    ("a?[0-9].c", ["ab1.c"], ["a1.c", "a/1.c", "abx.c"]),
    ("[!a]b", ["cb", "x/cb"], ["ab"]),
    ("\\#x", ["#x"], ["x"]),
    ("\\!x ", ["!x"], ["x"]),
])
def test_globs(line, fits, misses):
    own = ignore.rules(line)
    assert all(ignore.verdict(own, x, False) for x in fits) and not any(ignore.verdict(own, x, False) for x in misses)


def test_like_git(spark, tmp_path):
    """The same files as git's own listing."""
    write(tmp_path, ["a.py", "b/c.py", "b/x/y.py", "d/e.py", "d/k.py", "f_gen.py", "g/f_gen.py", "h/i/j.py", "h/z.py", "sp ace/m.py"])
    (tmp_path / ".gitignore").write_text("/b/*\n!/b/x\n*_gen.py\nd/**\n!d/k.py\nh/*/\nsp\\ ace/\n")
    (tmp_path / "g" / ".gitignore").write_text("!f_gen.py\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True, env={**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null"}).stdout
    git("init", "-q")
    want = {x for x in git("ls-files", "--others", "--exclude-standard", "-z").split("\0") if x.endswith(".py")}
    assert {p for p, *_ in project.listed(project.opened(str(tmp_path)), [])} == want
    assert set(read(spark, tmp_path)) == want


def test_excluded_bytes_are_not_read(spark, tmp_path):
    """Sparse files of a terabyte lie in every kind of place that is left out; bytes counts what was read."""
    write(tmp_path, ["a.py", "b/c.rs"])
    for name in ("node_modules/big.js", ".git/big.py", ".big.py", "target/x/big.rs", "big.unknown", "gen/big.py", "ign/big.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with open(tmp_path / name, "wb") as f:
            f.truncate(1 << 40)
    (tmp_path / ".ignore").write_text("ign\n")
    got = read(spark, tmp_path, ["gen"])
    assert {k: r.bytes for k, r in got.items()} == {"a.py": 6, "b/c.rs": 6}


def test_odd_files(spark, tmp_path):
    """A file that isn't UTF-8 is a row with a reason; the others are read."""
    write(tmp_path, ["a.py"])
    (tmp_path / "latin.py").write_bytes("# caf\xe9\n".encode("latin-1"))
    (tmp_path / "empty.py").write_bytes(b"")
    (tmp_path / "bom.py").write_bytes(b"\xef\xbb\xbfx = 1\n")
    got = read(spark, tmp_path)
    assert got["latin.py"].text is None and got["latin.py"].error == "not UTF-8 at byte 5" and got["empty.py"].text == "" and got["a.py"].error is None and got["bom.py"].text[1:] == "x = 1\n"


def test_partitions_are_packed_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(project, "PARTITION_BYTES", 100)
    monkeypatch.setattr(project, "PARTITION_FILES", 5)
    write(tmp_path, [f"s{i}.py" for i in range(12)], "x")
    write(tmp_path, ["big.py"], "y" * 500)
    packs = [p.files for p in project.ProjectReader({"path": str(tmp_path)}).partitions()]
    assert sorted(f for p in packs for f, _ in p) == sorted([*(f"s{i}.py" for i in range(12)), "big.py"]) and max(map(len, packs)) <= 5 and [("big.py", "python")] in packs
    assert project.ProjectReader({"path": str(tmp_path), "languages": "go"}).partitions()[0].files == []


def test_plan_of_a_project(spark, tmp_path):
    """The root's ignore file counts in a plan, with or without a repository and at any depth, and names with underscores are planned."""
    write(tmp_path, ["__init__.py", "gen/a.py", "sub/gen/b.py", "_x.py"], "def f(x):\n    return x < 1\n")
    (tmp_path / "latin.py").write_bytes(b"\xe9")
    (tmp_path / ".gitignore").write_text("/gen\n!gen/keep.py\n")
    plan = planning.build_plan(spark, str(tmp_path), config.resolve({"mutation.operators": ["comparison_boundary"]}, {}))
    assert sorted(r.file for r in plan.candidates.collect()) == ["__init__.py", "_x.py"]
    assert [(r.file, r.error) for r in plan.unreadable().collect()] == [("latin.py", "not UTF-8 at byte 0")]


def test_texts_are_parsed_once(spark, tmp_path):
    """Copies share a parse; a second plan parses nothing, a changed file one text, another catalog all again."""
    root, store = tmp_path / "p", tmp_path / "store"
    write(root, ["a.py", "b/copy.py", "c.py"], "def f(x):\n    return x < 1\n")
    write(root, ["d.js", "e.py"], "function f(x) { return x < 1 }\n")
    settings = config.resolve({"mutation.operators": ["comparison_boundary"]}, {})
    plan = lambda **o: sorted((r.id, r.function) for r in planning.build_plan(spark, str(root), settings, store=str(store), **o).candidates.collect())
    held = lambda: sum(spark.read.parquet(str(v)).count() for v in store.iterdir())
    first = plan()
    assert [i for i, _ in first] == ["a.py:2:13:python.comparison_boundary", "b/copy.py:2:13:python.comparison_boundary", "c.py:2:13:python.comparison_boundary", "d.js:1:25:javascript.comparison_boundary"]
    assert held() == 3 and first == sorted((r.id, r.function) for r in planning.build_plan(spark, str(root), settings).candidates.collect())
    files_ = {str(f) for f in store.rglob("*")}
    assert plan() == first and {str(f) for f in store.rglob("*")} == files_
    (root / "c.py").write_text("def g(x):\n    return x > 1\n")
    assert [(f, i) for i, f in plan() if i.startswith("c.py")] == [("g", "c.py:2:13:python.comparison_boundary")] and held() == 4
    write(root, ["n.py"], "")
    plan(catalog={"python.comparison_boundary": []})
    assert len(list(store.iterdir())) == 2 and held() == 9
