"""Listing and reading of source trees."""

import os

from spindrift.sources import files, ignore


def make(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


def test_kinds_sizes_and_rules(spark, tmp_path):
    """Extensions in any case, special names, ignored folders with what lies below, files that are too large."""
    make(tmp_path, ["main.go", "util.GO", "readme.txt", "a/b/c/Dockerfile", "a/Makefile", "vendor/x.go", "a/node_modules/b/c.go", "gone/x.go", "gone/kept.go", "x.tmp.go"])
    (tmp_path / "large.go").write_bytes(b"x" * (files.MAX_BYTES + 1))
    (tmp_path / "just.go").write_bytes(b"x" * files.MAX_BYTES)
    (tmp_path / ".gitignore").write_text("\n# no\n  gone/  \n!gone/kept.go\n*.tmp.go\n")
    (tmp_path / ".aiignore").write_text("!x.tmp.go\nutil.*\n")
    got = {r.path for r in files.scan(spark, str(tmp_path), ["go"]).collect()}
    assert got == {"main.go", "a/b/c/Dockerfile", "a/Makefile", "just.go", "x.tmp.go"}
    got = {r.path for r in files.scan(spark, str(tmp_path), [".go"], ["main.go", "just.*"]).collect()}
    assert got == {"a/b/c/Dockerfile", "a/Makefile", "x.tmp.go"}


def test_links_and_folders_that_cannot_be_read(spark, tmp_path):
    make(tmp_path, ["a/one.go", "b/two.go"])
    os.symlink(tmp_path, tmp_path / "a" / "round")  # a link to a folder isn't followed
    os.symlink(tmp_path / "b" / "two.go", tmp_path / "a" / "linked.go")
    os.symlink(tmp_path / "none", tmp_path / "a" / "broken.go")
    got = {r.path: bytes(r.content).decode() for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a/one.go": "a/one.go", "b/two.go": "b/two.go", "a/linked.go": "b/two.go"}


def test_wide_and_deep_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ENTRIES", 7)
    monkeypatch.setattr(files, "CONTENT", 50)
    names = [f"wide/f{i}.py" for i in range(60)] + ["/".join("d" * 12) + "/x.py"] + [f"many{i}/x.py" for i in range(20)]
    make(tmp_path, names)
    rules = ignore.parse(["many1*"])
    listed = files.listing(spark, str(tmp_path), rules)
    kept = {n for n in names if not n.startswith("many1")}
    assert {(r.path, r.length) for r in listed.collect()} == {(n, len(n)) for n in kept}
    assert {bytes(r.content).decode() for r in files.contents(listed, str(tmp_path)).collect()} == kept


def test_files_written_are_files_read(spark, tmp_path):
    rows = [("a b/ü.py", b"\x00\xff"), ("x.py", b""), ("d/e/f/Makefile", None)]
    assert files.write_files(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path)) == 3
    assert {r.path: bytes(r.content) for r in files.scan(spark, str(tmp_path)).collect()} == {p: c or b"" for p, c in rows}


def test_a_tree_is_deleted_by_tasks(spark, tmp_path, monkeypatch):
    """Files, hidden ones, links and folders, also those that rules would pass over, are gone when the driver's turn comes; a link's target stays."""
    make(tmp_path, ["kept/x.go", "tree/a/b/c/x.go", "tree/.git/y", "tree/node_modules/z/_w.js", "tree/odd [1]*.rs", *(f"tree/m{i}/Makefile" for i in range(20))])
    (tmp_path / "tree" / "empty").mkdir()
    os.symlink(tmp_path / "kept", tmp_path / "tree" / "a" / "linked")
    os.symlink(tmp_path / "none", tmp_path / "tree" / "broken")
    left, delete = [], files._delete
    monkeypatch.setattr(files, "_delete", lambda spark, root: (left.append(os.listdir(root)), delete(spark, root)))
    files.delete_tree(spark, str(tmp_path / "tree"))
    assert left == [[]]
    assert os.listdir(tmp_path) == ["kept"] and os.listdir(tmp_path / "kept") == ["x.go"]
