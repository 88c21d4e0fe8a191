"""An index brought up to date equals one built anew, and only changed files are embedded."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import incremental
from spindrift.operators.store import Store
from spindrift.plans.engine import Engine
from spindrift.plans.provider import HashingProvider
from spindrift.schemas import IndexStatus
from spindrift.sources.config import Config

BODY = "some words of a file that is long enough to be a chunk of its own, "


def rows(df):
    return sorted((r.file_path, r.start_line, r.end_line, r.content, tuple(r.embedding)) for r in df.collect())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for i in range(12):
        (root / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 3}" / f"f{i}.py").write_text(f"{i} {BODY * (i + 1)}")
    (root / "a.go").write_text("package a\n\nfunc Load() {\n\tprintln(1)\n}\n")
    return root


def test_refresh(spark, tmp_path, tree):
    e = Engine(spark, Config(root=str(tree), store=str(tmp_path / "s")), HashingProvider())
    heard = []
    first = e.refresh(lambda done, total: heard.append((done, total)))
    assert (first.files, first.changed, first.removed) == (13, 13, 0) and first.chunks == e.store.items().count()
    assert heard[-1] == (13, 13) and all(a <= b for a, b in zip(heard, heard[1:], strict=False))
    assert e.status() == IndexStatus.OK and "Load" in e.store.summary(str(tree))
    again = e.refresh()
    assert (again.changed, again.removed, again.chunks) == (0, 0, 0)

    (tree / "d0" / "f0.py").write_text("changed " + BODY)
    (tree / "d1" / "f1.py").unlink()
    (tree / "d1" / "new.py").write_text("new " + BODY)
    (tree / "a.go").write_text("package a\n\nfunc Load() {}\n\nfunc Save() {}\n")
    (tree / ".gitignore").write_text("d2/\n")
    third = e.refresh()
    assert (third.files, third.changed, third.removed, third.chunks) == (9, 3, 5, 4)
    other = Engine(spark, Config(root=str(tree), store=str(tmp_path / "other")), HashingProvider())
    other.index()
    assert rows(e.store.items()) == rows(other.store.items()) and e.store.summary(str(tree)) == other.store.summary(str(tree))
    assert e.search("Save", k=1) == other.search("Save", k=1)


def simple(files):
    return files.select(F.col("path").alias("file_path"), F.lit("").alias("symbol"), F.lit("").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("content").cast("string").alias("content"), F.array(F.lit(1.0)).alias("embedding"))


def go(store, state, items_of=simple):
    frame = store.spark.createDataFrame(sorted(state.items()), "path string, content string")
    return incremental.refresh(store, incremental.digests(frame), lambda paths: frame.join(paths, "path", "left_semi"), items_of)


def state_of(store):
    return {r.file_path: r.content for r in incremental.items(store).collect()}


def test_a_refresh_that_breaks_off_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    old, new = {"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"}
    go(store, old)
    replace = store.replace
    monkeypatch.setattr(store, "replace", lambda name, df: (_ for _ in ()).throw(OSError("gone")) if name == "files" else replace(name, df))
    with pytest.raises(OSError):
        go(store, new)
    assert state_of(store) == old and store.read("segments").count() == 4  # written, but not committed
    monkeypatch.undo()
    assert go(store, new).changed == 2 and state_of(store) == new
    incremental.compact(store)
    assert state_of(store) == new and store.read("segments").count() == 3
    assert go(store, {}).removed == 3 and state_of(store) == {}
    assert go(store, old).changed == 2 and state_of(store) == old


def test_what_a_file_was_before_does_not_come_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for content in ("x", "y", "x", None):
        go(store, {"a": content})
        assert state_of(store) == {"a": content}
    assert go(store, {"a": ""}).changed == 0  # null and empty are the same file
