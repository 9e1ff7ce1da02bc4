"""Files in a tree: all of a write or nothing, whatever fails and when."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cardloom.operators import naming
from cardloom.sources import sinks, tree


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file()}


@pytest.fixture
def contents(spark):
    return spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/f"), "id", F.lit(".txt")).alias("path"), F.col("id").cast("string").alias("content")).repartition(4)


def test_contents_are_written(spark, contents, tmp_path):
    tree.write_tree(contents.withColumn("more", F.lit(1)), str(tmp_path))
    want = {f"d{i % 3}/f{i}.txt": str(i) for i in range(40)}
    assert files(tmp_path) == want
    # again, and with other contents
    tree.write_tree(contents, str(tmp_path))
    assert files(tmp_path) == want
    tree.write_tree(spark.createDataFrame([("d0/f0.txt", None), ("new", "é")], "path string, content string"), str(tmp_path))
    assert files(tmp_path) == want | {"d0/f0.txt": "", "new": "é"}
    tree.write_tree(contents.limit(0), str(tmp_path))
    assert len(files(tmp_path)) == 41 and not (tmp_path / tree.STAGING).exists()


def test_a_task_that_fails_half_way_leaves_nothing(spark, contents, tmp_path):
    tree.write_tree(contents.where("path LIKE 'd0%'"), str(tmp_path))
    before = files(tmp_path)
    broken = contents.withColumn("content", F.when(F.col("content") == "37", F.raise_error(F.lit("broken"))).otherwise(F.concat("content", F.lit("!"))))
    with pytest.raises(Exception, match="broken"):
        tree.write_tree(broken, str(tmp_path))
    assert files(tmp_path) == before and not (tmp_path / tree.STAGING).exists()
    tree.write_tree(contents, str(tmp_path))
    assert len(files(tmp_path)) == 40


@pytest.mark.parametrize("path", [None, "", "/etc/x", "a/../../x", ".staging/x"])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    with pytest.raises(Exception, match="no path below the root"):
        tree.write_tree(spark.createDataFrame([("ok", "x"), (path, "x")], "path string, content string"), str(tmp_path))
    assert files(tmp_path) == {}


def test_other_tables_and_modes_are_refused(spark, contents, tmp_path):
    for rows in (contents.drop("content"), contents.withColumn("source", F.lit("x"))):
        with pytest.raises(Exception, match="columns are path"):
            tree.write_tree(rows, str(tmp_path))
    with pytest.raises(Exception, match="mode append"):
        contents.write.format(tree.NAME).option("root", str(tmp_path)).mode("overwrite").save()


def sources(root, names="abcd"):
    for n in names:
        (root / "in").mkdir(exist_ok=True)
        (root / f"in/{n}").write_text(n)


def test_moves_that_fail_leave_all_sources(spark, tmp_path):
    sources(tmp_path)
    rows = spark.createDataFrame([(f"out/{n}", str(tmp_path / f"in/{n}")) for n in "abc"] + [("../x", str(tmp_path / "in/d"))], "path string, source string").repartition(2)
    with pytest.raises(Exception, match="no path below the root"):
        tree.write_tree(rows, str(tmp_path))
    assert files(tmp_path) == {f"in/{n}": n for n in "abcd"}


def test_a_driver_that_is_lost_in_commit(tmp_path):
    """The writer without Spark: two tasks and a failed attempt, then a commit that stops after its note, and after some renames."""
    for stop in range(4):
        root = tmp_path / str(stop)
        root.mkdir()
        sources(root)
        (root / "out").mkdir()
        (root / "out/b").write_text("old")
        writer = tree.TreeWriter(str(root), str(root / "report"))
        row = lambda n: Row(path=f"out/{n}", source=str(root / f"in/{n}"))
        messages = [writer.write(iter([row("a"), row("b")])), writer.write(iter([row("c"), row("d"), row("e")]))]
        with pytest.raises(ValueError):
            writer.write(iter([row("a"), Row(path="", source="x")]))
        os.makedirs(os.path.join(writer.staging, "attempt"))  # left behind by a task that was killed
        note = {"report": str(root / "report"), "folders": [m.folder for m in messages]}
        if stop:
            (Path(writer.staging) / tree.NOTE).write_text(json.dumps(note))
        if stop == 2:  # renamed, source not yet removed
            (root / "out/a").write_text((Path(writer.staging) / messages[0].folder / "0").read_text())
            os.remove(Path(writer.staging) / messages[0].folder / "0")
        if stop == 3:  # one task's files are there, and its report
            (root / "report").mkdir()
            tree._publish_one(str(root), os.path.join(writer.staging, messages[1].folder), str(root / "report"))
        assert tree.finish(str(root)) == ((1, 0) if stop else (0, 1))
        left = files(root)
        told = {k: v for k, v in left.items() if k.startswith("report/")}
        rest = {k: v for k, v in left.items() if k not in told}
        if not stop:
            assert rest == {"out/b": "old", **{f"in/{n}": n for n in "abcd"}}
            continue
        assert rest == {"in/b": "b", "out/a": "a", "out/b": "old", "out/c": "c", "out/d": "d"}
        outcomes = {r["path"]: r["outcome"] for text in told.values() for r in map(json.loads, text.splitlines())}
        assert outcomes == {"out/a": "moved", "out/b": "target exists", "out/c": "moved", "out/d": "moved", "out/e": "no source"}
        assert tree.finish(str(root)) == (0, 0)


def test_move_plans_repeat(spark, tmp_path):
    sources(tmp_path)
    plan = spark.createDataFrame([(str(tmp_path / f"in/{n}"), f"KTP/{n}") for n in "abcde"], "path_asal string, path string").repartition(3)
    told = lambda: {r["path"]: r["outcome"] for r in naming.apply_plan(plan, str(tmp_path), str(tmp_path / "moves")).collect()}
    assert told() == {f"KTP/{n}": "moved" for n in "abcd"} | {"KTP/e": "no source"}
    assert told() == {f"KTP/{n}": "already moved" for n in "abcd"} | {"KTP/e": "no source"}
    assert {k: v for k, v in files(tmp_path).items() if not k.startswith("moves/")} == {f"KTP/{n}": n for n in "abcd"}


def test_one_file_per_document(spark, tmp_path):
    rows = spark.createDataFrame([("a b.jpg", "", "1"), ("a b.jpg", "", "2"), ("x", "é/1.jpg", "0")], "nama_file_asli string, nama_file_baru string, path_asal string")
    shared = sinks.write_each(rows, str(tmp_path))
    assert [tuple(r) for r in shared.collect()] == [("a_b.jpg", 2)]
    assert {k: json.loads(v)["path_asal"] for k, v in files(tmp_path).items()} == {"a_b.jpg.json": "2", "é_1.jpg.json": "0"}
