"""A data source that writes single files in a folder tree, in two phases: ``df.write.format("cardloom_tree").option("root", root).mode("append").save()``.

Rows are ``path, content``, a text for each file below ``root``, or ``path, source``, a file to be moved there.  Tasks write into a folder of their own below ``root/.staging``; nothing shows in the
tree until all tasks are through.  ``commit`` first notes which tasks count, in one file that appears at once, then renames their files to their places and, for moves, removes the sources.
``abort`` removes what was staged: a job that fails leaves the tree, and the sources, as they were.  Where the driver dies between note and last rename, :func:`finish` does the rest; a write
that has no note is taken back by it.  All of this can be repeated.

The driver renames, it holds no list: each task's rows lie in a journal beside its files and are read one by one, ``THREADS`` tasks at a time.

Defined results
* a content takes the place of a file that is there; of rows with one path in one write any is kept, so make paths unique before;
* a move never takes the place of a file.  ``outcome`` in the report is ``moved``, ``already moved`` (no source, but the target is there, as after an earlier attempt), ``target exists`` or ``no source``;
* a null content is an empty file; a null path, one that is absolute or leads out of the root fails the write; an empty table changes nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "cardloom_tree"
STAGING, JOURNAL, NOTE = ".staging", "rows.jsonl", "committed.json"
THREADS = 16


@dataclass
class Staged(WriterCommitMessage):
    """Folder of a task that is through."""

    folder: str


def _inside(path: str | None) -> str:
    parts = (path or "").split("/")
    if not path or path.startswith("/") or ".." in parts or parts[0] == STAGING:
        raise ValueError(f"no path below the root: {path!r}")
    return path


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, report: str | None = None):
        self.root, self.report = root, report
        self.staging = os.path.join(root, STAGING, uuid.uuid4().hex)
        os.makedirs(self.staging)  # by the driver: a task that goes on after an abort finds no folder to write in

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.mkdir(folder)
        try:
            with open(os.path.join(folder, JOURNAL), "w", encoding="utf-8") as journal:
                for n, row in enumerate(iterator):
                    own, path = row.asDict(), _inside(row["path"])
                    line = {"file": str(n), "path": path, "source": own.get("source")}
                    if "source" in own:
                        there = os.path.exists(os.path.join(self.root, path))
                        if own["source"] is None or not os.path.exists(own["source"]):
                            line["outcome"] = "already moved" if there else "no source"
                        elif there:
                            line["outcome"] = "target exists"
                        else:
                            shutil.copy2(own["source"], os.path.join(folder, str(n)))
                    else:
                        with open(os.path.join(folder, str(n)), "w", encoding="utf-8", newline="") as f:
                            f.write(own["content"] or "")
                    journal.write(json.dumps(line, ensure_ascii=False) + "\n")
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Staged(os.path.basename(folder))

    def commit(self, messages: list[Staged | None]) -> None:
        note = os.path.join(self.staging, NOTE)
        with open(note + ".part", "w", encoding="utf-8") as f:
            json.dump({"report": self.report, "folders": [m.folder for m in messages if m]}, f)
        os.rename(note + ".part", note)
        publish(self.root, self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        _remove(self.root, self.staging)


def _remove(root: str, staging: str) -> None:
    gone = staging + ".gone"
    try:
        os.rename(staging, gone)
    except OSError:
        pass  # removed before
    shutil.rmtree(gone, ignore_errors=True)
    try:
        os.rmdir(os.path.join(root, STAGING))
    except OSError:
        pass  # another write has its folder there, or there is none


def _publish_one(root: str, folder: str, report: str | None) -> None:
    told = os.path.join(report, f"part-{os.path.basename(folder)}.json") if report else None
    out = open(told + ".part", "w", encoding="utf-8") if told else None
    with open(os.path.join(folder, JOURNAL), encoding="utf-8") as journal:
        for text in journal:
            line = json.loads(text)
            staged, target = os.path.join(folder, line["file"]), os.path.join(root, line["path"])
            outcome = line.get("outcome")
            if os.path.exists(staged):
                if line["source"] is not None and os.path.exists(target):
                    outcome = "target exists"  # the copy goes with the staging folder, so a repeat comes here again
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(staged, target)
            if not outcome and line["source"] is not None:
                outcome = "moved"
                if os.path.exists(line["source"]):
                    os.remove(line["source"])
            if out:
                out.write(json.dumps({"path_asal": line["source"], "path": line["path"], "outcome": outcome}, ensure_ascii=False) + "\n")
    if out:
        out.close()
        os.replace(told + ".part", told)


def publish(root: str, staging: str) -> None:
    """Rename the files of a committed write to their places."""
    with open(os.path.join(staging, NOTE), encoding="utf-8") as f:
        note = json.load(f)
    if note["report"]:
        os.makedirs(note["report"], exist_ok=True)
    with ThreadPoolExecutor(THREADS) as pool:
        for done in [pool.submit(_publish_one, root, os.path.join(staging, folder), note["report"]) for folder in note["folders"]]:
            done.result()
    _remove(root, staging)


def finish(root: str) -> tuple[int, int]:
    """Writes that were completed, and writes that were taken back, after a driver was lost; no write to ``root`` may be running."""
    top, completed, removed = os.path.join(root, STAGING), 0, 0
    for name in os.listdir(top) if os.path.isdir(top) else []:
        staging = os.path.join(top, name)
        if name.endswith(".gone"):
            shutil.rmtree(staging, ignore_errors=True)
        elif os.path.exists(os.path.join(staging, NOTE)):
            publish(root, staging)
            completed += 1
        else:
            _remove(root, staging)
            removed += 1
    return completed, removed


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("files are written one by one: use mode append")
        if "path" not in schema.names or len({"content", "source"} & set(schema.names)) != 1:
            raise ValueError("columns are path, and content or source")
        return TreeWriter(self.options["root"], self.options.get("report"))


def write_tree(rows: DataFrame, root: str, report: str | None = None) -> None:
    """Write ``path, content`` or ``path, source`` below ``root``, a folder that driver and executors share."""
    spark = rows.sparkSession
    spark.dataSource.register(TreeSource)
    out = rows.write.format(NAME).option("root", root).mode("append")
    (out.option("report", report) if report else out).save()
