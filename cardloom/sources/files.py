"""Sources: images below a folder, true values from CSV, text variants, settings."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.text import strip

# Settings and their defaults.
DEFAULTS = {"input": "data", "lang": "ind", "export": "json", "file_template": "{jenis}_{nama}", "folder_template": "{JENIS}/{jenis}_{nama}", "separator": "_", "deskew": True, "dry_run": False, "ground_truth": "", "tesseract_path": ""}

MEANINGS = {
    "input": "folder with the documents' folders",
    "lang": "language of the OCR hook",
    "export": "json, csv or both",
    "file_template": "name of a file, from template variables",
    "folder_template": "folder of a file; / makes levels",
    "separator": "between words, _ or -",
    "deskew": "straighten images before OCR",
    "dry_run": "plan only, no file is moved",
    "ground_truth": "CSV of true values; empty: none",
    "tesseract_path": "program of the OCR hook; empty: found on the path",
}


def only_images(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose ``path`` is an image and lies in no skipped folder; extensions in any case, folders as they are written."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    folders = F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/")
    return rows.where(extension.isin(*lx.IMAGE_EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, lx.SKIPPED_FOLDERS))))


def scan_images(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """``path, modificationTime, length`` and ``content`` of the images below ``root``; the bytes are only read if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return only_images(rows if content else rows.drop("content"))


def recognise(images: DataFrame, read: Callable[[bytes, int], str], modes: tuple[int, ...] = (6, 11, 3)) -> DataFrame:
    """``path, label, psm, text`` of an OCR function for each image and mode; bytes don't leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, "raw", m, read(bytes(c), m)) for p, c in zip(batch["path"], batch["content"], strict=True) for m in modes]
            yield pd.DataFrame(rows, columns=["path", "label", "psm", "text"])

    return images.select("path", "content").mapInPandas(run, "path string, label string, psm int, text string")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """True values, all strings and trimmed; of rows with one ``nama_file`` the last counts, blank ones go; of several files the last by name.

    Raises ``ValueError`` without a ``nama_file`` column, ``FileNotFoundError`` where there is no file.  A file isn't split, as values may hold line feeds.
    """
    try:
        rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from None
        raise
    names = {c: c.lstrip("﻿").strip().lower() for c in rows.columns}
    names = {c: {"kepala_keluarga": "nama_kepala", "rt_rw": "rtrw"}.get(n, n) for c, n in names.items()}
    if "nama_file" not in names.values():
        raise ValueError("the table of true values has no column nama_file")
    rows = rows.select(*[strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for c, n in names.items()], F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("__row"))
    others = [n for n in names.values() if n != "nama_file"]
    last = rows.where("nama_file <> ''").groupBy("nama_file").agg(F.max_by(F.struct(*others), "__row").alias("v"))
    return last.select("nama_file", "v.*")


def load_settings(path: str) -> dict:
    """Settings of a JSON or YAML file over the defaults; keys that start with an underscore are left out, unknown ones with a warning."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise ValueError(f"settings are read from JSON or YAML, not from {kind or 'a file without extension'}")
    with open(path, encoding="utf-8") as f:
        try:
            if kind == ".json":
                own = json.load(f)
            else:
                import yaml

                own = yaml.safe_load(f) or {}
        except ImportError as e:
            raise ValueError("YAML needs the yaml package") from e
        except Exception as e:
            raise ValueError(f"the settings can't be read: {e}") from e
    unknown = [k for k in own if not k.startswith("_") and k not in DEFAULTS]
    if unknown:
        warnings.warn(f"unknown settings are ignored: {unknown}", stacklevel=2)
    return DEFAULTS | {k: v for k, v in own.items() if k in DEFAULTS}


def write_settings_template(path: str = "config.json") -> None:
    """All settings with their defaults, and what they mean under a key that is not read."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"_keterangan": MEANINGS, **DEFAULTS}, f, ensure_ascii=False, indent=2)
