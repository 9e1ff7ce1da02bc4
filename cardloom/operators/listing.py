"""Logs and reports: tags of lines, listings by name, snippets, and small tables as text."""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions.text import strip

# What a line of the log, or of an explanation, holds and the tag it gets, first match first.
LOG_TAGS = {"WARNING": ("[WARNING]", "[WARN]"), "ERROR": ("[ERROR]", "[ER]", "Exception"), "DEBUG": ("[DEBUG]",), "OK": ("[OK]", "VALID", "Selesai")}
FIELD_WORDS = ("Nama", "NIK", "Kepala", "Lahir", "Kelamin", "Alamat", "No.", "Nomor", "Field completeness", "Provinsi", "Kecamatan", "Kabupaten", "RT/RW", "Desa")
EXPLAIN_TAGS = {"HEAD": ("=====",), "FIELD": FIELD_WORDS, "STRAT": ("Strategi", "PSM", "Jenis dokumen")}


def _tag(line: Column, tags: dict[str, tuple[str, ...]]) -> Column | None:
    out = None
    for tag, texts in tags.items():
        found = F.lit(False)
        for t in texts:
            found = found | F.contains(line, F.lit(t))
        out = F.when(found, tag) if out is None else out.when(found, tag)
    return out


def log_tag(line: Column) -> Column:
    return _tag(line, LOG_TAGS).otherwise("INFO")


def explain_tag(line: Column) -> Column:
    warn = F.contains(F.upper(line), F.lit("ERROR")) | F.contains(F.lower(line), F.lit("kosong"))
    return _tag(line, EXPLAIN_TAGS).when(warn, "WARN").otherwise("PLAIN")


def logger(root: str, stamp: str, name: str = "cardloom") -> logging.Logger:
    """Logger of the driver: from INFO on to the console, all to ``root/logs/proses_<stamp>.log``."""
    os.makedirs(f"{root}/logs", exist_ok=True)
    out = logging.getLogger(name)
    out.setLevel(logging.DEBUG)
    for old in list(out.handlers):
        out.removeHandler(old)
        old.close()
    for handler, level in ((logging.StreamHandler(), logging.INFO), (logging.FileHandler(f"{root}/logs/proses_{stamp}.log", encoding="utf-8"), logging.DEBUG)):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
        out.addHandler(handler)
    return out


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``path, line_no, value`` of a table read as text: the number of each line in its file, from 0, however the file was split.

    A split's lines come in order; where it begins in the file is known, and what the splits before it hold is a prefix sum over a few numbers.  No task holds more than a split.
    """
    own = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("seen"))
    inside = own.withColumn("k", F.row_number().over(Window.partitionBy("path", "at").orderBy("seen")) - 1)
    splits = own.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"))
    before = splits.select("path", "at", (F.sum("n").over(Window.partitionBy("path").orderBy("at")) - F.col("n")).alias("before"))
    return inside.join(before, ["path", "at"]).select("path", (F.col("before") + F.col("k")).alias("line_no"), "value")


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """``file, line_no, line, tag`` of all logs below ``root/logs``, newest file first by name, lines in their order."""
    rows = numbered_lines(spark.read.option("pathGlobFilter", "*.log").text(f"{root}/logs"))
    named = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "line_no", F.col("value").alias("line"), log_tag(F.col("value")).alias("tag"))
    return named.orderBy(F.desc("file"), "line_no")


def latest(names: DataFrame, pattern: str = r"^laporan_.*\.html$") -> DataFrame:
    """``name``: the greatest of the names that fit; one row, null where there is none."""
    return names.where(F.col("name").rlike(pattern)).agg(F.max("name").alias("name"))


def snippet(text: Column, length: int = 400) -> Column:
    """The beginning of a text, stripped; ``(kosong)`` where there is none."""
    own = strip(F.coalesce(text, F.lit("")))
    return F.when(own == "", "(kosong)").otherwise(F.left(own, F.lit(length)))


def shortened(text: Column, length: int = 80) -> Column:
    """Cut with three dots, or ``-`` where there is nothing."""
    own = F.coalesce(text, F.lit(""))
    return F.when(own == "", "-").when(F.length(own) > length, F.concat(F.left(own, F.lit(length)), F.lit("..."))).otherwise(own)


def append_new(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and those of ``more`` whose keys they haven't."""
    return rows.unionByName(more.join(rows.select(*keys).distinct(), keys, "left_anti").select(*rows.columns))


def elapsed(began: Column, ended: Column) -> Column:
    """Whole milliseconds between two timestamps, with their unit."""
    return F.concat((F.unix_micros(ended) - F.unix_micros(began)).cast("long").__truediv__(1000).cast("long").cast("string"), F.lit(" ms"))


def bar(percent: float, width: int = 20) -> str:
    filled = max(0, min(width, int(percent / 100 * width)))
    return "█" * filled + "░" * (width - filled)


def box(title: str, sections: list[list[tuple[str, object]]], width: int = 55) -> str:
    """A frame with a title and labelled values; a number with ``%`` behind gets a bar."""
    rule = "+" + "-" * (width - 2) + "+"
    lines = [rule, "|" + title.center(width - 2) + "|"]
    for section in sections:
        lines.append(rule)
        for label, value in section:
            own = f"  {label:<26}: {value!s:>6}"
            if isinstance(value, str) and value.endswith("%"):
                own += f" [{bar(float(value[:-1]), 12)}]"
            lines.append("|" + own.ljust(width - 2)[: width - 2] + "|")
    return "\n".join([*lines, rule])
