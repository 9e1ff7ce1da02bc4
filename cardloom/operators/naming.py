"""Target paths from templates, and plans of moves.

Nothing here touches a file: a plan is a DataFrame, and :func:`apply_plan` is the one step with side effects.
"""

from __future__ import annotations

import os
import re
import shutil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.text import digits, slugify
from cardloom.sources import tree


def validate_template(template: str) -> list[str]:
    """Unknown variables of a template; an empty template raises."""
    if not template or not template.strip():
        raise ValueError("the template is empty")
    return [v for v in re.findall(r"\{(\w+)\}", template) if v not in lx.TEMPLATE_VARIABLES]


def _padded(x: Column) -> Column:
    """First six characters, filled with zeros on the right."""
    return F.rpad(F.left(x, F.lit(6)), 6, "0")


def template_context(sep: str = "_", stamp: str = "19700101_000000") -> dict[str, Column]:
    """Variables of a template over the columns of a record; ``stamp`` is the batch's time, one for all rows."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    or_else = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), F.lit(y))
    kk = F.col("jenis_dokumen") == "kk"
    only_kk = lambda x: F.when(kk, x).otherwise("")
    name = or_else(slugify(F.col("nama"), sep), "unknown")
    number = only_kk(digits(col("nomor_kk")))
    nik = F.coalesce(F.nullif(number, F.lit("")), digits(col("nik")))
    head = only_kk(slugify(F.col("nama_kepala"), sep))
    gender = F.upper(col("jenis_kelamin"))
    return {
        "jenis": F.lower("jenis_dokumen"),
        "JENIS": F.upper("jenis_dokumen"),
        "nama": name,
        "NAMA": F.upper(name),
        "nik": or_else(nik, "nonik"),
        "nik6": _padded(nik),
        "tgl": or_else(F.replace(col("tanggal_lahir"), F.lit("/"), F.lit("-")), "notgl"),
        "tgl_compact": or_else(digits(col("tanggal_lahir")), "notgl"),
        "tempat": or_else(slugify(F.col("tempat_lahir"), sep), "notempat"),
        "jk": F.when(gender == "LAKI-LAKI", "L").when(gender == "PEREMPUAN", "P").otherwise("X"),
        "tanggal": F.lit(stamp[:8]),
        "timestamp": F.lit(stamp),
        "nokk": number,
        "nokk6": F.when(number == "", "").otherwise(_padded(number)),
        "kepala": head,
        "KEPALA": F.upper(head),
        "desa": only_kk(slugify(F.col("desa_kelurahan"), sep)),
        "kecamatan": only_kk(slugify(F.col("kecamatan"), sep)),
        "kabupaten": only_kk(slugify(F.col("kabupaten_kota"), sep)),
        "provinsi": only_kk(slugify(F.col("provinsi"), sep)),
        "rtrw": only_kk(F.replace(col("rtrw"), F.lit("/"), F.lit(sep))),
    }


def apply_template(template: str, context: dict[str, Column], sep: str = "_") -> Column:
    """Path of safe segments; without any, kind and name."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [context.get(x, F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)]
    whole = F.replace(F.concat(*parts), F.lit("\\"), F.lit("/"))

    def safe(segment):
        kept = F.regexp_replace(segment, r"[^a-zA-Z0-9_\-\.]", "")
        return F.regexp_replace(F.regexp_replace(kept, r"[_\-]{2,}", sep), f"^[{sep}\\-]+|[{sep}\\-]+$", "")

    path = F.array_join(F.filter(F.transform(F.split(whole, "/", -1), safe), lambda s: s != ""), "/")
    return F.coalesce(F.nullif(path, F.lit("")), F.concat(context["jenis"], F.lit("_"), context["nama"]))


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def plan_paths(records: DataFrame, file_template: str = "{jenis}_{nama}", folder_template: str = "{JENIS}/{jenis}_{nama}", sep: str = "_") -> DataFrame:
    """``records`` with ``folder, file, action``: templates for successful ones, ``ERROR/<subfolder>/<name>`` for the others."""
    context = template_context(sep)
    ok = (F.col("jenis_dokumen") != "unknown") & (F.col("nama") != "")
    name = F.concat(apply_template(file_template, context, sep), F.lower(extension(F.col("nama_file_asli"))))
    out = records.withColumn("folder", F.when(ok, apply_template(folder_template, context, sep)).otherwise(F.concat_ws("/", F.lit("ERROR"), F.nullif("subfolder", F.lit("")))))
    return out.withColumn("file", F.when(ok, name).otherwise(F.col("nama_file_asli"))).withColumn("action", F.when(ok, "archive").otherwise("error"))


def suffix_duplicates(plan: DataFrame, order: str, folder: str = "folder", file: str = "file", existing: DataFrame | None = None) -> DataFrame:
    """``plan`` with ``path``: rows that share one, or meet a file of ``existing`` (``folder, file``), get the smallest free ``_1``, ``_2`` …
    before the extension, by ``order``; a suffixed extension is lower case.

    A number is taken if a file or another row of the plan has that name already, so the paths of a plan are all different and new.
    """
    ext = extension(F.col(file))
    stem = F.substring(F.col(file), F.lit(1), F.length(file) - F.length(ext))
    rows = plan.withColumn("__stem", stem).withColumn("__ext", F.lower(ext))
    place = F.row_number().over(Window.partitionBy(folder, file).orderBy(order))
    there = plan.select(F.col(folder).alias("folder"), F.col(file).alias("file")).limit(0) if existing is None else existing.select("folder", "file")
    names = plan.select(F.col(folder).alias("folder"), F.col(file).alias("file")).distinct()
    # the first of a name has it, unless a file has it
    blocked = there.distinct().select(F.col("folder").alias("__folder"), F.col("file").alias("__file"), F.lit(True).alias("__there"))
    rows = rows.withColumn("__place", place).join(blocked, (F.col(folder) == F.col("__folder")) & (F.col(file) == F.col("__file")), "left").drop("__folder", "__file")
    rows = rows.withColumn("__late", (F.col("__place") > 1) | F.col("__there").isNotNull())
    # numbers that are taken: names that end in one, among files and the plan's own
    numbered = there.unionByName(names).distinct().select("folder", F.regexp_extract("file", r"^(.*)_([1-9]\d{0,8})(\.[^./]+)?$", 1).alias("stem"), F.regexp_extract("file", r"_([1-9]\d{0,8})(\.[^./]+)?$", 1).try_cast("long").alias("n"), extension(F.col("file")).alias("ext"))
    taken = numbered.where((F.col("n") > 0) & (F.col("ext") == F.lower("ext"))).distinct()
    # the k-th late row takes the k-th free number: k and as many taken ones as have k or fewer free ones before them
    group = ["__group", "__key"]
    key = F.struct(F.col("folder"), F.col("stem"), F.col("ext"))
    before = F.row_number().over(Window.partitionBy("folder", "stem", "ext").orderBy("n"))
    events = taken.withColumn("__key", F.col("n") - before).select(F.to_json(key).alias("__group"), "__key", F.lit(1).alias("__taken"))
    own = F.struct(F.col(folder).alias("folder"), F.col("__stem").alias("stem"), F.col("__ext").alias("ext"))
    late = rows.where("__late").withColumn("__group", F.to_json(own))
    late = late.withColumn("__key", F.row_number().over(Window.partitionBy("__group").orderBy(order, file)) - 1).withColumn("__taken", F.lit(0))
    line = Window.partitionBy("__group").orderBy("__key", F.desc("__taken")).rowsBetween(Window.unboundedPreceding, 0)
    every = late.unionByName(events, allowMissingColumns=True).withColumn("__n", F.col("__key") + 1 + F.sum("__taken").over(line))
    late = every.where("__taken = 0").withColumn("__name", F.concat("__stem", F.lit("_"), F.col("__n").cast("string"), "__ext")).drop("__n", "__taken", *group)
    both = rows.where("NOT __late").withColumn("__name", F.col(file)).unionByName(late)
    return both.withColumn("path", F.concat_ws("/", folder, "__name")).select(*plan.columns, "path")


def existing_files(spark, root: str) -> DataFrame:
    """``folder, file`` of all files below ``root``, relative to it; no contents are read."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), root.rstrip("/").split(":")[-1].lstrip("/") + "/", -1)
    return own.select(F.regexp_extract(below, r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract(below, r"([^/]*)$", 1).alias("file"))


def apply_plan(plan: DataFrame, root: str, report: str) -> DataFrame:
    """Move ``path_asal`` to ``root/path`` for each row; ``path_asal, path, outcome`` of all rows are written to ``report`` and returned.

    The moves are written in two phases (:mod:`cardloom.sources.tree`): all copies are made before a file of the tree or a source changes, and a job that
    fails changes nothing.  ``outcome`` is ``moved``, ``already moved`` (the source is gone and the target there, as after an earlier attempt), ``target exists``
    or ``no source``.  ``root`` must be a folder that driver and executors share; an older report in its folder is replaced.
    """
    shutil.rmtree(report, ignore_errors=True)
    os.makedirs(report)
    tree.write_tree(plan.select("path", F.col("path_asal").alias("source")), root, report)
    return plan.sparkSession.read.schema("path_asal string, path string, outcome string").json(report)
