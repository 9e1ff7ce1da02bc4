"""Sinks: records as JSON or CSV, reports on scores, names and figures, and an HTML report.

Tables of records are written by all tasks, as folders of part files; files that hold figures only are written by the driver.
"""

from __future__ import annotations

import csv
import html
import io
import json
import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cardloom.functions.text import first_of
from cardloom.operators import evaluate
from cardloom.sources import tree

# Columns of the flat table, in order.
FLAT_COLUMNS = """
nama_file_asli nama_file_baru subfolder jenis_dokumen status nama nik tempat_lahir tanggal_lahir jenis_kelamin alamat
nomor_kk nama_kepala desa_kelurahan kecamatan kabupaten_kota provinsi rtrw no_sim field_completeness fields_filled
fields_total waktu_proses
""".split()
# Names of the fields in the table of scores, in order.
FIELD_LABELS = {
    "nama": "Nama", "nik": "NIK", "tempat_lahir": "Tempat Lahir", "tanggal_lahir": "Tanggal Lahir", "jenis_kelamin": "Jenis Kelamin",
    "jenis_dokumen": "Jenis Dokumen", "alamat": "Alamat", "nomor_kk": "Nomor KK", "nama_kepala": "Nama Kepala", "desa_kelurahan": "Desa/Kelurahan",
    "kecamatan": "Kecamatan", "kabupaten_kota": "Kab/Kota", "provinsi": "Provinsi", "rtrw": "RT/RW", "no_sim": "No SIM",
}
#: Mark at the start of UTF-8 files for spreadsheets.
BOM = "\ufeff"


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-.]", "_")


@F.pandas_udf(StringType())
def _indented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=2))


def write_each(records: DataFrame, folder: str) -> DataFrame:
    """One file ``<slug>.json`` per document in ``folder``, which driver and executors share, all of them or none; ``slug, records`` where several records
    share a slug, of which the one with the greatest ``path_asal`` or else the greatest JSON is in the file."""
    name = F.coalesce(F.nullif("nama_file_baru", F.lit("")), F.col("nama_file_asli"), F.lit(""))
    last = F.col("path_asal") if "path_asal" in records.columns else F.lit("")
    rows = records.select(slug(name).alias("slug"), F.to_json(F.struct(*records.columns)).alias("json"), last.alias("last"))
    rows = rows.groupBy("slug").agg(F.max_by("json", F.struct("last", "json")).alias("json"), F.count(F.lit(1)).alias("records"))

    tree.write_tree(rows.select(F.concat("slug", F.lit(".json")).alias("path"), _indented("json").alias("content")), folder)
    return rows.where("records > 1").select("slug", "records")


def write_csv(records: DataFrame, path: str) -> None:
    """The flat columns in their order, with the mark at the start of each part; missing ones are empty."""
    columns = [F.col(c) if c in records.columns else F.lit("").alias(c) for c in FLAT_COLUMNS]
    marked = records.select(*columns).withColumnRenamed(FLAT_COLUMNS[0], BOM + FLAT_COLUMNS[0])
    marked.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def export(records: DataFrame, root: str, kind: str = "json", stamp: str = "") -> None:
    """``json``, ``csv`` or ``both``; an empty table writes nothing."""
    if kind not in ("json", "csv", "both"):
        raise ValueError(f"unknown export: {kind}")
    if records.isEmpty():
        return
    end = f"_{stamp}" if stamp else ""
    if kind != "csv":
        write_json(records, f"{root}/summary{end}")
    if kind != "json":
        write_csv(records, f"{root}/hasil_ocr{end}")


def _write(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _table_text(columns: Iterable[str], rows: Iterable[dict]) -> str:
    columns, out = list(columns), io.StringIO()
    lines = csv.DictWriter(out, columns)
    lines.writeheader()
    lines.writerows({c: "" if r[c] is None else r[c] for c in columns} for r in rows)
    return BOM + out.getvalue()


def score_table(scores: DataFrame) -> DataFrame:
    """Rounded scores of the fields that occur, and a row of their means without counts."""
    rows = evaluate.rounded_scores(scores.where("tp + fp + fn > 0"))
    mean = evaluate.macro_scores(scores).drop("fields").withColumn("field", F.lit("MACRO AVERAGE"))
    return rows.unionByName(mean, allowMissingColumns=True)


def write_scores(scores: DataFrame, root: str, stamp: str) -> list[str]:
    """``f1_score_<stamp>.json`` and ``.csv`` in ``root/metadata``; there are at most as many rows as fields."""
    found = {r["field"]: r.asDict() for r in score_table(scores).collect()}
    mean = found.pop("MACRO AVERAGE")
    named = [{"field": label, "f1_score": found[f]["f1"], **{c: found[f][c] for c in ("precision", "recall", "tp", "fp", "fn")}} for f, label in FIELD_LABELS.items() if f in found]
    last = {"field": "MACRO AVERAGE", "f1_score": mean["f1"], "precision": mean["precision"], "recall": mean["recall"], "tp": None, "fp": None, "fn": None}
    whole = {"per_field": {r["field"]: {k: v for k, v in r.items() if k != "field"} for r in found.values()}, **{f"macro_{k}": mean[c] for k, c in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"))}}
    base = f"{root}/metadata/f1_score_{stamp}"
    columns = ("field", "precision", "recall", "f1_score", "tp", "fp", "fn")
    return [_write(base + ".json", json.dumps(whole, ensure_ascii=False, indent=2)), _write(base + ".csv", _table_text(columns, [*named, last]))]


def violations(records: DataFrame) -> DataFrame:
    """``file, issues`` of valid records whose names offend; the issues are joined."""
    issues = evaluate.naming_issues(F.col("nama_file_baru"), F.col("jenis_dokumen"))
    rows = records.where(evaluate.VALID).select(F.col("nama_file_baru").alias("file"), F.array_join(issues, "; ").alias("issues"))
    return rows.where("issues <> ''")


def write_naming(records: DataFrame, root: str, stamp: str) -> list[str]:
    """``naming_report_<stamp>.json`` with the figures, and a folder ``naming_violations_<stamp>`` of CSV parts if there are any."""
    figures = evaluate.naming_compliance(records).first().asDict()
    out = [_write(f"{root}/metadata/naming_report_{stamp}.json", json.dumps(figures, ensure_ascii=False, indent=2))]
    if figures["invalid"]:
        out.append(f"{root}/metadata/naming_violations_{stamp}")
        violations(records).withColumnRenamed("file", BOM + "file").write.mode("overwrite").csv(out[-1], header=True, encoding="UTF-8")
    return out


#: Figures of the whole batch by section of the report, under their names there.
_SECTIONS = {
    "batch": {c: c for c in ("total", "valid", "error", "success_rate_pct", "avg_completeness")},
    "naming": {"compliance_pct": "compliance_pct", "valid": "names_valid", "invalid": "names_invalid"},
    "time": {c: c for c in ("avg_ms", "min_ms", "max_ms", "total_s", "manual_s", "speedup")},
    "progress": {"valid": "done", "dry_run": "dry_run", "error": "failed"},
}
_ZERO = {"avg_ms": None, "min_ms": None, "max_ms": None, "total_s": None, "manual_s": None, "success_rate_pct": 0.0, "avg_completeness": 0.0, "compliance_pct": 0.0, "speedup": 0.0}


def metrics(records: DataFrame) -> dict:
    """All figures of a batch, from one pass over the records; an empty batch has zeros."""
    rows = [r.asDict() for r in evaluate.batch_figures(records).orderBy("whole", "jenis_dokumen").collect()]
    whole = next((r for r in rows if r["whole"]), {})
    out = {name: {k: whole.get(c, _ZERO.get(c, 0)) for k, c in own.items()} for name, own in _SECTIONS.items()}
    kinds = {r["jenis_dokumen"]: {"jenis_dokumen": r["jenis_dokumen"], "n": r["total"], "n_valid": r["valid"], "avg_completeness": r["avg_completeness"]} for r in rows if not r["whole"]}
    return {"batch": out["batch"], "kinds": kinds, **{k: out[k] for k in ("naming", "time", "progress")}}


def write_metrics(records: DataFrame, root: str, stamp: str) -> str:
    return _write(f"{root}/metadata/evaluasi_{stamp}.json", json.dumps(metrics(records), ensure_ascii=False, indent=2, default=str))


# -- HTML ----------------------------------------------------------------------


def shown_name() -> Column:
    kk, name = F.col("jenis_dokumen") == "kk", F.coalesce("nama", F.lit(""))
    return F.when(kk, first_of(F.col("nama_kepala"), name)).otherwise(name)


def shown_number() -> Column:
    nik = F.coalesce("nik", F.lit(""))
    return F.when(F.col("jenis_dokumen") == "kk", first_of(F.col("nomor_kk"), nik)).when(F.col("jenis_dokumen") == "sim", first_of(F.col("no_sim"), nik)).otherwise(nik)


def shown_details() -> Column:
    """Header fields of family cards and the number of licences, with their short labels."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    family = F.concat_ws(" | ", *[part(f"{k}: ", c) for k, c in (("Kel", "desa_kelurahan"), ("Kec", "kecamatan"), ("Kab", "kabupaten_kota"), ("Prov", "provinsi"), ("RT/RW", "rtrw"))])
    return F.when(F.col("jenis_dokumen") == "kk", family).when(F.col("jenis_dokumen") == "sim", F.coalesce(part("No. SIM: ", "no_sim"), F.lit(""))).otherwise("")


def badge(status: Column) -> Column:
    return F.when(status == "VALID", "VALID").when(F.contains(status, F.lit("DRY")), "PREVIEW").otherwise("ERROR")


def document_rows(records: DataFrame) -> DataFrame:
    """``file, kind, name, number, details, confidence, filled, badge`` of each record, as the report shows it; percentages are whole."""
    mean = F.col("mean_confidence") if "mean_confidence" in records.columns else F.lit(None).cast("double")
    return records.select(
        F.col("nama_file_asli").alias("file"), F.upper("jenis_dokumen").alias("kind"), shown_name().alias("name"), shown_number().alias("number"), shown_details().alias("details"),
        F.bround(mean, 0).cast("int").alias("confidence"), F.bround(F.coalesce("field_completeness", F.lit(0.0)) * 100, 0).cast("int").alias("filled"), badge(F.coalesce("status", F.lit("ERROR"))).alias("badge"),
    )


def _cells(rows: Iterable[dict]) -> str:
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    return "".join("<tr>" + "".join(map(cell, r.values())) + "</tr>" for r in rows)


def _table(title: str, rows: list[dict]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0]) if rows else ""
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{_cells(rows)}</table>"


def report_parts(records: DataFrame, scores: DataFrame | None = None) -> Iterable[str]:
    """Pieces of the HTML report: cards, distribution, documents, scores, time, naming.  Every value is escaped; the documents' rows come
    partition by partition, so the driver holds one at a time."""
    own = metrics(records)
    batch = own["batch"]
    cards = {"Dokumen": batch["total"], "Valid": batch["valid"], "Error": batch["error"], "Success rate": f"{batch['success_rate_pct']} %", "Completeness": f"{100 * batch['avg_completeness']:.1f} %"}
    yield "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body><h1>Report</h1>"
    yield "".join(f"<div class='kpi'><b>{html.escape(str(v))}</b> {html.escape(k)}</div>" for k, v in cards.items())
    yield "<h2>Distribution</h2>"
    for kind, r in own["kinds"].items():
        share = 100.0 * r["n"] / max(1, batch["total"])
        yield f"<div class='bar'><span style='width:{share:.1f}%'></span> {html.escape(str(kind))}: {r['n']}</div>"
    yield _table("Kinds", list(own["kinds"].values()))
    search = "for(const r of document.querySelectorAll('#documents tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())"
    yield f'<h2>Documents</h2><input placeholder="search" oninput="{search}"><table id="documents">'
    for row in document_rows(records).toLocalIterator():
        yield _cells([row.asDict()])
    yield "</table>"
    if scores is not None:
        yield _table("Scores", [r.asDict() for r in score_table(scores).orderBy("field").collect()])
        if "kk" not in own["kinds"]:
            yield "<p>No family cards in this batch.</p>"
    yield _table("Time", [own["time"]]) + _table("Naming", [own["naming"]]) + "</body></html>"


def report(records: DataFrame, scores: DataFrame | None = None) -> str:
    return "".join(report_parts(records, scores))


def write_report(records: DataFrame, root: str, stamp: str, scores: DataFrame | None = None) -> str:
    """``laporan_<stamp>.html`` in ``root/metadata``, piece by piece."""
    path = f"{root}/metadata/laporan_{stamp}.html"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(report_parts(records, scores))
    return path
