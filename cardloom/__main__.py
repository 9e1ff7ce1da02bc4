"""Command line: ``python -m cardloom run|explain|demo|template-help|settings``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.fields import classify
from cardloom.functions.text import clean_text, quality_score
from cardloom.operators import evaluate, listing, naming, records
from cardloom.plans import demo
from cardloom.sources import files, images, sinks

#: Fields that are shown of one document, by kind.
SHOWN = {"kk": ("nomor_kk", "nama_kepala", "desa_kelurahan", "kecamatan", "kabupaten_kota", "provinsi", "rtrw", "alamat"), "sim": ("no_sim", "nama", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "alamat")}
OTHERS = ("nama", "nik", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "alamat")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("cardloom", description="records from text variants of identity cards")
    parts = out.add_subparsers(dest="step", required=True)
    run = parts.add_parser("run", help="records, plan of moves, figures and reports of a batch")
    run.add_argument("texts", help="Parquet of doc_id, path, label, psm, text; with --ocr a folder of images, the batch's own")
    run.add_argument("--ocr", help="module:function that reads a grey image in a mode: (array, mode) -> text")
    run.add_argument("root", help="folder of the batch, which all executors see")
    run.add_argument("--config", help="settings as JSON or YAML")
    for name in ("export", "file-template", "folder-template", "separator", "ground-truth"):
        run.add_argument(f"--{name}")
    run.add_argument("--dry-run", action="store_true", default=None)
    run.add_argument("--stamp", default=time.strftime("%Y%m%d_%H%M%S"))
    explain = parts.add_parser("explain", help="how one document is read")
    explain.add_argument("texts")
    explain.add_argument("doc_id", type=int)
    parts.add_parser("demo", help="the made-up batch, explained").add_argument("--truth", help="folder for its true values")
    parts.add_parser("template-help", help="variables of templates")
    parts.add_parser("settings", help="write all settings with their defaults").add_argument("path", nargs="?", default="config.json")
    return out


def settings(args: argparse.Namespace) -> dict:
    """Settings of the file, over which those of the command line go; templates are checked."""
    own = files.load_settings(args.config) if args.config else dict(files.DEFAULTS)
    own |= {k: v for k, v in vars(args).items() if k in own and v is not None}
    for name in ("file_template", "folder_template"):
        unknown = naming.validate_template(own[name])
        if unknown:
            raise ValueError(f"unknown variables in {name}: {', '.join(unknown)}")
    if own["separator"] not in ("_", "-"):
        raise ValueError("the separator is _ or -")
    return own


def batch(texts: DataFrame, root: str, own: dict, stamp: str) -> DataFrame:
    """Records of a batch with their planned paths, written to ``root/metadata``; files are moved unless it is a dry run."""
    spark = texts.sparkSession
    began = time.time()
    paths = texts.groupBy("doc_id").agg(F.min("path").alias("path_asal"))
    out = records.build_with_confidence(texts.select("doc_id", "label", "psm", "text")).join(paths, "doc_id")
    name = F.substring_index("path_asal", "/", -1)
    folder = F.regexp_extract("path_asal", r"^(?:(.*)/)?[^/]*$", 1)
    out = out.withColumn("nama_file_asli", name).withColumn("subfolder", folder)
    if own["dry_run"]:
        out = out.withColumn("status", F.concat(F.lit("DRY-RUN-"), "status"))
    plan = naming.plan_paths(out, own["file_template"], own["folder_template"], own["separator"])
    plan = naming.suffix_duplicates(plan, "path_asal", existing=naming.existing_files(spark, root))
    target = f"{root}/metadata/records_{stamp}"
    plan.withColumn("nama_file_baru", F.substring_index("path", "/", -1)).drop("folder", "file", "action").write.mode("overwrite").parquet(target)
    done = spark.read.parquet(target)
    # one time for the batch, shared out evenly
    share = int(1000 * (time.time() - began) / max(1, done.count()))
    done = done.withColumn("waktu_proses", F.lit(f"{share} ms"))
    if not own["dry_run"]:
        moves = done.select(F.concat(F.lit(root + "/"), "path_asal").alias("path_asal"), "path")
        naming.apply_plan(moves, root, f"{root}/metadata/moves_{stamp}")
    return done


def report(done: DataFrame, root: str, own: dict, stamp: str) -> None:
    sinks.export(done, f"{root}/metadata", own["export"], stamp)
    scores = None
    if own["ground_truth"]:
        scores = evaluate.field_scores(evaluate.match_truth(files.read_truth(done.sparkSession, own["ground_truth"]), done))
        sinks.write_scores(scores, root, stamp)
    sinks.write_naming(done, root, stamp)
    sinks.write_metrics(done, root, stamp)
    sinks.write_report(done, root, stamp, scores)
    figures = sinks.metrics(done)
    kinds = [(k.upper(), r["n"]) for k, r in figures["kinds"].items()]
    rates = [("OCR Success Rate", f"{figures['batch']['success_rate_pct']:.1f}%"), ("Field completeness", f"{100 * figures['batch']['avg_completeness']:.1f}%")]
    print(listing.box("RESULT", [[("Documents", figures["batch"]["total"]), *kinds, ("Valid", figures["batch"]["valid"]), ("Error", figures["batch"]["error"])], rates]))


def explain(texts: DataFrame) -> None:
    """Readings of a few documents by score, and their records; a look at single documents, so the rows come to the driver."""
    text = F.coalesce("text", F.lit(""))
    rows = texts.select("doc_id", "label", "psm", quality_score(text).alias("score"), F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")).alias("letters"), classify(clean_text(text)).alias("kind"), listing.snippet(text).alias("snippet"))
    for r in rows.orderBy("doc_id", F.desc("score")).toLocalIterator():
        print(f"\n[{r.doc_id} | {r.label} | PSM {r.psm} | letters {r.letters} | score {r.score} | {r.kind}]\n{r.snippet}")
    for r in records.build_with_confidence(texts.select("doc_id", "label", "psm", "text")).orderBy("doc_id").toLocalIterator():
        shown = [(f, r[f] or "-") for f in SHOWN.get(r.jenis_dokumen, OTHERS)]
        print(listing.box(f"{r.doc_id} {r.jenis_dokumen.upper()} {r.status}", [[(f, v if len(v) <= 80 else v[:80] + "...") for f, v in shown], [("confidence", f"{r.mean_confidence}%")]], 80))


def hook(name: str):
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def template_help() -> str:
    return "variables: " + " ".join(f"{{{v}}}" for v in lx.TEMPLATE_VARIABLES) + '\nexample: --file-template "{nik}_{nama}" --folder-template "{JENIS}/{kabupaten}/{kecamatan}"'


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.step == "template-help":
        print(template_help())
        return 0
    if args.step == "settings":
        files.write_settings_template(args.path)
        return 0
    try:
        own = settings(args) if args.step == "run" else {}
    except (ValueError, FileNotFoundError, json.JSONDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("cardloom").getOrCreate()
    if args.step == "demo":
        if args.truth:
            print(demo.write_truth(args.truth))
        explain(demo.demo_texts(spark))
    elif args.step == "explain":
        explain(spark.read.parquet(args.texts).where(F.col("doc_id") == args.doc_id))
    else:
        log = listing.logger(args.root, args.stamp)
        texts = images.texts_of_folder(spark, args.texts, hook(args.ocr)) if args.ocr else spark.read.parquet(args.texts)
        done = batch(texts, args.root.rstrip("/"), own, args.stamp)
        report(done, args.root.rstrip("/"), own, args.stamp)
        log.info("records: %s/metadata/records_%s", args.root, args.stamp)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
