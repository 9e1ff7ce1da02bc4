"""Figures on records: completeness, batch figures, precision and recall against true values, time, naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions.text import normalize_for_compare

#: Dry runs that would succeed count as valid as well.
VALID = "contains(status, 'VALID')"


def completeness(records: DataFrame) -> DataFrame:
    """``records`` with ``fields_filled, fields_total, field_completeness`` (two digits, half to even)."""

    def counted(fields):
        return reduce(lambda a, b: a + b, [(F.coalesce(F.col(f), F.lit("")) != "").cast("int") for f in fields])

    filled, total = counted(["nama"]), F.lit(1)
    for kind, fields in lx.RELEVANT_FIELDS.items():
        filled = F.when(F.col("jenis_dokumen") == kind, counted(fields)).otherwise(filled)
        total = F.when(F.col("jenis_dokumen") == kind, len(fields)).otherwise(total)
    out = records.withColumn("fields_filled", filled).withColumn("fields_total", total)
    return out.withColumn("field_completeness", F.bround(F.col("fields_filled") / F.col("fields_total"), 2))


def batch_stats(records: DataFrame) -> DataFrame:
    """One row: totals, success rate and mean completeness of valid records."""
    valid = F.expr(VALID)
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("valid"),
        F.count_if(F.expr("contains(status, 'ERROR')")).alias("error"),
        F.bround(F.coalesce(F.try_divide(F.count_if(valid) * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)), 1).alias("success_rate_pct"),
        F.bround(F.coalesce(F.avg(F.when(valid, F.col("field_completeness"))), F.lit(0.0)), 3).alias("avg_completeness"),
    )


def progress(records: DataFrame) -> DataFrame:
    """One row: done, previewed and failed records of a batch; a dry run's record is previewed only."""
    dry = F.contains("status", F.lit("DRY-RUN"))
    return records.agg(F.count_if(~dry & F.expr(VALID)).alias("valid"), F.count_if(dry).alias("dry_run"), F.count_if(~dry & F.expr("contains(status, 'ERROR')")).alias("error"))


def by_type(records: DataFrame) -> DataFrame:
    """``jenis_dokumen, n, n_valid, avg_completeness`` (of valid records)."""
    valid = F.expr(VALID)
    return records.groupBy("jenis_dokumen").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.bround(F.coalesce(F.avg(F.when(valid, F.col("field_completeness"))), F.lit(0.0)), 3).alias("avg_completeness"),
    )


def batch_figures(records: DataFrame) -> DataFrame:
    """All figures of a batch in one pass: a row for each kind, and one for the whole batch, whose ``jenis_dokumen`` is null and ``whole`` true.

    Totals, rates and completeness are those of :func:`batch_stats` and :func:`by_type`, the rest those of :func:`progress`, :func:`naming_compliance`,
    :func:`time_figures` and :func:`time_by_type`.  A batch without records has no row.
    """
    valid, dry = F.expr(VALID), F.contains("status", F.lit("DRY-RUN"))
    failed = F.expr("contains(status, 'ERROR')")
    by_hand = F.create_map(*[F.lit(x) for kv in lx.MANUAL_SECONDS.items() for x in kv])
    ms = F.try_to_number(F.regexp_extract("waktu_proses", r"(\d+)", 1), F.lit("999999999999")).cast("long")
    issues = F.size(naming_issues(F.col("nama_file_baru"), F.col("jenis_dokumen")))
    rows = records.select(
        F.coalesce("jenis_dokumen", F.lit("")).alias("jenis_dokumen"), ms.alias("ms"),
        F.when(ms.isNotNull(), F.coalesce(by_hand[F.col("jenis_dokumen")], F.lit(lx.MANUAL_SECONDS_DEFAULT))).alias("hand"), valid.alias("is_valid"), failed.alias("is_error"), dry.alias("is_dry"),
        F.when(valid, F.col("field_completeness")).alias("completeness"), F.when(valid, issues).alias("issues"),
    )
    share = lambda part, all_: F.bround(F.coalesce(F.try_divide(part * F.lit(100.0), all_), F.lit(0.0)), 1)
    good, named, total = F.count_if(F.col("issues") == 0), F.count("issues"), F.count(F.lit(1))
    own = rows.groupingSets([["jenis_dokumen"], []], "jenis_dokumen").agg(
        (F.grouping("jenis_dokumen") == 1).alias("whole"),
        total.alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if("is_error").alias("error"),
        share(F.count_if("is_valid"), total).alias("success_rate_pct"),
        F.bround(F.coalesce(F.avg("completeness"), F.lit(0.0)), 3).alias("avg_completeness"),
        F.count_if(F.col("is_valid") & ~F.col("is_dry")).alias("done"),
        F.count_if("is_dry").alias("dry_run"),
        F.count_if(F.col("is_error") & ~F.col("is_dry")).alias("failed"),
        share(good, named).alias("compliance_pct"),
        good.alias("names_valid"),
        F.count_if(F.col("issues") > 0).alias("names_invalid"),
        F.bround(F.avg("ms"), 0).alias("avg_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.bround(F.sum("ms") / F.lit(1000.0), 1).alias("total_s"),
        F.sum("hand").alias("manual_s"),
        F.bround(F.coalesce(F.try_divide(F.sum("hand") * F.lit(1000.0), F.sum("ms")), F.lit(0.0)), 1).alias("speedup"),
    )
    return own.where("total > 0")


def match_truth(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of ``truth`` (key ``nama_file``) with the record of that original name, else of that new name; unmatched rows stay.

    Of records with one name the greatest ``path_asal`` counts.
    """
    fields = F.struct(*lx.EVALUATED_FIELDS)

    def index(name, key):
        return records.groupBy(F.col(name).alias(key)).agg(F.max_by(fields, "path_asal").alias("by_" + key))

    joined = truth.join(index("nama_file_asli", "asli"), truth["nama_file"] == F.col("asli"), "left")
    joined = joined.join(index("nama_file_baru", "baru"), truth["nama_file"] == F.col("baru"), "left")
    return joined.select(*truth.columns, F.coalesce("by_asli", "by_baru").alias("record"))


def field_scores(matched: DataFrame) -> DataFrame:
    """``field, tp, fp, fn, precision, recall, f1``: a wrong value is a false positive only; fields that the true values lack are empty."""
    true = lambda f: F.coalesce(F.col(f), F.lit("")) if f in matched.columns else F.lit("")
    pairs = [F.struct(F.lit(f).alias("field"), true(f).alias("t"), F.coalesce(F.col("record")[f], F.lit("")).alias("p")) for f in lx.EVALUATED_FIELDS]
    long = matched.select(F.explode(F.array(*pairs)).alias("e")).select("e.field", "e.t", "e.p")
    same = normalize_for_compare(F.col("t")) == normalize_for_compare(F.col("p"))
    has_t, has_p = F.col("t") != "", F.col("p") != ""
    counts = long.groupBy("field").agg(
        F.count_if(has_t & has_p & same).alias("tp"), F.count_if(has_p & ~(has_t & same)).alias("fp"), F.count_if(has_t & ~has_p).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.select("field", "tp", "fp", "fn", *[F.bround(c, 3).alias(c) for c in ("precision", "recall", "f1")])


def macro_scores(scores: DataFrame) -> DataFrame:
    """One row: means of the unrounded scores of fields that occur."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(c)
    return scores.where("tp + fp + fn > 0").agg(mean("precision"), mean("recall"), mean("f1"), F.count(F.lit(1)).alias("fields"))


def time_figures(records: DataFrame) -> DataFrame:
    """One row from ``waktu_proses`` (text with milliseconds) and the time that work by hand would take."""
    by_hand = F.create_map(*[F.lit(x) for kv in lx.MANUAL_SECONDS.items() for x in kv])
    timed = records.select("jenis_dokumen", F.try_to_number(F.regexp_extract("waktu_proses", r"(\d+)", 1), F.lit("999999999999")).cast("long").alias("ms")).where("ms IS NOT NULL")
    manual = F.sum(F.coalesce(by_hand[F.col("jenis_dokumen")], F.lit(lx.MANUAL_SECONDS_DEFAULT)))
    return timed.agg(
        F.bround(F.avg("ms"), 0).alias("avg_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.bround(F.sum("ms") / F.lit(1000.0), 1).alias("total_s"),
        manual.alias("manual_s"),
        F.bround(F.coalesce(F.try_divide(manual * F.lit(1000.0), F.sum("ms")), F.lit(0.0)), 1).alias("speedup"),
    )


def time_by_type(records: DataFrame) -> DataFrame:
    ms = F.try_to_number(F.regexp_extract("waktu_proses", r"(\d+)", 1), F.lit("999999999999")).cast("long")
    return records.select("jenis_dokumen", ms.alias("ms")).where("ms IS NOT NULL").groupBy("jenis_dokumen").agg(F.bround(F.avg("ms"), 0).alias("avg_ms"))


def naming_issues(name: Column, kind: Column) -> Column:
    """What a file name offends against, as an array."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    checks = [
        F.when(~name.rlike(lx.FILE_NAME), F.lit("pattern")),
        F.when((kind != "") & ~F.startswith(name, F.concat(kind, F.lit("_"))), F.lit("prefix")),
        F.when(stem != F.lower(stem), F.lit("upper case")),
        F.when(F.contains(name, F.lit(" ")), F.lit("blank")),
    ]
    return F.when(name == "", F.array(F.lit("empty"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def naming_compliance(records: DataFrame) -> DataFrame:
    """One row over valid records: share of compliant names in percent, and their numbers."""
    valid = records.where(VALID).select(F.size(naming_issues(F.col("nama_file_baru"), F.col("jenis_dokumen"))).alias("issues"))
    good = F.count_if(F.col("issues") == 0)
    return valid.agg(
        F.bround(F.coalesce(F.try_divide(good * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)), 1).alias("compliance_pct"),
        good.alias("valid"),
        F.count_if(F.col("issues") > 0).alias("invalid"),
    )
