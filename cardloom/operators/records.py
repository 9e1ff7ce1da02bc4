"""One record per document from the text variants that OCR gives.

The stages are those of a batch: score each variant, take the best, clean, tell the kind, read fields in every variant, settle
them by votes in which the best text counts twice, and judge the result.  The texts are shuffled once, by document; windows,
votes and the record all keep that partitioning, and no list of variants is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import addresses as ax
from cardloom.functions import family
from cardloom.functions import fields as fx
from cardloom.functions import lexicon as lx
from cardloom.functions import names as nx
from cardloom.functions.text import clean_name, clean_text, first_of, let, quality_score, strip
from cardloom.operators import evaluate, vote

#: Fields that are settled by a plain vote, and how each is read: on family cards, and on others.
FAMILY = {
    "nomor_kk": family.family_number,
    "nama_kepala": family.family_head,
    "rtrw": fx.rt_rw,
    "alamat_kk": ax.family_address,
    **{f: (lambda text, f=f: fx.header_field(text, f)) for f in lx.HEADER_PATTERNS},
}
OTHERS = {"nik": fx.nik, "tempat_lahir": fx.birth_place, "tanggal_lahir": fx.birth_date}
FAMILY_ONLY = ("nomor_kk", "nama_kepala", "desa_kelurahan", "kecamatan", "kabupaten_kota", "provinsi", "rtrw")


def score_variants(texts: DataFrame) -> DataFrame:
    """``texts`` (``doc_id, label, psm, text``) with ``score``; a null text is empty."""
    return texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("score", quality_score(F.col("text")))


def best_and_kind(scored: DataFrame) -> DataFrame:
    """``doc_id, ord, text, kind``: cleaned variants from ``ord`` 1, the best, on, with the kind that the best one tells."""
    ranked = vote.rank_variants(scored, "doc_id", ["score", "label", "psm", "text"])
    cleaned = ranked.select("doc_id", F.col("rank").cast("long").alias("ord"), clean_text(F.col("text")).alias("text"))
    told = F.when(strip(F.col("text")) == "", "unknown").otherwise(fx.classify(F.col("text")))
    return cleaned.withColumn("kind", F.max(F.when(F.col("ord") == 1, told)).over(Window.partitionBy("doc_id")))


def candidates(rows: DataFrame) -> DataFrame:
    """``doc_id, field, value, ord, weight`` of what each variant gives for each field of its kind; the best text weighs two."""
    text, kind, order = F.col("text"), F.col("kind"), F.col("ord")
    kk, sim, best = kind == "kk", kind == "sim", F.col("ord") == 1
    below = F.when(sim, ax.licence_address_below_gender(text)).otherwise("")
    rows = rows.withColumn("below", below).withColumn("beside", F.when(sim & (F.col("below") == ""), ax.licence_address_elsewhere(text)).otherwise(""))
    # an address from elsewhere counts once, and only if no better text has any
    any_ = first_of(F.col("below"), F.col("beside"))
    rows = rows.withColumn("since", F.min(F.when(any_ != "", order)).over(Window.partitionBy("doc_id")))
    elsewhere = F.col("below") == ""
    weight = F.when(best, 2).otherwise(1)

    def one(field: str, value: Column, at: Column = order * 2, n: Column = weight) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"), at.cast("long").alias("ord"), n.cast("long").alias("weight"))

    found = [one(f, F.when(kk, read(text))) for f, read in FAMILY.items()]
    found += [one(f, F.when(~kk, read(text))) for f, read in OTHERS.items() if f != "tempat_lahir"]
    place = F.when(~kk, let(fx.birth_place(text), lambda p: F.when(F.length(p) > 2, p)))
    found += [
        one("tempat_lahir", place),
        one("no_sim", F.when(sim, fx.licence_number(text))),
        one("nama", F.when(~kk, nx.plausible(fx.name_from_label(text)))),
        one("nama", nx.unlabelled_name(text, kind), order * 2 + 1),
        one("alamat_sim", F.when(elsewhere & (order > F.col("since")), "").otherwise(any_), n=F.when(elsewhere, 1).otherwise(weight)),
        one("alamat", F.when(best & ~kk, fx.address(text))),
        one("jenis_dokumen", F.when(best, kind)),
        one("jenis_kelamin", F.when(best & ~kk, fx.gender(text))),
    ]
    return rows.select("doc_id", F.inline(F.array(*found))).where("value <> ''")


def settle(found: DataFrame) -> DataFrame:
    """One row per document: of each field the value of the greatest weight.  Ties go to the name of most words, then the longest;
    to the shortest licence address, of those with an address word where there are any; else to the one seen first."""
    counts = found.groupBy("doc_id", "field", "value").agg(F.sum("weight").alias("n"), F.min("ord").alias("first"))
    name, licence = F.col("field") == "nama", F.col("field") == "alamat_sim"
    length = F.length("value")
    rank = F.struct(
        (licence & F.col("value").rlike(ax.LICENCE_WORD)).alias("word"),
        "n",
        F.when(name, F.size(F.split("value", "_", -1))).when(licence, -length).otherwise(0).alias("t0"),
        F.when(name, length).otherwise(0).alias("t1"),
        (-F.col("first")).alias("first"),
    )
    names = [*FAMILY, *OTHERS, "no_sim", "nama", "alamat_sim", "alamat", "jenis_dokumen", "jenis_kelamin"]
    return counts.groupBy("doc_id").pivot("field", names).agg(F.max_by("value", rank)).na.fill("", names)


def judged(settled: DataFrame) -> DataFrame:
    """Records from the values that votes have settled: what a kind takes from which field, status and completeness; other columns are carried."""
    kk = F.col("jenis_dokumen") == "kk"
    used = {"alamat_kk", "alamat_sim", "alamat", "nik", "nama", "jenis_dokumen", "jenis_kelamin", "tempat_lahir", "tanggal_lahir", "no_sim", *FAMILY_ONLY}
    out = settled.select(
        *[c for c in settled.columns if c not in used],
        "jenis_dokumen",
        "jenis_kelamin",
        F.when(kk, F.col("alamat_kk")).otherwise(first_of(F.col("alamat"), F.left("alamat_sim", F.lit(200)))).alias("alamat"),
        F.when(kk, F.col("nomor_kk")).otherwise(F.col("nik")).alias("nik"),
        *["tempat_lahir", "tanggal_lahir", "no_sim", *FAMILY_ONLY],
        F.when(kk, F.col("nama_kepala")).otherwise(F.col("nama")).alias("nama"),
    )
    ok = (F.col("jenis_dokumen") != "unknown") & (F.col("nama") != "")
    return evaluate.completeness(out.withColumn("status", F.when(ok, "VALID").otherwise("ERROR")))


def build_records(texts: DataFrame) -> DataFrame:
    """Records of the documents in ``texts`` (``doc_id, label, psm, text``); a document without any text is an ``ERROR`` of kind ``unknown``."""
    # by number, so that AQE doesn't merge partitions that are small in bytes but long to read
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return judged(settle(candidates(best_and_kind(score_variants(texts.repartition(parts, "doc_id"))))))


def confidence_scores(texts: DataFrame) -> DataFrame:
    """``doc_id, confidence_scores, mean_confidence`` from cleaned variants (``doc_id, text``): for each of six fields the share in percent of
    a document's variants that agree on its most frequent value, and their mean."""
    text = F.col("text")
    name = clean_name(F.translate(first_of(fx.name_from_label(text), nx.name_after_number(text)), "_", " "))
    kind = F.when(strip(text) == "", "unknown").otherwise(fx.classify(text))
    read = {"nama": name, "nik": fx.nik(text), "tempat_lahir": fx.birth_place(text), "tanggal_lahir": fx.birth_date(text), "jenis_kelamin": fx.gender(text), "jenis_dokumen": kind}
    shares = vote.confidence(texts.select("doc_id", *[c.alias(f) for f, c in read.items()]), "doc_id", list(read))
    pairs = F.sort_array(F.collect_list(F.struct("field", "confidence")))  # six for each document
    return shares.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("confidence_scores"), F.bround(F.avg("confidence"), 1).alias("mean_confidence"))


def build_with_confidence(texts: DataFrame) -> DataFrame:
    """:func:`build_records` with the confidence of the fields."""
    cleaned = texts.select("doc_id", clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    return build_records(texts).join(confidence_scores(cleaned), "doc_id", "left")


def fallback_texts(texts: DataFrame, more: DataFrame, least: int = 50) -> DataFrame:
    """``texts`` and, for documents whose best score is below ``least``, the rows of ``more`` as well; duplicates stay."""
    low = score_variants(texts).groupBy("doc_id").agg(F.max("score").alias("best")).where(F.col("best") < least)
    return texts.unionAll(more.join(low, "doc_id", "left_semi").select(*texts.columns))


def every_mode(variants: DataFrame, modes: tuple[int, ...] = (6, 11, 3)) -> DataFrame:
    """Each variant once for each page segmentation mode."""
    return variants.withColumn("psm", F.explode(F.array(*map(F.lit, modes))))
