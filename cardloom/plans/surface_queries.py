"""More queries with their SQL: the SQL surface, large lexicons, medians, one-pass figures, decisions on angles, lines of logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import lexicon as lx
from cardloom.functions import text as tx
from cardloom.operators import evaluate, lexicon_join, listing, naming, orientation, records, selection
from cardloom.plans import cards as plan
from cardloom.plans import sql_surface
from cardloom.plans.queries import _HAND, _MS, _STEM, CARDS, CLASSIFY_SQL, FULL, GENDER_SQL, NIK_SQL, ORACLES, _NAME_SQL, clean_name_sql, query, strip_sql

# -- the library from SQL ------------------------------------------------------

VOTES = """
WITH readings AS (
  SELECT doc_id, variant, nik(text) AS nik, gender(text) AS jenis_kelamin, card_kind(text) AS jenis_dokumen, name_from_label(text) AS nama FROM {cards}
), counts AS (
  SELECT doc_id, field, value, count(*) AS n, min(variant) AS first FROM readings UNPIVOT (value FOR field IN (nik, jenis_kelamin, jenis_dokumen, nama)) GROUP BY ALL
)
SELECT v.doc_id, v.field, v.value, v.votes FROM (SELECT 1) AS one, LATERAL card_votes(TABLE(counts) PARTITION BY doc_id) AS v
"""


@query(f"""{CARDS}, r AS (SELECT doc_id, variant, unnest(['nik', 'jenis_kelamin', 'jenis_dokumen', 'nama']) AS field, unnest([{NIK_SQL}, {GENDER_SQL}, {CLASSIFY_SQL}, {_NAME_SQL}]) AS value FROM cards),
c AS (SELECT doc_id, field, value, count(*) AS votes, min(variant) AS first FROM r WHERE value <> '' GROUP BY ALL)
SELECT doc_id, field, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY votes DESC, first) AS k FROM c) WHERE k = 1""")
def sql_card_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the cards, in SQL alone."""
    sql_surface.register(spark)
    return spark.sql(VOTES, cards=plan.cards(spark, sf_dir))


@query(f"SELECT doc_id, translate(text, '{lx.WORD_DIGITS[0]}', '{lx.WORD_DIGITS[1]}') AS digits FROM documents")
def word_digits_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.table(spark, sf_dir, "documents").select("doc_id", tx.word_digits(F.col("text")).alias("digits"))


# -- lexicon, medians ----------------------------------------------------------


@query("""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part UNION SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM benchmark),
d AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_known, 0) AS n_known FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_words, count(*) FILTER (w IN (SELECT w FROM l)) AS n_known FROM d GROUP BY doc_id) USING (doc_id)""")
def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents against the words of parts' names and of the benchmark."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))).alias("w")
    # only ASCII letters have a lower case of their own here
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = plan.table(spark, sf_dir, "part").select(words("p_name")).union(plan.table(spark, sf_dir, "benchmark").select(words(plain)))
    return lexicon_join.lexicon_counts(plan.table(spark, sf_dir, "documents"), "doc_id", "text", known, "w")


@query("SELECT user_id, count(value) AS n, median(value) AS median FROM events GROUP BY user_id HAVING count(value) >= 3")
def event_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a user's events in place of angles."""
    return selection.exact_median(plan.table(spark, sf_dir, "events"), "user_id", "value", 3)


@query("SELECT event_type, count(value) AS n, median(value) AS median FROM events GROUP BY event_type HAVING count(value) >= 5")
def event_type_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys with very many values each."""
    return selection.exact_median(plan.table(spark, sf_dir, "events"), "event_type", "value", 5)


# -- figures -------------------------------------------------------------------


@query(rf"""{FULL}, r AS (SELECT *, contains(status, 'VALID') AS v, contains(status, 'ERROR') AS e, contains(status, 'DRY-RUN') AS d, {_MS} AS ms, {_HAND} AS hand,
  nama_file_baru = '' OR NOT regexp_matches(nama_file_baru, '{lx.FILE_NAME}') OR NOT starts_with(nama_file_baru, jenis_dokumen || '_') OR {_STEM} <> lower({_STEM}) OR contains(nama_file_baru, ' ') AS bad FROM full_records)
SELECT jenis_dokumen, grouping(jenis_dokumen) = 1 AS whole, count(*) AS total, count(*) FILTER (v) AS valid, count(*) FILTER (e) AS error, round_even(count(*) FILTER (v) * 100.0::DOUBLE / count(*), 1) AS success_rate_pct,
  round_even(coalesce(avg(field_completeness) FILTER (v), 0), 3) AS avg_completeness, count(*) FILTER (v AND NOT d) AS done, count(*) FILTER (d) AS dry_run, count(*) FILTER (e AND NOT d) AS failed,
  round_even(coalesce(count(*) FILTER (v AND NOT bad) * 100.0::DOUBLE / nullif(count(*) FILTER (v), 0), 0), 1) AS compliance_pct, count(*) FILTER (v AND NOT bad) AS names_valid, count(*) FILTER (v AND bad) AS names_invalid,
  round_even(avg(ms), 0) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, round_even(sum(ms) / 1000.0::DOUBLE, 1) AS total_s, sum(hand)::BIGINT AS manual_s, round_even(sum(hand) * 1000.0::DOUBLE / sum(ms), 1) AS speedup
FROM r GROUP BY GROUPING SETS ((jenis_dokumen), ())""")
def batch_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.batch_figures(evaluate.completeness(plan.records(spark, sf_dir)))


_SIX = ("nama", "nik", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "jenis_dokumen")


@query(f"""WITH l AS ({ORACLES['name_extract']}), b AS ({ORACLES['name_behind_number']}), p AS ({ORACLES['place_and_address']}), d AS ({ORACLES['date_and_gender']}), n AS ({ORACLES['nik_extract']}), k AS ({ORACLES['classify_cards']}),
e AS (SELECT doc_id, variant, replace(CASE WHEN l.nama <> '' THEN l.nama ELSE b.nama END, '_', ' ') AS raw, nik, tempat_lahir, tanggal_lahir, jenis_kelamin, jenis AS jenis_dokumen
  FROM l JOIN b USING (doc_id, variant) JOIN p USING (doc_id, variant) JOIN d USING (doc_id, variant) JOIN n USING (doc_id, variant) JOIN k USING (doc_id, variant)),
r AS (SELECT doc_id, unnest({list(_SIX)}) AS field, lower(trim(unnest([{clean_name_sql('raw')}, nik, tempat_lahir, tanggal_lahir, jenis_kelamin, jenis_dokumen]))) AS v FROM e),
t AS (SELECT doc_id, field, max(n) AS top FROM (SELECT doc_id, field, v, count(*) AS n FROM r WHERE v <> '' GROUP BY ALL) GROUP BY ALL),
s AS (SELECT doc_id, field, round_even(coalesce(top, 0) / 5.0::DOUBLE * 100, 1) AS c FROM (SELECT DISTINCT doc_id, field FROM r) LEFT JOIN t USING (doc_id, field))
SELECT doc_id, {', '.join(f"max(c) FILTER (field = '{f}') AS {f}" for f in _SIX)}, round_even(avg(c), 1) AS mean_confidence FROM s GROUP BY doc_id""")
def confidence_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of all six fields, and their mean."""
    scores = records.confidence_scores(plan.cards(spark, sf_dir).select("doc_id", "text"))
    return scores.select("doc_id", *[F.col("confidence_scores")[f].alias(f) for f in _SIX], "mean_confidence")


# -- angles --------------------------------------------------------------------

_ANGLES = "SELECT event_id, user_id, value * 7 % 180 - 90 AS angle, value * 3 % 24 - 12 AS blobs, value % 3 - 1.5 AS lines, value AS score, value * 13 % 101 AS turned FROM events"


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    rows = plan.table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", (value * 7 % 180 - 90).alias("angle"), (value * 3 % 24 - 12).alias("blobs"), (value % 3 - 1.5).alias("lines"), value.alias("score"), (value * 13 % 101).alias("turned"))


_FIRST = "CASE WHEN abs(angle) > 10 THEN angle WHEN abs(blobs) >= 0.5 THEN blobs ELSE 0 END + CASE WHEN abs(lines) >= 0.8 THEN lines ELSE 0 END"


@query(f"""WITH a AS ({_ANGLES}), s AS (SELECT *, {_FIRST} AS two FROM a), t AS (SELECT *, two + CASE WHEN abs(two) < 10 AND abs(turned) > 20 THEN turned ELSE 0 END AS three FROM s),
k AS (SELECT *, CASE WHEN abs(three) < 0.5 THEN 0 ELSE three END AS skew FROM t)
SELECT event_id, round(skew, 6) AS skew, abs(skew) < 0.5 OR NOT (score > 0 AND turned < score * 0.75::DOUBLE) AS kept, CASE WHEN turned > score * 1.2::DOUBLE THEN 'rotated_180' ELSE 'upright' END AS side FROM k""")
def angle_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up angles and scores over events: angle to correct, is the straightened image taken, is it upside down."""
    rows = _angles(spark, sf_dir)
    rows = rows.withColumn("skew", orientation.skew(F.col("angle"), F.col("blobs"), F.col("lines"), F.col("turned")))
    kept = orientation.keep_straightened(F.col("skew"), F.col("score"), F.col("turned"))
    return rows.select("event_id", F.round("skew", 6).alias("skew"), kept.alias("kept"), orientation.upside_down(F.col("score"), F.col("turned")).alias("side"))


@query(f"""WITH a AS ({_ANGLES}), c AS (SELECT user_id, least(floor((angle + 90) / 5.0::DOUBLE), 35)::INT AS bin, count(*) AS n FROM a WHERE angle BETWEEN -90 AND 90 GROUP BY ALL)
SELECT user_id, arg_max(bin, n * 100 - bin) * 5.0::DOUBLE + 2.5 - 90 AS angle FROM c GROUP BY user_id""")
def angle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orientation.dominant_angle(_angles(spark, sf_dir), "user_id", "angle")


@query("SELECT conv_id, role, max(coalesce(length(text), 0))::INT AS score FROM conversations GROUP BY ALL")
def quick_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a role's turns in place of scores over modes."""
    rows = plan.table(spark, sf_dir, "conversations").select("conv_id", "role", F.length("text").alias("score"))
    return orientation.quick_score(rows, ["conv_id", "role"])


@query("""WITH low AS (SELECT doc_id FROM documents WHERE length(text) < 200)
SELECT doc_id, 'sh_' || c || k AS label, psm FROM low, (SELECT unnest(['fb15', 'fb20', 'fb10']) AS c), (SELECT unnest(['', '_hi', '_otsu', '_eq']) AS k), (SELECT unnest([6, 11, 3]) AS psm)""")
def second_pass_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents in place of those with a low score: all readings of their second pass."""
    return orientation.second_pass(plan.table(spark, sf_dir, "documents").where(F.length("text") < 200).select("doc_id"))


ORACLES["fallback_union"] = f"""WITH s AS ({ORACLES['quality_score_cards']}), c AS ({plan.DUCKDB_CARDS}), low AS (SELECT doc_id FROM s WHERE variant < 3 GROUP BY doc_id HAVING max(score) < 50)
SELECT doc_id, 'v' AS label, variant AS psm, text FROM c WHERE variant < 3 OR doc_id IN (SELECT doc_id FROM low)"""

# -- lines ---------------------------------------------------------------------


def _tags_sql(tags: dict[str, tuple[str, ...]]) -> str:
    return " ".join(f"WHEN {' OR '.join(f'''contains(line, '{t}')''' for t in texts)} THEN '{tag}'" for tag, texts in tags.items())


_LOG_LINES = "SELECT event_id, CASE event_type WHEN 'click' THEN '[OK] ' WHEN 'view' THEN '[DEBUG] ' WHEN 'error' THEN '[ERROR] ' WHEN 'purchase' THEN 'Nama: ' ELSE 'PSM ' END || props || CASE WHEN event_id % 7 = 0 THEN ' [WARN]' WHEN event_id % 5 = 0 THEN ' kosong' ELSE '' END AS line FROM events"


@query(f"""WITH l AS ({_LOG_LINES}) SELECT event_id, CASE {_tags_sql(listing.LOG_TAGS)} ELSE 'INFO' END AS log_tag,
  CASE {_tags_sql(listing.EXPLAIN_TAGS)} WHEN contains(upper(line), 'ERROR') OR contains(lower(line), 'kosong') THEN 'WARN' ELSE 'PLAIN' END AS explain_tag FROM l""")
def line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of made-up log lines over events."""
    lines = spark.sql(_LOG_LINES.replace("FROM events", "FROM {events}"), events=plan.table(spark, sf_dir, "events"))
    return lines.select("event_id", listing.log_tag(F.col("line")).alias("log_tag"), listing.explain_tag(F.col("line")).alias("explain_tag"))


@query(f"""SELECT doc_id, CASE WHEN {strip_sql('text')} = '' THEN '(kosong)' ELSE left({strip_sql('text')}, 400) END AS snippet,
  CASE WHEN text = '' THEN '-' WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS shortened FROM documents""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return plan.table(spark, sf_dir, "documents").select("doc_id", listing.snippet(text).alias("snippet"), listing.shortened(text).alias("shortened"))


@query("SELECT user_id, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::VARCHAR || ' ms' AS elapsed FROM events GROUP BY user_id")
def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between the first and the last event of a user."""
    rows = plan.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return rows.select("user_id", listing.elapsed(F.col("a"), F.col("b")).alias("elapsed"))


def _unicode_words(sql: str) -> str:
    """Numbers between word boundaries, counted as words of digits only: the boundaries of the other engine know ASCII alone."""
    for low, high in ((14, 16), (10, 13)):
        words = f"list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+'), lambda w: regexp_full_match(w, '\\p{{Nd}}{{{low},{high}}}'))"
        sql = sql.replace(f"len(regexp_extract_all(text, '\\b\\d{{{low},{high}}}\\b'))", f"len({words})")
    return sql


# the score's SQL over documents in place of cards
ORACLES["quality_score_docs"] = _unicode_words(ORACLES["quality_score_cards"][len(CARDS) :].replace("FROM cards)", "FROM documents)").replace("doc_id, variant,", "doc_id,")).replace(", p AS (", "WITH p AS (", 1)

# -- templates -----------------------------------------------------------------

_STAMP, _SEP = "20240131_120000", "_"
_TEMPLATE = "{JENIS}/{jenis}_{NAMA}--{nik}/{nik6}{tgl}_{tgl_compact}/ {tempat}!{jk}_{tanggal}_{timestamp}/{nokk}{nokk6}/{kepala}-{KEPALA}/../{desa}/{kecamatan}_{kabupaten}_{provinsi}/{rtrw}{nama}"


def _slug_of(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({strip_sql(x)}), '[^a-z0-9]+', '_', 'g'), '^[_\\-]+|[_\\-]+$', '', 'g')"


def _variables_sql() -> dict[str, str]:
    """Each variable of a template over the columns of a record, with ``number`` and ``own_nik`` beside them."""
    kk = lambda x: f"CASE WHEN jenis_dokumen = 'kk' THEN {x} ELSE '' END"
    or_else = lambda x, y: f"coalesce(nullif({x}, ''), '{y}')"
    six = lambda x: f"rpad(left({x}, 6), 6, '0')"
    name, head = or_else(_slug_of("nama"), "unknown"), kk(_slug_of("nama_kepala"))
    return {
        "jenis": "lower(jenis_dokumen)", "JENIS": "upper(jenis_dokumen)", "nama": name, "NAMA": f"upper({name})", "nik": or_else("own_nik", "nonik"), "nik6": six("own_nik"),
        "tgl": or_else("replace(tanggal_lahir, '/', '-')", "notgl"), "tgl_compact": or_else("regexp_replace(tanggal_lahir, '[^0-9]', '', 'g')", "notgl"), "tempat": or_else(_slug_of("tempat_lahir"), "notempat"),
        "jk": "CASE upper(jenis_kelamin) WHEN 'LAKI-LAKI' THEN 'L' WHEN 'PEREMPUAN' THEN 'P' ELSE 'X' END", "tanggal": f"'{_STAMP[:8]}'", "timestamp": f"'{_STAMP}'",
        "nokk": "number", "nokk6": f"CASE WHEN number = '' THEN '' ELSE {six('number')} END", "kepala": head, "KEPALA": f"upper({head})", "desa": kk(_slug_of("desa_kelurahan")),
        "kecamatan": kk(_slug_of("kecamatan")), "kabupaten": kk(_slug_of("kabupaten_kota")), "provinsi": kk(_slug_of("provinsi")), "rtrw": kk("replace(rtrw, '/', '_')"),
    }


def _column_of(variable: str) -> str:
    """Upper-case variables have columns of their own: names of columns don't tell case apart."""
    return "v_" + (variable.lower() + "_upper" if variable.isupper() else variable)


def _template_sql() -> str:
    pieces = re.split(r"\{(\w+)\}", _TEMPLATE)
    whole = " || ".join(_column_of(x) if i % 2 else f"'{x}'" for i, x in enumerate(pieces))
    safe = r"regexp_replace(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9_\-\.]', '', 'g'), '[_\-]{2,}', '_', 'g'), '^[_\-]+|[_\-]+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({whole}, '/'), lambda s: {safe}), lambda s: s <> ''), '/')"


@query(f"""WITH records AS ({plan.RECORDS}), n AS (SELECT *, CASE WHEN jenis_dokumen = 'kk' THEN regexp_replace(nomor_kk, '[^0-9]', '', 'g') ELSE '' END AS number FROM records),
k AS (SELECT *, coalesce(nullif(number, ''), regexp_replace(nik, '[^0-9]', '', 'g')) AS own_nik FROM n), v AS (SELECT doc_id, {', '.join(f'{sql} AS {_column_of(name)}' for name, sql in _variables_sql().items())} FROM k)
SELECT *, {_template_sql()} AS path FROM v""")
def template_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variables of a template, and a path that uses them all."""
    context = naming.template_context(_SEP, _STAMP)
    path = naming.apply_template(_TEMPLATE, context, _SEP)
    return plan.records(spark, sf_dir).select("doc_id", *[context[v].alias(_column_of(v)) for v in lx.TEMPLATE_VARIABLES], path.alias("path"))


_WANTED = "SELECT c_custkey AS doc_id, 'd' || CAST(c_nationkey % 3 AS STRING) AS folder, 'f' || CAST(c_custkey % 40 AS STRING) || '.jpg' AS file FROM customer"
_THERE = "SELECT 'd' || CAST(c_nationkey % 3 AS STRING) AS folder, 'f' || CAST(c_custkey % 40 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '_' || CAST(c_custkey % 17 AS STRING) END || '.jpg' AS file FROM customer WHERE c_custkey % 7 = 0"


@query(rf"""WITH w AS ({_WANTED}), t AS ({_THERE}),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY doc_id) - CASE WHEN (folder, file) IN (SELECT (folder, file) FROM t) THEN 0 ELSE 1 END AS late FROM w),
free AS (SELECT folder, file, n, row_number() OVER (PARTITION BY folder, file ORDER BY n) AS k FROM (SELECT DISTINCT folder, file FROM w), (SELECT unnest(range(1, (SELECT max(late) FROM r) + 20)) AS n)
  WHERE (folder, replace(file, '.jpg', '_' || n || '.jpg')) NOT IN (SELECT (folder, file) FROM t))
SELECT doc_id, r.folder || '/' || CASE WHEN late = 0 THEN r.file ELSE replace(r.file, '.jpg', '_' || n || '.jpg') END AS path FROM r LEFT JOIN free ON r.folder = free.folder AND r.file = free.file AND late = k""")
def suffixes_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that rows share, and that files have already, with and without numbers."""
    wanted, existing = (plan.run_sql(spark, sf_dir, sql) for sql in (_WANTED, _THERE))
    return naming.suffix_duplicates(wanted, "doc_id", existing=existing).select("doc_id", "path")
