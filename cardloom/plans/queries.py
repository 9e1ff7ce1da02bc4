"""Queries over the driver's tables for each operator on cards, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import addresses as ax
from cardloom.functions import family
from cardloom.functions import fields as fx
from cardloom.functions import lexicon as lx
from cardloom.functions import names as nx
from cardloom.functions import text as tx
from cardloom.operators import evaluate, naming, records, vote
from cardloom.plans import cards as plan
from cardloom.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- SQL pieces ----------------------------------------------------------------

CARDS = f"WITH cards AS ({plan.DUCKDB_CARDS})"
RECORDS = f"WITH records AS ({plan.RECORDS})"
TEXT = "text"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def digits_sql(x: str, table: tuple[str, str] | None = None) -> str:
    x = f"translate({x}, '{table[0]}', '{table[1]}')" if table else x
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def lines_sql(x: str = TEXT) -> str:
    return f"string_split({x}, chr(10))"


def words_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def hits_sql(patterns) -> str:
    return "(" + " + ".join(f"regexp_matches(upper(text), '{p}')::INT" for p in patterns) + ")"


CLASSIFY_SQL = (
    f"CASE WHEN {hits_sql(lx.KK_PATTERNS)} > 0 THEN 'kk' WHEN {hits_sql(lx.SIM_PATTERNS)} >= 2 THEN 'sim' WHEN {hits_sql(lx.KTP_PATTERNS)} >= 2 THEN 'ktp' "
    f"WHEN {hits_sql(lx.SIM_PATTERNS)} >= 1 THEN 'sim' WHEN {hits_sql(lx.KTP_PATTERNS)} >= 1 THEN 'ktp' ELSE 'unknown' END"
)
NIK_LABEL = digits_sql(rf"regexp_replace(regexp_extract(text, '(?i)\bN\s*[I1]\s*K\s*[:\-]?\s*([\dOolLIisSbBzZGgAaDd\s]{{14,22}})', 1), '\s', '', 'g')", lx.NIK_DIGITS)
NIK_FUSED = f"list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\\s', '', 'g'), '[0-9A-Za-z]{{14,18}}'), lambda c: {digits_sql('c', lx.NIK_DIGITS)}), lambda d: length(d) >= 15 AND regexp_matches(d, '^[1-9][0-9]'))[1]"
NIK_GAPS = digits_sql(r"regexp_extract(text, '(\d[\d\-\s]{13,19}\d)', 1)")
NIK_SQL = f"CASE WHEN length({NIK_LABEL}) >= 15 THEN left({NIK_LABEL}, 16) WHEN {NIK_FUSED} IS NOT NULL THEN left({NIK_FUSED}, 16) WHEN length({NIK_GAPS}) >= 15 AND regexp_matches({NIK_GAPS}, '^[1-9][0-9]') THEN left({NIK_GAPS}, 16) ELSE '' END"
LABEL_LINES = f"list_filter({lines_sql()}, lambda x: regexp_matches(upper(x), '{fx.BIRTH_LABEL}'))"
DATE_SQL = rf"coalesce(nullif(list_filter(list_transform({LABEL_LINES}, lambda x: regexp_extract(x, '(\d{{1,2}}[-/\s]\d{{1,2}}[-/\s]\d{{4}})', 1)), lambda d: d <> '')[1], ''), nullif(regexp_extract(text, '\b(\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}})\b', 1), ''), '')"
_FILLED = f"list_filter({lines_sql()}, lambda x: {strip_sql('x')} <> '')"
_DAY = r"[,\.\-:]\s*(\d{1,2})[-/\.](\d{2})\s*$"
GENDER_SQL = r"CASE WHEN regexp_matches(upper(text), 'LAKI\s*[-]\s*LAKI|LAKI\s+LAKI|\bLELAKI\b|\bPRIA\b') THEN 'LAKI-LAKI' WHEN regexp_matches(upper(text), 'PEREMPUAN|\bWANITA\b') THEN 'PEREMPUAN' ELSE '' END"


def clean_name_sql(x: str) -> str:
    text = strip_sql(rf"regexp_replace(regexp_replace({x}, '[^A-Za-z\s]', ' ', 'g'), '\s+', ' ', 'g')")
    kept = f"list_filter(string_split(lower({text}), ' '), lambda w: length(w) >= 2 AND NOT list_contains({words_list(lx.NAME_STOPWORDS)}, w))"
    return f"CASE WHEN length({text}) < 3 THEN '' ELSE array_to_string({kept}[1:5], '_') END"


def plausible_sql(x: str) -> str:
    parts, stop = f"string_split({x}, '_')", words_list(lx.NAME_STOPWORDS)
    own = f"len(list_filter({parts}, lambda w: NOT list_contains({stop}, w)))"
    plain = f"replace({x}, '_', '')"
    return (
        f"(len({parts}) BETWEEN 1 AND 4 AND length({x}) >= 5 AND {own} >= CASE WHEN len({parts}) > 2 THEN 2 ELSE 1 END AND len(list_filter({parts}, lambda w: length(w) < 3)) = 0"
        f" AND len(regexp_extract_all({plain}, '[aeiouAEIOU]')) >= 0.20::DOUBLE * length({plain}))"
    )


def compare_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace(regexp_replace(replace(lower({strip_sql(x)}), '/', '-'), '[^a-z0-9\- ]', '', 'g'), '\s+', ' ', 'g')")


def slug_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({strip_sql(x)}), '[^a-z0-9]+', '_', 'g'), '^[_\-]+|[_\-]+$', '', 'g')"


def vote_sql(source: str, value: str, ties: str = "") -> str:
    return f"""
, c AS (SELECT doc_id, {value}, count(*) AS n, min(variant) AS f FROM {source} WHERE {value} <> '' GROUP BY doc_id, {value})
SELECT doc_id, {value}, n AS n_votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC{ties}, f) AS r FROM c) WHERE r = 1"""


# -- texts ---------------------------------------------------------------------


@query(f"{CARDS} SELECT doc_id, variant, {CLASSIFY_SQL} AS jenis FROM cards")
def classify_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", fx.classify(F.col("text")).alias("jenis"))


@query(f"{CARDS} SELECT truth, {CLASSIFY_SQL} AS predicted, count(*) AS n FROM cards GROUP BY ALL")
def classify_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.cards(spark, sf_dir).select("truth", fx.classify(tx.clean_text(F.col("text"))).alias("predicted"))
    return rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x20-\x7E\n\t\x{00C0}-\x{024F}]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents"
)
def clean_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(text, '{p}'))"


_TRIMMED = f"list_transform({lines_sql()}, lambda x: {strip_sql('x')})"
_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(f"""{CARDS}, p AS (
  SELECT doc_id, variant, least({_count('[A-Za-z]{4,}')}, 60) + 8 * len(list_filter({words_list(lx.KEYWORDS)}, lambda k: contains(lower(text), k)))
      + 6 * {_count(r'\d{2}[-/]\d{2}[-/]\d{4}')} + 6 * {_count(r'\b\d{14,16}\b')} + 3 * {_count(r'\b\d{10,13}\b')} AS base,
    15 * len(list_filter({_TRIMMED}, lambda y: regexp_matches(y, '^[A-Z][A-Z\\s]{{3,35}}$') AND length(y) >= 5 AND len(string_split_regex(y, '\\s+')) BETWEEN 2 AND 5))
      + 12 * len(list_filter({_TRIMMED}, lambda y: regexp_matches(y, '^\\d+\\.\\s+[A-Z][A-Z\\s]{{3,35}}$')))
      + 10 * {_count(r'\d{1,2}[-/.]\d{1,2}[-/.]\d{4}')} + 10 * len(list_filter({words_list(lx.SCORE_CITIES)}, lambda k: contains(lower(text), k))) AS extra,
    len(list_filter({_TRIMMED}, lambda y: y <> '' AND NOT regexp_matches(y, '[A-Za-z]{{3,}}')))::DOUBLE / greatest(1, len(list_filter({_TRIMMED}, lambda y: y <> ''))) AS noisy,
    len(list_filter({_TOKENS}, lambda t: length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) < 3))::DOUBLE / len({_TOKENS}) - 0.5::DOUBLE AS excess
  FROM cards)
SELECT doc_id, variant, (base + extra - trunc(base * noisy * 0.9::DOUBLE) - trunc((base + extra) * greatest(0.0::DOUBLE, excess)))::INT AS score FROM p""")
def quality_score_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", tx.quality_score(F.col("text")).alias("score"))


@query()
def quality_score_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over raw documents; DuckDB's word boundaries are ASCII only, so the SQL stands beside the cards' query."""
    return plan.table(spark, sf_dir, "documents").select("doc_id", tx.quality_score(F.col("text")).alias("score"))


@query(f"SELECT c_custkey, {slug_sql('c_name')} AS slug, {compare_sql('c_name')} AS compared FROM customer")
def slug_and_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.table(spark, sf_dir, "customer").select("c_custkey", tx.slugify(F.col("c_name")).alias("slug"), tx.normalize_for_compare(F.col("c_name")).alias("compared"))


@query(f"SELECT p_partkey, {clean_name_sql('p_name')} AS name, {plausible_sql(clean_name_sql('p_name'))} AS plausible FROM part")
def clean_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.table(spark, sf_dir, "part").select("p_partkey", tx.clean_name(F.col("p_name")).alias("name"))
    return rows.withColumn("plausible", tx.is_plausible_name(F.col("name")))


_CITY = "lower(city)"
_CITIES = words_list(lx.CITIES)


@query(f"""WITH n AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'PATEN' WHEN 1 THEN 'SH' WHEN 2 THEN '' ELSE 'X' END || substr(c, (c_custkey % 3)::INT + 1) AS city
  FROM (SELECT c_custkey, {_CITIES}[(c_custkey % 54)::INT + 1] AS c FROM customer))
SELECT c_custkey, upper(CASE WHEN {_CITY} = '' THEN city ELSE coalesce(CASE WHEN list_contains({_CITIES}, {_CITY}) THEN {_CITY} END, list_filter({_CITIES}, lambda k: contains({_CITY}, k))[1],
  {', '.join(f"CASE WHEN length({_CITY}) >= {n} THEN list_filter({_CITIES}, lambda k: ends_with(k, right({_CITY}, {n})))[1] END" for n in range(4, 8))}, city) END) AS city FROM n""")
def normalize_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities with noise in front or letters missing."""
    k = F.col("c_custkey")
    noise = F.when(k % 6 == 0, "PATEN").when(k % 6 == 1, "SH").when(k % 6 == 2, "").otherwise("X")
    city = F.get(tx.literal_array(lx.CITIES), (k % 54).cast("int"))
    noisy = F.concat(noise, F.substring(city, (k % 3).cast("int") + 1, F.lit(99)))
    return plan.spread(spark, sf_dir, "customer").select("c_custkey", noisy.alias("city")).select("c_custkey", tx.normalize_city(F.col("city")).alias("city"))


# -- fields --------------------------------------------------------------------


@query(f"{CARDS} SELECT doc_id, variant, {NIK_SQL} AS nik FROM cards")
def nik_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", fx.nik(F.col("text")).alias("nik"))


@query(rf"""{CARDS}, f AS (SELECT doc_id, variant, {_FILLED} AS rows FROM cards),
half AS (SELECT doc_id, variant, arg_min(lpad(regexp_extract(x, '{_DAY}', 1), 2, '0') || '-' || regexp_extract(x, '{_DAY}', 2) || '-' || year, i) AS d FROM
  (SELECT *, coalesce(list_filter(list_transform(rows[i + 1:i + 3], lambda y: regexp_extract(y, '\b((?:19|20)\d{{2}})\b', 1)), lambda y: y <> '')[1], '') AS year FROM (SELECT doc_id, variant, rows, unnest(rows) AS x, generate_subscripts(rows, 1) AS i FROM f))
  WHERE regexp_matches(x, '{_DAY}') AND year <> '' GROUP BY ALL)
SELECT doc_id, variant, coalesce(nullif({DATE_SQL}, ''), d, '') AS tanggal_lahir, {GENDER_SQL} AS jenis_kelamin FROM cards LEFT JOIN half USING (doc_id, variant)""")
def date_and_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", fx.birth_date(F.col("text")).alias("tanggal_lahir"), fx.gender(F.col("text")).alias("jenis_kelamin"))


def city_sql(x: str) -> str:
    """Upper-case city of the list that ``x`` stands for."""
    low, cities = f"lower({strip_sql(x)})", words_list(lx.CITIES)
    ends = ", ".join(f"CASE WHEN length({low}) >= {n} THEN list_filter({cities}, lambda k: ends_with(k, right({low}, {n})))[1] END" for n in range(4, 8))
    return f"upper(CASE WHEN {low} = '' THEN {x} ELSE coalesce(CASE WHEN list_contains({cities}, {low}) THEN {low} END, list_filter({cities}, lambda k: contains({low}, k))[1], {ends}, {x}) END)"


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


def last_word_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: length(w) >= 2)[-1]"


_PLACE = strip_sql(r"regexp_replace(regexp_extract(x, ':\s*([^,\-]*)', 1), '[^A-Za-z\s]', '', 'g')")
_PLACES = f"list_filter(list_transform({LABEL_LINES}, lambda x: {_PLACE}), lambda p: length(p) > 2)[1]"
_BEFORE = r"regexp_extract(text, '([A-Za-z][A-Za-z\s]{0,25})[,\.\-:]+\s*\d{1,2}[-/\.]\d{2}[-/\.]\d{4}', 1)"
_PARTED = r"([A-Za-z][A-Za-z\s]{0,20})[,\.\-:]+\s*\d{1,2}[-/\.]\d{2}\s*$"
_BESIDE = strip_sql(r"""regexp_extract(x, '(?i)\b(?:ALAMAT|MAMAT)\b\s*[:"''*#@]?\s*(.+)', 1)""")


@query(rf"""{CARDS}, f AS (SELECT doc_id, variant, text, {_FILLED} AS rows FROM cards),
half AS (SELECT doc_id, variant, arg_min(regexp_extract(x, '{_PARTED}', 1), i) AS p FROM (SELECT doc_id, variant, rows, unnest(rows) AS x, generate_subscripts(rows, 1) AS i FROM f)
  WHERE regexp_matches(x, '{_PARTED}') AND len(list_filter(rows[i + 1:i + 3], lambda y: regexp_matches(y, '\b(?:19|20)\d{{2}}\b'))) > 0 GROUP BY ALL),
place AS (SELECT doc_id, variant, coalesce({_PLACES}, {last_word_sql(_BEFORE)}, {last_word_sql("p")}, '') AS raw FROM f LEFT JOIN half USING (doc_id, variant)),
l AS (SELECT doc_id, variant, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cards),
m AS (SELECT *, regexp_matches(upper(x), '\b(?:ALAMAT|MAMAT)\b') AS label, regexp_matches(upper(x), '{fx.ADDRESS_STOP}') AS stop FROM l),
t AS (SELECT *, max(label::INT) OVER w AS begun, CASE WHEN label THEN {_BESIDE} ELSE {strip_sql('x')} END AS part FROM m WINDOW w AS (PARTITION BY doc_id, variant ORDER BY i)),
n AS (SELECT *, sum((part <> '' AND begun = 1)::INT) OVER (PARTITION BY doc_id, variant ORDER BY i) AS taken FROM t),
e AS (SELECT *, coalesce(max((begun = 1 AND NOT label AND (stop OR taken >= 3))::INT) OVER (PARTITION BY doc_id, variant ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM n),
a AS (SELECT doc_id, variant, left(regexp_replace(string_agg(part, ' ' ORDER BY i), '\s+', ' ', 'g'), 200) AS alamat FROM e WHERE begun = 1 AND ended = 0 AND (label OR NOT stop) AND part <> '' GROUP BY ALL)
SELECT doc_id, variant, CASE WHEN raw = '' THEN '' ELSE {title_sql(city_sql('raw'))} END AS tempat_lahir, coalesce(alamat, '') AS alamat FROM place LEFT JOIN a USING (doc_id, variant)""")
def place_and_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", fx.birth_place(F.col("text")).alias("tempat_lahir"), fx.address(F.col("text")).alias("alamat"))


_NAME_LINES = rf"list_filter({lines_sql()}, lambda x: regexp_matches(upper(x), '\bNA\s*MA?\b') AND NOT regexp_matches(upper(x), 'KEPALA\s+KELUARGA'))"
_NAME_WAYS = f"flatten(list_transform({_NAME_LINES}, lambda x: [regexp_extract(x, ':(.*)', 1), regexp_extract(x, '(?i)NA\\s*MA?\\s+([A-Za-z ]{{3,}})', 1)]))"
_NAME_SQL = f"coalesce(list_filter(list_transform({_NAME_WAYS}, lambda r: {clean_name_sql('r')}), lambda r: r <> '')[1], '')"


@query(f"{CARDS} SELECT doc_id, variant, {_NAME_SQL} AS nama FROM cards")
def name_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", fx.name_from_label(F.col("text")).alias("nama"))


def re2(pattern: str) -> str:
    """A pattern with looks at neighbours for an engine that has none: the neighbours are consumed, which no captured value notices."""
    return pattern.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])").replace("(?=", "(?:")


def _header_sql(field: str) -> str:
    def value(p):
        own = f"regexp_extract(text, '(?im){re2(p)}', 1)"
        found = rf"regexp_replace({strip_sql(own)}, '\s*[:\-—#\d\.]\s*$', '')"
        kept = f"array_to_string(list_filter(string_split_regex({found}, '\\s+'), lambda w: w <> '' AND NOT list_contains({words_list(lx.HEADER_STOP)}, upper(w))), ' ')"
        return f"CASE WHEN length({kept}) >= 3 THEN upper({kept}) END"

    return f"coalesce({', '.join(map(value, lx.HEADER_PATTERNS[field]))}, '') AS {field}"


@query(f"{CARDS} SELECT doc_id, variant, {', '.join(map(_header_sql, lx.HEADER_PATTERNS))} FROM cards")
def kk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", *[fx.header_field(F.col("text"), f).alias(f) for f in lx.HEADER_PATTERNS])


# all lines of cards as rows: x at place i, stripped, y the line behind
EVERY_LINE = f"""{CARDS}, l AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id, variant ORDER BY i), '') AS y FROM (SELECT doc_id, variant, {strip_sql('x')} AS x, i FROM (SELECT doc_id, variant, unnest({lines_sql()}) AS x, generate_subscripts({lines_sql()}, 1) AS i FROM cards)))"""


def _ok16(x: str) -> str:
    return f"regexp_matches({x}, '^[1-9][0-9]')"


@query(f"""{EVERY_LINE}, near AS (
  SELECT doc_id, variant, 0 AS i, 0 AS j, regexp_extract(text, '(?i){lx.FAMILY_NUMBER_LABELLED}', 1) AS raw, 1 AS way FROM cards
  UNION ALL SELECT doc_id, variant, i, 0, coalesce(nullif(regexp_extract(x, '(?i){lx.FAMILY_NUMBER_LINE}{lx.FAMILY_NUMBER_VALUE}', 1), ''), CASE WHEN regexp_matches(x, '(?i){lx.FAMILY_NUMBER_LINE}$') THEN regexp_extract(y, '^{lx.FAMILY_NUMBER_VALUE}', 1) END, ''), 1 FROM l
  UNION ALL SELECT doc_id, variant, i, generate_subscripts(r, 1), unnest(r), 2 FROM (SELECT doc_id, variant, i, list_filter(regexp_extract_all(x, '[0-9A-Za-z?#*]+'), lambda t: regexp_full_match(t, '[?#*]{{0,2}}[1-9][0-9A-Za-z?]{{13,17}}')) AS r FROM l WHERE NOT regexp_matches(x, '(?i){lx.OTHER_NUMBER_LINE}'))
), d AS (SELECT *, {digits_sql("regexp_replace(raw, '[^0-9A-Za-z?]', '', 'g')", lx.KK_DIGITS)} AS d FROM near),
v AS (SELECT *, CASE WHEN length(d) = 16 AND {_ok16('d')} THEN d WHEN length(d) = 17 AND {_ok16('substr(d, 2)')} THEN substr(d, 2) WHEN length(d) = 18 AND {_ok16('substr(d, 3)')} THEN substr(d, 3)
  WHEN length(d) > 16 AND {_ok16('d')} THEN left(d, 16) WHEN length(d) = 15 AND {_ok16('d')} THEN d || '0' WHEN length(d) = 14 AND {_ok16('d')} THEN d ELSE '' END AS number FROM d),
c AS (SELECT doc_id, variant, way, number, count(*) AS n, min(i * 1000 + j) AS f FROM v WHERE number <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, variant ORDER BY way, n DESC, f) AS k FROM c)
SELECT doc_id, variant, coalesce(number, '') AS nomor_kk FROM cards LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (doc_id, variant)""")
def family_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", family.family_number(F.col("text")).alias("nomor_kk"))


def _pad3(x: str) -> str:
    return f"CASE WHEN length({x}) < 3 THEN lpad({x}, 3, '0') ELSE {x} END"


def _within(a: str, b: str) -> str:
    return f"(coalesce(TRY_CAST({a} AS INT), 0) BETWEEN 1 AND 200 AND coalesce(TRY_CAST({b} AS INT), 0) BETWEEN 1 AND 50)"


def _explicit(p: str) -> str:
    a, b = f"regexp_extract(text, '{p}', 1)", f"regexp_extract(text, '{p}', 2)"
    return f"CASE WHEN {a} <> '' THEN ({_pad3(a)}) || '/' || ({_pad3(b)}) END"


def _fused(d: str) -> str:
    p = lambda a, n: f"substr({d}, {a}, {n})"
    seven = " ".join(f"WHEN length({d}) = 7 AND {_within(a, b)} THEN {a} || '/' || {b}" for a, b in ((p(1, 3), p(5, 3)), (p(2, 3), p(5, 3))))
    return f"CASE {seven} WHEN length({d}) >= 6 THEN {p(1, 3)} || '/' || {p(4, 3)} END"


def _licence(k: int) -> str:
    pattern = r"([0-9A-Za-z]{3,5})\s*[-–]\s*([0-9A-Za-z]{3,7})\s*[-–]?\s*([0-9A-Za-z]{3,8})"
    return digits_sql(f"regexp_extract(regexp_replace(x, '^[^0-9]+', ''), '{pattern}', {k})", lx.SIM_DIGITS)


def _cut446(d: str) -> str:
    return f"substr({d}, 1, 4) || '-' || substr({d}, 5, 4) || '-' || substr({d}, 9, 6)"


_RT = "(?i)(?:RTRW|RTIRW|BURW|RT[I1]?RW)"
_RT_A, _RT_B = (digits_sql(rf"regexp_extract(x, '([0-9A-Za-z]{{2,4}})\s*/\s*([0-9A-Za-z]{{2,4}})', {k})", lx.RTRW_FUSED) for k in (1, 2))
_RT_RUN = digits_sql(r"regexp_extract(x, '(?i)([0-9A-Za-z]{6,8})\s+(?:Kabupaten|Kecamatan)', 1)", lx.RTRW_FUSED)
_RT_BEHIND = digits_sql(f"regexp_extract(text, '{_RT}" + r"\s*[:\-]?\s*([0-9A-Za-z]{4,10})\b', 1)", lx.RTRW_DIGITS)
_RT_BELOW = digits_sql(f"regexp_extract(text, '{_RT}" + r"\s*\n\s*([0-9A-Za-z]{4,10})', 1)", lx.RTRW_DIGITS)
_RT_PLAIN, _RT_DOTS = _explicit(r"(?i)RT[/I\s.]*RW[.\s:]*(\d{2,3})[/\s\-](\d{2,3})"), _explicit(r"(?i)RT\.?(\d{2,3})/RW\.?(\d{2,3})")
_WHOLE, _AFTER = digits_sql(r"regexp_replace(x, '\s+', '', 'g')", lx.SIM_DIGITS), digits_sql(r"regexp_extract(x, '[:\-]\s*(.*)$', 1)", lx.SIM_DIGITS)


@query(rf"""{EVERY_LINE}, slash AS (SELECT doc_id, variant, arg_min(({_pad3('a')}) || '/' || ({_pad3('b')}), i) AS v4 FROM (SELECT *, {_RT_A} AS a, {_RT_B} AS b FROM l) WHERE length(a) >= 2 AND length(b) >= 2 AND {_within('a', 'b')} AND regexp_matches(x, '(?i)Kabupaten|Kota|BEKASI|JAKARTA') GROUP BY ALL),
runs AS (SELECT doc_id, variant, arg_min({_fused('d')}, i) AS v5 FROM (SELECT *, {_RT_RUN} AS d FROM l) WHERE length(d) >= 6 GROUP BY ALL),
one AS (SELECT doc_id, variant, {_RT_BEHIND} AS d2, {_RT_BELOW} AS d3, {_RT_PLAIN} AS v1, {_RT_DOTS} AS v1b FROM cards),
s AS (SELECT doc_id, variant, x, row_number() OVER (PARTITION BY doc_id, variant ORDER BY i) AS i FROM l WHERE x <> ''),
p AS (SELECT *, {_licence(1)} AS a, {_licence(2)} AS b, {_licence(3)} AS c, {_WHOLE} AS whole, {_AFTER} AS behind FROM s),
w AS (SELECT doc_id, variant, i, CASE WHEN i <= 12 AND length(a || b || c) >= 10 AND length(a) >= 2 THEN 1 WHEN i <= 8 AND length(whole) >= 14 AND whole NOT LIKE '0%' THEN 2 WHEN i <= 10 AND regexp_matches(x, '(?i)\bNo\.?\s*SIM\b') AND length(behind) >= 12 THEN 3 END AS way,
  lpad(left(a, 4), 4, '0') AS head, substr(a || b || c, 5) AS rest, whole, behind FROM p),
n AS (SELECT doc_id, variant, arg_min(CASE way WHEN 1 THEN head || '-' || lpad(left(rest, 4), 4, '0') || '-' || CASE WHEN length(rest) >= 6 THEN lpad(substr(rest, 5, 6), 6, '0') ELSE rpad(substr(rest, 5, 6), 6, '0') END WHEN 2 THEN {_cut446('whole')} ELSE {_cut446('behind')} END, way * 1000 + i) AS number FROM w WHERE way IS NOT NULL GROUP BY ALL)
SELECT doc_id, variant, coalesce(number, '') AS no_sim, coalesce(v1, v1b, {_fused('d2')}, {_fused('d3')}, v4, v5, '') AS rtrw FROM one LEFT JOIN slash USING (doc_id, variant) LEFT JOIN runs USING (doc_id, variant) LEFT JOIN n USING (doc_id, variant)""")
def licence_and_rtrw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", fx.licence_number(F.col("text")).alias("no_sim"), fx.rt_rw(F.col("text")).alias("rtrw"))


@query()
def family_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.cards(spark, sf_dir).select("doc_id", "variant", *[way(F.col("text")).alias(n) for n, way in family.HEAD_WAYS.items()])
    # each way is gone once; the head is the first that gave a name
    return rows.select("doc_id", "variant", tx.first_of(*map(F.col, family.HEAD_WAYS)).alias("nama_kepala"), *family.HEAD_WAYS)


# lines of cards as rows: x at place i, y the line behind
LINE_ROWS = f"""{CARDS}, cut AS (SELECT doc_id, variant, list_filter(list_transform({lines_sql()}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM cards),
l AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id, variant ORDER BY i), '') AS y FROM (SELECT doc_id, variant, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM cut))"""


def first_line_sql(value: str, source: str, where: str) -> str:
    """Value of the first row for every variant, empty without one."""
    return f"SELECT doc_id, variant, coalesce(v, '') AS {value} FROM cut LEFT JOIN (SELECT doc_id, variant, arg_min(v, i) AS v FROM {source} WHERE {where} GROUP BY ALL) USING (doc_id, variant)"


_PLAIN = r"regexp_replace(x, '[\s\-]', '', 'g')"
_NUMBER = rf"((length({_PLAIN}) >= 14 AND length({digits_sql(_PLAIN, lx.NIK_DIGITS)}) >= 13) OR regexp_matches(upper(x), '\bN\s*[I1]\s*K\b'))"
_QUIET = r"length(regexp_replace(x, '[A-Za-z\s]', '', 'g')) <= 0.40::DOUBLE * length(x) AND regexp_matches(x, '[A-Za-z]')"
_FREE = f"len(list_intersect(list_transform(regexp_extract_all(x, '[A-Za-z]{{2,}}'), lambda w: lower(w)), {words_list(lx.NUMBER_STOPWORDS)})) = 0"


@query(f"""{LINE_ROWS}, n AS (SELECT *, max(number) OVER (PARTITION BY doc_id, variant ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS near
  FROM (SELECT doc_id, variant, i, x, {_NUMBER}::INT AS number, CASE WHEN {_QUIET} AND {_FREE} THEN {clean_name_sql('x')} ELSE '' END AS v FROM l))
{first_line_sql('nama', 'n', f"near = 1 AND v <> '' AND {plausible_sql('v')}")}""")
def name_behind_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", nx.name_after_number(F.col("text")).alias("nama"))


@query(f"""{LINE_ROWS}, w AS (SELECT *, lower(array_to_string(ps, '_')) AS v FROM (SELECT *, regexp_extract_all(x, '[A-Za-z]{{3,}}') AS ps FROM l WHERE i <= 15))
{first_line_sql('nama', 'w', f"len(ps) BETWEEN 2 AND 4 AND NOT regexp_matches(regexp_replace(x, '^[^A-Za-z]+', ''), '[0-9]') AND upper(array_to_string(ps, '')) = array_to_string(ps, '') AND len(list_intersect(string_split(v, '_'), {words_list(lx.CAPITAL_STOPWORDS)})) = 0 AND {plausible_sql('v')}")}""")
def name_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", nx.name_in_capitals(F.col("text")).alias("nama"))


@query()
def licence_name_and_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    values = [nx.name_on_licence(text).alias("nama"), ax.licence_address_below_gender(text).alias("below"), ax.licence_address_elsewhere(text).alias("elsewhere")]
    return plan.cards(spark, sf_dir).select("doc_id", "variant", *values)


_BEHIND = r"regexp_extract(x, '(?i)Alamat\s*:?\s*(.*)$', 1)"
_RAW = rf"CASE WHEN label THEN CASE WHEN length({strip_sql(_BEHIND)}) > 3 THEN {_BEHIND} ELSE y END WHEN regexp_matches(x, '(?i){ax.FAMILY_WORD}|BLOK') THEN x ELSE '' END"
_WORDED = f"regexp_extract(raw, '(?i)(?:{ax.FAMILY_WORD}).+')"


def _address_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace({x}, '[^A-Za-z0-9\s./]', ' ', 'g')")


_CUT = rf"regexp_replace({_WORDED}, '(?is)\s+(?:Kecamatan|Kelurahan|Kabupaten|Kota).*$', '')"


@query(rf"""{LINE_ROWS}, r AS (SELECT *, {_RAW} AS raw FROM (SELECT *, regexp_matches(x, '(?i)\bAlamat\b') AS label FROM l)),
a AS (SELECT doc_id, variant, i, label, CASE WHEN {_WORDED} <> '' THEN {_address_sql(_CUT)} WHEN length({_address_sql('raw')}) >= 5 THEN {_address_sql('raw')} ELSE '' END AS v FROM r)
{first_line_sql('alamat', 'a', "label OR v <> ''")}""")
def family_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cards(spark, sf_dir).select("doc_id", "variant", ax.family_address(F.col("text")).alias("alamat"))


# -- decisions -----------------------------------------------------------------


@query(
    "SELECT conv_id, score, role, turn, text FROM (SELECT conv_id, length(text)::INT AS score, role, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, role DESC, turn DESC, text DESC) AS r FROM conversations) WHERE r = 1"
)
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in place of a document's variants."""
    rows = plan.table(spark, sf_dir, "conversations").withColumn("score", F.length("text"))
    return vote.best_variant(rows, "conv_id", ["score", "role", "turn", "text"])


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, role DESC, turn DESC)::INT AS rank FROM conversations")
def rank_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.table(spark, sf_dir, "conversations").withColumn("score", F.length("text"))
    return vote.rank_variants(rows, "conv_id", ["score", "role", "turn"]).select("conv_id", "turn", "rank")


@query(f"{CARDS}, s AS (SELECT doc_id, variant, {NIK_SQL} AS nik FROM cards)" + vote_sql("s", "nik"))
def vote_nik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.vote(nik_extract(spark, sf_dir), "doc_id", "nik", "variant")


@query(f"{CARDS}, s AS (SELECT doc_id, variant, CASE WHEN {plausible_sql('nama')} THEN nama ELSE '' END AS nama FROM (SELECT doc_id, variant, {_NAME_SQL} AS nama FROM cards))" + vote_sql("s", "nama", ", len(string_split(nama, '_')) DESC, length(nama) DESC"))
def vote_name_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = name_extract(spark, sf_dir)
    return vote.vote_name(rows.withColumn("nama", fx.plausible(F.col("nama"))), "doc_id", "nama", "variant")


@query(r"""WITH s AS (SELECT c_nationkey AS doc_id, c_custkey AS variant, CASE WHEN c_custkey % 3 = 0 THEN 'JL. ' ELSE '' END || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' NO' ELSE '' END AS alamat FROM customer),
pool AS (SELECT * FROM (SELECT *, regexp_matches(alamat, '(?i)\b(JL|JALAN|KP|GG|BLOK|PERUM)\b') AS k, bool_or(regexp_matches(alamat, '(?i)\b(JL|JALAN|KP|GG|BLOK|PERUM)\b')) OVER (PARTITION BY doc_id) AS any_k FROM s) WHERE k OR NOT any_k)""" + vote_sql("pool", "alamat", ", length(alamat)"))
def vote_address_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 3 == 0, "JL. ").otherwise(""), F.col("c_mktsegment"), F.when(k % 2 == 0, " NO").otherwise(""))
    rows = plan.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), k.alias("variant"), text.alias("alamat"))
    return vote.vote_address(rows, "doc_id", "alamat", "variant")


@query(f"""{CARDS}, r AS (SELECT doc_id, unnest(['nik', 'jenis_kelamin', 'jenis_dokumen']) AS field, unnest([{NIK_SQL}, {GENDER_SQL}, {CLASSIFY_SQL}]) AS value FROM cards),
c AS (SELECT doc_id, field, lower(value) AS v, count(*) AS n FROM r WHERE value <> '' GROUP BY ALL), t AS (SELECT doc_id, field, max(n) AS top FROM c GROUP BY ALL)
SELECT d.doc_id, f.field, round_even(coalesce(top, 0) / 5.0::DOUBLE * 100, 1) AS confidence FROM (SELECT DISTINCT doc_id FROM cards) d CROSS JOIN (SELECT unnest(['nik', 'jenis_kelamin', 'jenis_dokumen']) AS field) f LEFT JOIN t USING (doc_id, field)""")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = plan.cards(spark, sf_dir).select("doc_id", fx.nik(text).alias("nik"), fx.gender(text).alias("jenis_kelamin"), fx.classify(text).alias("jenis_dokumen"))
    return vote.confidence(rows, "doc_id", ["nik", "jenis_kelamin", "jenis_dokumen"])


@query("""WITH b AS (SELECT user_id, event_id % 4 * 90 AS angle, max(floor(value))::BIGINT AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, angle) AS k, max(score) FILTER (angle = 0) OVER (PARTITION BY user_id) AS upright FROM b)
SELECT user_id, (CASE WHEN angle <> 0 AND score > upright * CASE WHEN angle = 180 THEN 1.15::DOUBLE ELSE 1.30::DOUBLE END THEN angle ELSE 0 END)::BIGINT AS angle FROM r WHERE k = 1""")
def orientation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a user's events in place of OCR scores at four angles."""
    rows = plan.table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4 * 90).alias("angle")).agg(F.max(F.floor("value")).alias("score"))
    return vote.pick_orientation(rows, "user_id")


@query("SELECT conv_id, turn, unnest([6, 11, 3]) AS psm FROM conversations")
def variant_psm_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.every_mode(plan.table(spark, sf_dir, "conversations").select("conv_id", "turn"))


@query()
def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.cards(spark, sf_dir).select("doc_id", F.lit("v").alias("label"), F.col("variant").alias("psm"), "text")
    return records.fallback_texts(rows.where("psm < 3"), rows.where("psm >= 3"))


@query()
def card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: text variants to one record per document."""
    texts = plan.cards(spark, sf_dir).select("doc_id", F.lit("v").alias("label"), F.col("variant").alias("psm"), "text")
    return records.build_records(texts)


# -- figures -------------------------------------------------------------------


def _complete_sql() -> str:
    some = lambda fields: " + ".join(f"({f} <> '')::INT" for f in fields)
    filled = "CASE jenis_dokumen " + " ".join(f"WHEN '{k}' THEN {some(v)}" for k, v in lx.RELEVANT_FIELDS.items()) + " ELSE (nama <> '')::INT END"
    total = "CASE jenis_dokumen " + " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in lx.RELEVANT_FIELDS.items()) + " ELSE 1 END"
    return f", full_records AS (SELECT *, {filled} AS fields_filled, {total} AS fields_total, round_even(({filled})::DOUBLE / ({total}), 2) AS field_completeness FROM records)"


FULL = RECORDS + _complete_sql()


@query(f"{FULL} SELECT doc_id, fields_filled, fields_total, field_completeness FROM full_records")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.completeness(plan.records(spark, sf_dir)).select("doc_id", "fields_filled", "fields_total", "field_completeness")


@query(f"""{FULL} SELECT count(*) AS total, count(*) FILTER (contains(status, 'VALID')) AS valid, count(*) FILTER (contains(status, 'ERROR')) AS error,
  round_even(count(*) FILTER (contains(status, 'VALID')) * 100.0::DOUBLE / count(*), 1) AS success_rate_pct, round_even(avg(field_completeness) FILTER (contains(status, 'VALID')), 3) AS avg_completeness FROM full_records""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.batch_stats(evaluate.completeness(plan.records(spark, sf_dir)))


@query(f"""{FULL} SELECT jenis_dokumen, count(*) AS n, count(*) FILTER (contains(status, 'VALID')) AS n_valid, round_even(avg(field_completeness) FILTER (contains(status, 'VALID')), 3) AS avg_completeness
FROM full_records GROUP BY jenis_dokumen""")
def completeness_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_type(evaluate.completeness(plan.records(spark, sf_dir)))


MATCHED = f"""{RECORDS}, truth AS ({plan.TRUTH}),
asli AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nama_file_asli ORDER BY path_asal DESC) AS r FROM records) WHERE r = 1),
baru AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nama_file_baru ORDER BY path_asal DESC) AS r FROM records) WHERE r = 1)"""
LONG = MATCHED + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, t.{f} AS t, CASE WHEN a.doc_id IS NOT NULL THEN a.{f} ELSE coalesce(b.{f}, '') END AS p FROM truth t LEFT JOIN asli a ON t.nama_file = a.nama_file_asli LEFT JOIN baru b ON t.nama_file = b.nama_file_baru" for f in lx.EVALUATED_FIELDS
) + f"""), counts AS (SELECT field, count(*) FILTER (t <> '' AND p <> '' AND {compare_sql('t')} = {compare_sql('p')}) AS tp,
  count(*) FILTER (p <> '' AND NOT (t <> '' AND {compare_sql('t')} = {compare_sql('p')})) AS fp, count(*) FILTER (t <> '' AND p = '') AS fn FROM long GROUP BY field),
scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM
  (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM counts))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match_truth(plan.truth(spark, sf_dir), plan.records(spark, sf_dir))


@query(f"""{MATCHED} SELECT count(*) AS total, count(*) FILTER (a.doc_id IS NOT NULL OR b.doc_id IS NOT NULL) AS matched, count(*) FILTER (a.doc_id IS NULL AND b.doc_id IS NULL) AS unmatched
FROM truth t LEFT JOIN asli a ON t.nama_file = a.nama_file_asli LEFT JOIN baru b ON t.nama_file = b.nama_file_baru""")
def gt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("record").isNotNull()
    return _matched(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(found).alias("matched"), F.count_if(~found).alias("unmatched"))


@query(LONG + " SELECT field, tp, fp, fn, round_even(precision, 3) AS precision, round_even(recall, 3) AS recall, round_even(f1, 3) AS f1 FROM scores")
def prf_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rounded_scores(evaluate.field_scores(_matched(spark, sf_dir)))


@query(LONG + " SELECT round_even(avg(precision), 3) AS precision, round_even(avg(recall), 3) AS recall, round_even(avg(f1), 3) AS f1, count(*) AS fields FROM scores WHERE tp + fp + fn > 0")
def prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_scores(evaluate.field_scores(_matched(spark, sf_dir)))


_MS = r"regexp_extract(waktu_proses, '(\d+)', 1)::BIGINT"
_HAND = "CASE jenis_dokumen " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.MANUAL_SECONDS.items()) + f" ELSE {lx.MANUAL_SECONDS_DEFAULT} END"


@query(f"""{RECORDS} SELECT round_even(avg({_MS}), 0) AS avg_ms, min({_MS}) AS min_ms, max({_MS}) AS max_ms, round_even(sum({_MS}) / 1000.0::DOUBLE, 1) AS total_s, sum({_HAND})::BIGINT AS manual_s,
  round_even(sum({_HAND}) * 1000.0::DOUBLE / sum({_MS}), 1) AS speedup FROM records""")
def time_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.time_figures(plan.records(spark, sf_dir))


@query(f"{RECORDS} SELECT jenis_dokumen, round_even(avg({_MS}), 0) AS avg_ms FROM records GROUP BY jenis_dokumen")
def time_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.time_by_type(plan.records(spark, sf_dir))


_STEM = r"regexp_replace(nama_file_baru, '\.[^.]*$', '')"


@query(rf"""{RECORDS}, i AS (SELECT nama_file_baru = '' OR NOT regexp_matches(nama_file_baru, '{lx.FILE_NAME}') OR NOT starts_with(nama_file_baru, jenis_dokumen || '_') OR {_STEM} <> lower({_STEM}) OR contains(nama_file_baru, ' ') AS bad
  FROM records WHERE contains(status, 'VALID'))
SELECT round_even(count(*) FILTER (NOT bad) * 100.0::DOUBLE / count(*), 1) AS compliance_pct, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid FROM i""")
def naming_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.naming_compliance(plan.records(spark, sf_dir))


_OK = "(jenis_dokumen <> 'unknown' AND nama <> '')"
_SLUG = f"coalesce(nullif({slug_sql('nama')}, ''), 'unknown')"


@query(f"""{RECORDS}, p AS (SELECT doc_id, path_asal, CASE WHEN {_OK} THEN upper(jenis_dokumen) || '/' || jenis_dokumen || '_' || {_SLUG} ELSE 'ERROR/' || subfolder END AS folder,
  CASE WHEN {_OK} THEN jenis_dokumen || '_' || {_SLUG} || '.jpg' ELSE nama_file_asli END AS file FROM records),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY path_asal) - 1 AS k FROM p)
SELECT doc_id, folder || '/' || CASE WHEN k = 0 THEN file ELSE regexp_replace(file, '\\.[^.]+$', '') || '_' || k || lower(regexp_extract(file, '(\\.[^.]+)$', 1)) END AS path FROM n""")
def template_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = naming.plan_paths(plan.records(spark, sf_dir))
    return naming.suffix_duplicates(moves, "path_asal").select("doc_id", "path")


@query(
    f"WITH p AS ({plan.PATHS}) SELECT doc_id, path FROM p WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|tiff|tif)$') AND len(list_intersect(string_split(path, '/')[1:-2], {words_list(lx.SKIPPED_FOLDERS)})) = 0"
)
def image_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.only_images(plan.paths(spark, sf_dir))
