"""Operator 8, quality rules: rules on documents, and host verdicts with an empirical beta prior.

Each document is measured in its own row (no shuffle of texts, no exploding).  Failures are summed by host,
the failure rate of each host is shrunk towards the rate of all hosts by a beta prior fitted to the hosts
by moments, and hosts whose shrunk rate is above ``HOST_LIMIT`` lose all their documents.  A host with few documents
stays near the common rate; one that holds a third of the corpus is summed map-side, and the join back may be split by skew.

Repeated words: an 8-word window counts as repeated when the text has it twice or more.  Windows are hashed to 64 bits in the
row; only texts in which two windows share a hash are sorted, and there neighbours are compared word by word.

Defined results
* a null or empty text has no words and fails; a null host is the host ``''``;
* rows that repeat an id are judged one by one; an empty table gives no rows;
* other columns of the input are carried by :func:`keep_good` and ignored by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.rows_out import without
from cardloom.llm.scratch import stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Hosts lose their documents above this shrunk share of failures.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def word_list(text: F.Column) -> F.Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def sorted_windows(hashes: F.Column) -> F.Column:
    """(hash, place) of all windows in order of the hash, or nothing where no hash occurs twice."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.slice(pairs, 1, 0))


def repeated_words(words: F.Column, pairs: F.Column) -> F.Column:
    """Words that lie in windows found twice or more.  Both arguments must be plain columns: the lambdas look into them."""
    window = lambda i: F.slice(words, i + 1, WINDOW)

    def twin(p, k):
        q = F.get(pairs, k)
        return F.coalesce((p["h"] == q["h"]) & (window(p["i"]) == window(q["i"])), F.lit(False))

    places = F.transform(pairs, lambda p, k: F.when(twin(p, k - 1) | twin(p, k + 1), p["i"]))
    start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))

    def add(s, i):
        return F.struct((s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum"), i.alias("last"))

    found = F.array_sort(F.filter(places, lambda i: i.isNotNull()))
    return F.aggregate(found, start, add, lambda s: s["sum"]).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, host``, a hash of the text, and the counts that the rules use."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    words = base.withColumn("words", word_list(F.col("text")))
    # each array that a lambda looks into is a column of its own and is used twice, so that it isn't folded into the lambda
    coded = words.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.when(F.size("codes") >= WINDOW, F.sequence(F.lit(1), F.size("codes") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    hashed = coded.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("codes"), i, WINDOW))))
    windows = hashed.withColumn("pairs", sorted_windows(F.col("hashes")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return windows.withColumn("lines", lines).select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("pairs")).alias("n_repeat_words"),
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight of the beta prior from ``hosts`` (host, n, failed), by moments; one row reaches the driver."""
    total = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("failed").alias("f"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n").cast("double")).alias("q"),
    ).first()
    if not total["n"]:
        return 0.0, MOST_WEIGHT
    n, mean = float(total["n"]), total["f"] / total["n"]
    spread = total["q"] / n - mean * mean  # variance of the hosts' rates, weighted by documents
    noise = mean * (1 - mean) * total["hosts"] / n  # what sampling alone would give
    if spread <= noise:
        return mean, MOST_WEIGHT
    return mean, min(MOST_WEIGHT, max(LEAST_WEIGHT, mean * (1 - mean) / (spread - noise) - 1))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdict of each document: the columns of :func:`measure`, ``base_failed, kept``."""
    measured = stage(measure(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()), "measured")
    hosts = stage(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    mean, weight = fit_prior(hosts)
    rate = (F.col("failed") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
    verdicts = hosts.select("host", (rate <= limit).alias("host_ok"))
    return measured.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_ok")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Rows of ``docs`` that pass, with their columns.

    The ids that are rejected are joined with the texts; a row passes or goes with the rows of its id, host and text, which
    have the same verdict.
    """
    verdict = judge(docs, id_col, text_col, host_col, limit)
    gone = stage(verdict.where("NOT kept").select(F.col("doc_id").alias("gone_id"), "host", "text_hash").distinct(), "rejected")

    def same(g):
        host, text = F.coalesce(docs[host_col].cast("string"), F.lit("")), F.coalesce(docs[text_col], F.lit(""))
        return docs[id_col].eqNullSafe(g["gone_id"]) & (host == g["host"]) & (F.xxhash64(text) == g["text_hash"])

    return without(docs, id_col, gone, same)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every row of ``documents``; hosts are the values of ``source``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), dup AS (
  SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8) AS step
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, sum(least(8, step))::BIGINT AS n_repeat_words FROM dup GROUP BY rid
), m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM b GROUP BY host
), p AS (
  SELECT mean, CASE WHEN spread <= noise THEN 1e6 ELSE least(1e6, greatest(1.0, mean * (1 - mean) / (spread - noise) - 1)) END AS weight
  FROM (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS spread,
    (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS noise FROM h)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (f + weight * mean) / (n + weight) <= 0.5 AS kept
FROM b JOIN h USING (host) CROSS JOIN p
"""
