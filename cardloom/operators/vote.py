"""Decisions between the text variants of a document.

Counts are partial aggregations on (document, value), then one ``max_by`` per document, so no list of variants is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import strip


def vote(rows: DataFrame, key: str, value: str, order: str, ties: list[Column] | None = None) -> DataFrame:
    """``key, value, n_votes``: the most frequent non-empty value, then the largest of ``ties``, then the one that came first.

    A key without a non-empty value has no row.
    """
    counts = rows.where(F.col(value) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = F.struct("n", *[t.alias(f"t{i}") for i, t in enumerate(ties or [])], (-F.col("first")).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, rank).alias(value), F.max("n").alias("n_votes"))


def vote_name(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Ties go to the name with most words, then the longest."""
    return vote(rows, key, value, order, [F.size(F.split(value, "_", -1)), F.length(value)])


def vote_address(rows: DataFrame, key: str, value: str, order: str, keyword: str = r"(?i)\b(JL|JALAN|KP|GG|BLOK|PERUM)\b") -> DataFrame:
    """Where a document has addresses with a keyword only these count; ties go to the shortest."""
    has = F.col(value).rlike(keyword)
    known = rows.where(has).select(key).distinct()
    pool = rows.where(has).unionByName(rows.join(known, key, "left_anti"))
    return vote(pool, key, value, order, [-F.length(value)])


def best_variant(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row with the greatest tuple of ``order`` for each key."""
    return rows.groupBy(key).agg(F.max(F.struct(*order)).alias("best")).select(key, "best.*")


def rank_variants(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows with ``rank`` from 1, best first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order))))


def confidence(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, confidence``: share in percent of a key's variants that agree on the most frequent value of a field."""
    # one shuffle, of a row for each variant; all counts keep its partitioning
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = rows.select(key, *fields).repartition(parts, key).select(key, F.inline(pairs)).withColumn("value", strip(F.lower("value")))
    counts = long.groupBy(key, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    # rows without a key agree with none
    agree = F.max(F.when((F.col("value") != "") & F.col(key).isNotNull(), F.col("n")))
    share = F.bround(F.coalesce(agree, F.lit(0)) / F.sum("n") * 100, 1)
    return counts.groupBy(key, "field").agg(share.alias("confidence"))


def pick_orientation(rows: DataFrame, key: str) -> DataFrame:
    """``key, angle`` of rows (key, angle, score): the best angle, the smaller of equal ones, if it beats angle 0 by the margin: 1.15 for 180 degrees, else 1.30."""
    best = rows.groupBy(key).agg(
        F.max_by(F.struct("angle", "score"), F.struct("score", -F.col("angle"))).alias("b"),
        F.max(F.when(F.col("angle") == 0, F.col("score"))).alias("upright"),
    )
    margin = F.when(F.col("b.angle") == 180, 1.15).otherwise(1.30)
    return best.select(key, F.when((F.col("b.angle") != 0) & (F.col("b.score") > F.col("upright") * margin), F.col("b.angle")).otherwise(0).alias("angle"))
