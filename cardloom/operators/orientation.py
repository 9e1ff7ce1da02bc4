"""Decisions on turned and slanted images, from scores and angles; each is a Column or a partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.operators import selection

# Angles in degrees from which a pass counts (card outline, blobs, lines, projection), and the least total.
OUTLINE, BLOBS, LINES, PROJECTION, LEAST = 10.0, 0.5, 0.8, 20.0, 0.5
# Share of the old score that a straightened image must keep, and how much better an image turned by 180 degrees must be.
KEEP, UPSIDE_DOWN = 0.75, 1.2
# Labels of the second pass, and modes.
SECOND_CONFIGS, SECOND_KINDS, MODES = ("fb15", "fb20", "fb10"), ("", "_hi", "_otsu", "_eq"), (6, 11, 3)


def skew(outline: Column, blobs: Column, lines: Column, projection: Column, skip_projection: Column | bool = False) -> Column:
    """Angle to correct from the four estimates (null where one has none): a large outline angle or else the blobs', then the lines' on
    top, then the projection's where little was found; zero below half a degree."""
    size = lambda x, least, strict=False: F.coalesce((F.abs(x) > least) if strict else (F.abs(x) >= least), F.lit(False))
    first = F.when(size(outline, OUTLINE, True), outline).when(size(blobs, BLOBS), blobs).otherwise(0.0)
    second = first + F.when(size(lines, LINES), lines).otherwise(0.0)
    skip = F.lit(skip_projection) if isinstance(skip_projection, bool) else skip_projection
    third = second + F.when(~skip & (F.abs(second) < 10.0) & size(projection, PROJECTION, True), projection).otherwise(0.0)
    return F.when(F.abs(third) < LEAST, 0.0).otherwise(third)


def keep_straightened(angle: Column, before: Column, after: Column) -> Column:
    """Is the straightened image taken?  Not if its score falls below a share of the old one."""
    return (F.abs(angle) < LEAST) | ~((before > 0) & (after < before * KEEP))


def upside_down(score: Column, turned: Column) -> Column:
    """Is the image turned by 180 degrees better by the margin?"""
    return F.when(turned > score * UPSIDE_DOWN, "rotated_180").otherwise("upright")


def quick_score(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Best score over the modes; one that is missing counts as zero."""
    return rows.groupBy(*keys).agg(F.max(F.coalesce(score, F.lit(0))).alias(score))


def median_angle(rows: DataFrame, key: str, angle: str, least: int) -> DataFrame:
    """Median of a key's angles if it has enough of them."""
    return selection.exact_median(rows, key, angle, least).select(key, F.col("median").alias(angle))


def dominant_angle(rows: DataFrame, key: str, angle: str, bins: int = 36) -> DataFrame:
    """Middle of the fullest of the bins over -90 to 90 degrees, the first of equal ones; 90 belongs to the last."""
    width = 180.0 / bins
    number = F.least(F.floor((F.col(angle) + 90.0) / width), F.lit(bins - 1))
    counts = rows.where(F.col(angle).between(-90.0, 90.0)).groupBy(key, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin")).select(key, ((F.col("bin") + 0.5) * width - 90.0).alias(angle))


def second_pass(low: DataFrame) -> DataFrame:
    """Each row of ``low`` with ``label, psm`` of the 36 readings of the second pass."""
    labels = [f"sh_{c}{k}" for c in SECOND_CONFIGS for k in SECOND_KINDS]
    return low.withColumn("label", F.explode(F.split(F.lit(" ".join(labels)), " "))).withColumn("psm", F.explode(F.array(*map(F.lit, MODES))))
