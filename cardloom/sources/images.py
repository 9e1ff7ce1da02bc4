"""Decoded images and their variants: Spark reads and decodes, numpy works on one image at a time inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import imaging
from cardloom.functions.text import quality_score
from cardloom.operators.lineage import kept
from cardloom.sources.files import only_images

VARIANT = "path string, label string, height int, width int, data binary"


def decode(spark: SparkSession, root: str) -> DataFrame:
    """``path, height, width, channels, data, orientation`` of the images below ``root``; a file that can't be decoded has no row.

    The JVM decodes the pixels; the orientation tag, which it leaves alone, is read from the files' bytes.
    """
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")
    pixels = only_images(image.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data"))
    files = only_images(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)).select(F.col("path"), "content")

    def tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "orientation": [imaging.exif_orientation(bytes(c)) for c in batch["content"]]})

    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    tag = files.mapInPandas(tags, "path string, orientation int").where("orientation > 1")
    turned = pixels.join(tag.withColumn("tagged", plain("path")).drop("path"), plain("path") == F.col("tagged"), "left")
    return turned.drop("tagged").withColumn("orientation", F.coalesce("orientation", F.lit(1)))


def variants(images: DataFrame, make: Callable[[np.ndarray], list[tuple[str, np.ndarray]]] = imaging.variants) -> DataFrame:
    """``path, label, height, width, data``: grey variants of the images of :func:`decode`, upright."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows = [(r.path, label, *x.shape, x.tobytes()) for label, x in make(imaging.grey(imaging.upright(pixels, r.orientation)))]
                yield pd.DataFrame(rows, columns=["path", "label", "height", "width", "data"])

    return images.select("path", "height", "width", "channels", "data", "orientation").mapInPandas(run, VARIANT)


def recognise(rows: DataFrame, read: Callable[[np.ndarray, int], str], modes: tuple[int, ...] = (6, 11, 3)) -> DataFrame:
    """``path, label, psm, text`` of an OCR function for each variant and mode; one that fails gives no row for that mode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                for mode in modes:
                    try:
                        out.append((r.path, r.label, mode, read(image, mode)))
                    except Exception:  # noqa: BLE001 - whatever the hook raises costs this reading only
                        continue
            yield pd.DataFrame(out, columns=["path", "label", "psm", "text"])

    return rows.mapInPandas(run, "path string, label string, psm int, text string")


def texts_of_folder(spark: SparkSession, root: str, read: Callable[[np.ndarray, int], str], modes: tuple[int, ...] = (6, 11, 3), least: int = 50) -> DataFrame:
    """``doc_id, path, label, psm, text`` of the images below ``root``; both names are the path below it.

    All variants are read first; images whose best score is below ``least`` are decoded once more and read in the variants of the second pass, whose texts come on top.  An image
    without any text has one row, with the empty text.  Readings are kept before they are judged, so each image is read once in each pass.
    """
    top = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    named = lambda rows: rows.withColumn("path", F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), top, -1)).select(F.col("path").alias("doc_id"), "path", "label", "psm", "text")
    images = decode(spark, root)
    first = kept(recognise(variants(images), read, modes))
    scored = first.withColumn("score", quality_score(F.coalesce("text", F.lit("")))).groupBy("path").agg(F.max("score").alias("score"))
    all_ = images.select("path").join(scored, "path", "left")
    low = all_.where(F.coalesce("score", F.lit(0)) < least).select("path")
    second = kept(recognise(variants(images.join(low, "path", "left_semi"), imaging.variants_again), read, modes))
    none = images.select("path").join(first.unionByName(second).select("path").distinct(), "path", "left_anti")
    empty = none.select("path", F.lit("raw_gray").alias("label"), F.lit(modes[0]).alias("psm"), F.lit("").alias("text"))
    return named(first.unionByName(second).unionByName(empty))
