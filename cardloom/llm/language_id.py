"""Operator 11, language of a text by string kernels: which runs of one to three letters two texts share.

The blended-spectrum presence kernel of two texts is the number of n-grams, ``n`` from 1 to 3, that both have, divided by the root of the product of their own numbers.
Letters count in lower case, whatever lies between them is one blank.

1. Sample: of each language up to ``EACH`` labelled texts by the hash of their id, and of each a few pieces of some words, so that short texts are learned as well.
   Texts are read where they lie; what comes to the driver is bounded by the parameters below, however many and long the texts are.
2. Landmarks: ``LANDMARKS`` texts of the sample, whole.  The n-grams that two or more of them have, ``VOCABULARY`` of the most frequent at most, are what is compared.
3. Nyström: with ``K`` the kernel between landmarks, a text is the vector of its kernels with the landmarks times ``K ** -1/2``.
4. Kernel ridge regression, one versus the rest: targets are 1 for a text's language and -1 for the others, each language weighs the same.
5. Scoring: kernels are products of presence vectors, so the landmarks, ``K ** -1/2`` and the regression fold into one matrix (n-grams by languages), and a batch of texts is
   one product of its presence matrix with it.

Texts aren't shuffled; a task holds one text and ``BATCH`` presence vectors.  The model is broadcast: its size is bounded by ``VOCABULARY`` times ``LANGUAGES``.

Defined results
* a null text, or one without a letter, is ``und`` with score 0; so are all texts where nothing was labelled;
* a text with letters but without an n-gram of the vocabulary gets the language that has most labelled texts, score 0; equal scores go to the language first by name;
* a null id is not held out; rows that repeat an id, or a whole row, are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.scratch import forget, stage

LONGEST = 3
#: Labelled texts of each language that are learned from, landmarks in all, and words of the pieces that are learned besides.
EACH, LANDMARKS, PIECES = 400, 256, (2, 6, 20)
#: Languages and n-grams at most; the most frequent ones are taken.
LANGUAGES, VOCABULARY = 512, 1 << 15
#: Weight of the ridge, and share of the largest eigenvalue below which a direction of the landmarks is left out.
RIDGE, LEAST_EIGENVALUE = 1e-2, 1e-6
#: Texts that are scored by one product.
BATCH = 32
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or the blank if it is none."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


def spelled(text: str | None) -> np.ndarray:
    """Letters of a text with one blank between words and at both ends; empty where it has none."""
    own = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    own = np.concatenate([[32], own, [32]])
    own = own[np.append(True, (own[1:] != 32) | (own[:-1] != 32))]
    return own if len(own) > 1 else own[:0]


def grams(own: np.ndarray) -> np.ndarray:
    """All n-grams of spelled letters, repeats included and without the lone blank: code points, 21 bits each, beside one another."""
    out, last = [own[own != 32]], own
    for n in range(2, LONGEST + 1):
        last = last[:-1] << 21 | own[n - 1 :]
        out.append(last)
    return np.concatenate(out)


class Places:
    """Places of n-grams in a sorted vocabulary, by open addressing in a table that is at most an eighth full."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.at[slot[first]] = keys[left[first]], left[first]
            stay = np.delete(np.arange(len(left)), first)
            left, slot = left[stay], slot[stay]
            taken = self.at[slot] >= 0
            slot = np.where(taken, (slot + 1) & ((1 << self.bits) - 1), slot)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of those of ``keys`` that are in the vocabulary, repeats included."""
        slot, found = self._slots(keys), []
        while len(keys):
            own, at = self.keys[slot], self.at[slot]
            found.append(at[own == keys])
            go_on = (own != keys) & (at >= 0)
            keys, slot = keys[go_on], (slot[go_on] + 1) & ((1 << self.bits) - 1)
        return np.concatenate(found) if found else np.zeros(0, np.int32)


def presence(texts: list[np.ndarray], places: Places) -> tuple[np.ndarray, np.ndarray]:
    """(texts, n-grams) of ones and zeros, each row over the root of its number of ones, and these numbers."""
    out = np.zeros((len(texts), places.size))
    for row, own in zip(out, texts):
        row[places.find(grams(own))] = 1
    n = out.sum(1)
    return out / np.sqrt(np.maximum(n, 1))[:, None], n


def whitening(kernel: np.ndarray) -> np.ndarray:
    """``kernel ** -1/2`` on the directions that have weight."""
    values, vectors = np.linalg.eigh(kernel)
    own = values > LEAST_EIGENVALUE * values[-1]
    return vectors[:, own] / np.sqrt(values[own])


def ridge(rows: np.ndarray, language: np.ndarray, languages: int) -> np.ndarray:
    """Weights (features, languages) of the regressions of each language against the rest."""
    weight = 1 / np.bincount(language, minlength=languages)[language]
    weight *= len(rows) / weight.sum()
    target = np.where(language[:, None] == np.arange(languages), 1.0, -1.0)
    own = rows * weight[:, None]
    return np.linalg.solve(own.T @ rows + RIDGE * len(rows) * np.eye(rows.shape[1]) / languages, own.T @ target)


@dataclass
class Model:
    languages: list[str]
    #: The language that has most labelled texts.
    usual: int
    #: N-grams, and their weight for each language.
    vocabulary: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str | None], places: Places) -> tuple[list[str], list[float]]:
        own = [spelled(t) for t in texts]
        rows, n = presence(own, places)
        margins = rows @ self.weights
        best = np.where(n > 0, margins.argmax(1) if self.languages else 0, self.usual)
        score = np.where(n > 0, np.clip((margins.max(1, initial=-1) + 1) / 2, 0, 1), 0.0)
        told = [bool(self.languages) and len(x) > 0 for x in own]
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best, told)], [float(s) if t else 0.0 for s, t in zip(score, told)]


def pieces(text: str, seed: int) -> list[str]:
    """Stretches of ``PIECES`` words, each from a place that the seed tells."""
    words = text.split()
    at = [seed * (k + 1) % max(1, len(words) - n + 1) for k, n in enumerate(PIECES)]
    return [" ".join(words[a : a + n]) for a, n in zip(at, PIECES) if n < len(words)]


def sample(rows: DataFrame, counts: dict[str, int], each: int) -> DataFrame:
    """``lang, k, text``: ``each`` rows of every language, numbered by the hash of their id."""
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * each / n) * (1 << 40)))])
    hashed = rows.withColumn("h", F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(7)))
    few = hashed.where(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")])  # about 2 * each of a language
    by_hash = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    return few.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= each).select("lang", "k", "text")


def frequent_grams(texts: DataFrame, most: int) -> np.ndarray:
    """N-grams that two or more of ``texts`` have, sorted; the most frequent ones where there are more than ``most``."""

    def run(batches):
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(np.unique(grams(spelled(text.as_py()))))})

    counts = texts.select("text").mapInArrow(run, "gram bigint").groupBy("gram").count().where("count > 1")
    return np.sort(counts.orderBy(F.desc("count"), "gram").limit(most).toPandas()["gram"].to_numpy(np.int64))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", each: int = EACH, landmarks: int = LANDMARKS) -> Model:
    """Model from the labelled rows of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], 0, np.zeros(0, np.int64), np.zeros((0, 0)))
    chosen = stage(sample(rows, counts, each), "language-sample")
    marks = chosen.where(F.col("k") <= max(2, landmarks // len(languages)))
    vocabulary = frequent_grams(marks, VOCABULARY)

    def present(batches):
        places = Places(vocabulary)
        for batch in batches:
            for text in batch.column("text"):
                found = np.unique(places.find(grams(spelled(text.as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.int32()))], ["found"])

    # whole landmarks as numbers of the vocabulary
    found = [r["found"] for r in marks.mapInArrow(present, "found array<int>").toLocalIterator()]
    base = np.zeros((len(found), len(vocabulary)))
    for row, own in zip(base, found):
        row[own] = 1
    base = base[base.any(1)]
    base = np.unique(base / np.sqrt(base.sum(1, keepdims=True)), axis=0)
    folded = base.T @ whitening(base @ base.T) if len(base) else np.zeros((len(vocabulary), 0))
    held = spark.sparkContext.broadcast((vocabulary, folded))

    def features(batches):
        vocabulary, folded = held.value
        places = Places(vocabulary)
        for batch in batches:
            for lang, k, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "k", "text"))):
                own = [x for x in map(spelled, [text, *pieces(text, k * 7919)]) if len(x)]
                rows, n = presence(own, places)
                out = [*(rows @ folded)[n > 0]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.list_(pa.float64()))], ["lang", "row"])

    # at most LANGUAGES * EACH * (1 + pieces) rows of LANDMARKS numbers
    learned = sorted((r["lang"], r["row"]) for r in chosen.mapInArrow(features, "lang string, row array<double>").toLocalIterator())
    forget(chosen)
    number = {lang: i for i, lang in enumerate(languages)}
    weights = np.zeros((len(vocabulary), len(languages)))
    if learned:
        seen = np.array([number[lang] for lang, _ in learned])
        weights = folded @ ridge(np.array([row for _, row in learned]), seen, len(languages))
    return Model(languages, number[max(counts, key=lambda x: (counts[x], x))], vocabulary, weights)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        places = Places(own.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lang, score = own.predict(part.column("text").to_pylist(), places)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: the checksum of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
