import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import language_id as li


def plain_grams(text):
    """N-grams of a text as strings."""
    own = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    own = " " + " ".join(own.split()) + " "
    return {own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1)} - {" "} if own.strip() else set()


TEXTS = ["The cat, the CAT 12 sat.", "Ünïcode — ıİ 漢字かな 漢字", "a", "", None, "12 !", "ab" * 500, "Das  ist\nein Satz \x85 und noch einer"]


def test_kernel_is_the_number_of_shared_ngrams():
    vocabulary = np.unique(np.concatenate([li.grams(li.spelled(t)) for t in TEXTS]))
    assert len(vocabulary) == len(set().union(*map(plain_grams, TEXTS)))
    rows, n = li.presence([li.spelled(t) for t in TEXTS], li.Places(vocabulary))
    own = [plain_grams(t) for t in TEXTS]
    assert n.tolist() == [len(x) for x in own]
    for (i, a), (j, b) in itertools.product(enumerate(own), repeat=2):
        want = len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0
        assert rows[i] @ rows[j] == pytest.approx(want)


def test_places_are_those_of_a_dictionary():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20000))
    asked = np.concatenate([rng.choice(keys, 500), rng.integers(0, 1 << 63, 500), keys[:5] + 1])
    at = {int(k): i for i, k in enumerate(keys)}
    assert sorted(li.Places(keys).find(asked).tolist()) == sorted(at[int(a)] for a in asked if int(a) in at)
    assert li.Places(keys[:0]).find(asked).size == 0


def test_scores_are_those_of_nystroem_and_ridge_step_by_step():
    rng = np.random.default_rng(2)
    base = rng.random((20, 60)) < 0.3
    base = base / np.sqrt(base.sum(1, keepdims=True))
    rows, seen = (rng.random((50, 60)) < 0.3).astype(float), rng.integers(0, 3, 50)
    white = li.whitening(base @ base.T)
    phi = (rows @ base.T) @ white
    # the features' inner products are the kernel on the landmarks
    marks = (base @ base.T) @ white
    assert np.allclose(marks @ marks.T, base @ base.T)
    weights = li.ridge(phi, seen, 3)
    for language in range(3):
        y, w = np.where(seen == language, 1.0, -1.0), 1 / np.bincount(seen)[seen]
        w *= 50 / w.sum()
        gradient = phi.T @ (w * (phi @ weights[:, language] - y)) + li.RIDGE * 50 / 3 * weights[:, language]
        assert np.allclose(gradient, 0)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, li.fit(docs.where(~li.held_out(F.col("doc_id"))), each=60, landmarks=80)


def test_held_out_texts_are_told(spark, learned):
    docs, model = learned
    told = li.predict(docs, model).join(docs, "doc_id").where(li.held_out(F.col("doc_id")))
    right, n = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right >= 0.98 * n
    assert told.where("score NOT BETWEEN 0.5 AND 1").count() < 0.05 * n


def test_short_texts_are_told(spark, learned):
    docs, model = learned
    short = docs.where(li.held_out(F.col("doc_id")) & (F.length("text") > 400)).withColumn("text", F.array_join(F.slice(F.split("text", r"\s+"), 3, 12), " "))
    told = li.predict(short, model).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.95 * n


def test_nothing_but_the_text_tells(spark, learned):
    docs, model = learned
    some = docs.limit(40)
    turned = some.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(some, model).collect()}
    for r in li.predict(turned, model).collect():
        assert (r["lang_pred"], round(r["score"], 9)) == (by_id[-r["doc_id"]][0], round(by_id[-r["doc_id"]][1], 9))


def test_odd_tables(spark):
    rng = random.Random(3)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30))
    rows = [(i, say("abc") if i % 2 else say("漢字語"), "x" if i % 2 else "y") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "12 34", "y"), (103, "ωψ", None), (None, say("abc"), None), (7, say("abc"), "x"), (7, say("abc"), "x"), (104, "ab " * 200000, None), (105, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("clash"), "k": F.lit(1), "h": F.lit(2)}).repartition(3)
    model = li.fit(docs)
    assert model.languages == ["x", "y"]
    got = li.predict(docs, model).collect()
    assert len(got) == len(rows)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert told[100] == told[101] == told[102] == ("und", 0.0)
    assert told[103] == ("x", 0.0) and told[None][0] == told[104][0] == told[105][0] == "x"
    assert all(told[i][0] == ("x" if i % 2 else "y") for i in range(40))
    assert {r["doc_id"]: r["h"] for r in docs.select("doc_id", li.held_out(F.col("doc_id")).alias("h")).collect()}[None] is False
    # nothing to learn from, one language, no row
    none = li.fit(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in li.predict(docs, none).collect()} == {"und"}
    one = li.fit(docs.where("lang = 'y'"))
    assert {r["lang_pred"] for r in li.predict(docs, one).collect()} == {"y", "und"}
    assert li.predict(docs.limit(0), model).count() == 0
