"""Ids of units by the short way against the library itself."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from cardloom.llm import best_fit, scratch, unit_cache
from cardloom.llm.unit_cache import UnitIds


def test_ids_are_the_librarys_and_known_words_are_not_asked_again():
    own = UnitIds(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(1)
    letters = "abcXYZÀÖßéÿñ.,;:!?#$%&*|'-_\n\t 0123́ 漢ﬁİ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    want = list(own._library(texts))
    assert own.encode_batch(texts) == want
    assert own.encode_batch(texts) == want
    asked = []
    library = own._library
    own._library = lambda units: asked.extend(units) or library(units)
    own.encode_batch(["Grüße### neueswort, another$$$"])
    assert set(asked) <= {"", "###", ",", "$$$"}


def test_simple_units_are_looked_up_as_they_are_met():
    own = UnitIds(public_tokenizers.path("word_bpe_49k.json"))
    later, learn = [], own._learn
    own._learn = lambda units: later.extend(units) or learn(units)
    texts = ["The THE the, qzxj Qzxj. Grüße###\nÉté the", "a b. c", None, "x-1 the newword"]
    assert own.encode_batch(texts) == [b"" if t is None else x for t, x in zip(texts, own._library([t or "" for t in texts]), strict=True)]
    assert later and "x-1" in later and not {"The", "the,", "qzxj", "Qzxj.", "Grüße###", "Été", "b."} & set(later)
    assert {"qzxj", "grüße", "été"} <= set(own.words) and own.known["Qzxj."] == next(iter(own._library(["Qzxj."])))


def test_tables_may_be_smaller_than_those_of_other_queries():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = unit_cache.unit_ids(path, 2000)
    draw = random.Random(3)
    for _ in range(30):
        texts = ["".join(draw.choice("abcdeé") for _ in range(6)) + draw.choice(["", ",", "-x"]) for _ in range(20)]
        assert own.encode_batch(texts) == list(own._library(texts))
        assert own.known.taken < 2000 + 20 * 230 and own.words.taken < 2000 + 20 * 230
    assert unit_cache.unit_ids(path) is own and own.most is None


def test_arrow_batches_of_texts_are_small_and_the_setting_returns(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = spark.range(0, 5000, 1, 1)
    with scratch.arrow_rows(spark, 1000):
        assert {r.n for r in rows.mapInArrow(sizes, "n long").collect()} == {1000}
    with pytest.raises(ZeroDivisionError), scratch.arrow_rows(spark, 1000):
        1 / 0
    assert spark.conf.get(name) == before
    asked = []
    own, spy = best_fit.arrow_rows, lambda s, n: asked.append(n) or own(s, n)
    best_fit.arrow_rows = spy
    try:
        assert best_fit.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), known=1000).count() == 1
    finally:
        best_fit.arrow_rows = own
    assert asked == [best_fit.TEXTS]
