"""The library from SQL, large lexicons, exact medians, figures in one pass."""

import math
import random
import re
import statistics

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cardloom.operators import evaluate, lexicon_join, selection
from cardloom.plans import cards, demo, sql_surface
from cardloom.sources import sinks


@pytest.fixture(scope="module")
def texts(spark):
    rows = demo.demo_texts(spark).select("text").union(cards.cards(spark, "/root/testdata/sf0.001").where("doc_id < 12 AND variant = 0").select("text"))
    rows = rows.union(spark.createDataFrame([(None,), ("",), ("'quoted' \\ and\n\"more\" É ß",)], "text string"))
    return rows.withColumn("n", F.monotonically_increasing_id()).persist()


def test_sql_functions_are_the_column_functions(spark, texts):
    names = sql_surface.register(spark)
    assert len(names) == len(set(names)) and "card_votes" in names
    for some in (list(sql_surface.OF_TEXT.items())[k : k + 6] for k in range(0, len(sql_surface.OF_TEXT), 6)):
        from_sql = spark.sql("SELECT n, " + ", ".join(f"{n}(text) AS {n}" for n, _ in some) + " FROM {t}", t=texts)
        plain = texts.select("n", *[f(F.col("text")).alias(n) for n, f in some])
        assert from_sql.orderBy("n").collect() == plain.orderBy("n").collect()
    assert spark.sql("SELECT naming_issues('Sim a.jpg', 'ktp') AS x").first()["x"] == ["pattern", "prefix", "upper case", "blank"]
    # inlined: no Python in the plan
    assert "Python" not in spark.sql("SELECT nik(text) FROM {t}", t=texts)._jdf.queryExecution().toString()


def test_card_votes_in_sql(spark):
    sql_surface.register(spark)
    rows = [(1, "a", "x", 2, 5), (1, "a", "y", 2, 3), (1, "a", "", 9, 1), (1, "b", None, 9, 1), (1, "b", "z", 1, 1), (2, "a", "p", 1, 2), (2, "a", "q", 1, 2), (2, "a", "p", 1, 9), (None, "a", "n", 1, 1), (3, "a", "", 1, 1)]
    counts = spark.createDataFrame(rows, "doc_id bigint, field string, value string, n bigint, first bigint").withColumn("votes", F.lit("clash")).repartition(4)
    got = spark.sql("SELECT v.* FROM card_votes(TABLE({c}) PARTITION BY doc_id) AS v", c=counts)
    assert got.dtypes[0] == ("doc_id", "bigint")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", "y", 2), (1, "b", "z", 1), (2, "a", "p", 2), (None, "a", "n", 1)], key=repr)
    with pytest.raises(AnalysisException, match="card_votes takes"):
        spark.sql("SELECT * FROM card_votes(TABLE({c}))", c=counts.drop("first"))


def test_words_against_a_lexicon(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(lexicon_join, "BITS", 1 << 15)  # so that some words share a bit
    lexicon = [f"w{i}" for i in range(0, 20000, 3)] + ["w0", None]
    # one word has a third of all rows, in the lexicon or not
    words = ["w3"] * 3000 + ["w4"] * 3000 + [f"w{rng.randrange(30000)}" for _ in range(3000)] + [None, "", "W3"]
    rows = spark.createDataFrame(list(enumerate(words)), "bits bigint, word string").withColumns({"row": F.lit(1), "hot": F.lit("x"), "own": F.lit(0)}).repartition(5)
    entries = spark.createDataFrame([(w,) for w in lexicon], "word string")
    got = lexicon_join.marked(rows, "word", entries, "word", F.col("bits"))
    assert got.columns == [*rows.columns, "found"]
    assert {r["bits"]: r["found"] for r in got.collect()} == {i: w in set(lexicon) - {None} for i, w in enumerate(words)}
    assert got.count() == len(words)
    assert {r[0] for r in lexicon_join.frequent(rows.select("word", F.col("bits").alias("row"))).collect()} == {"w3", "w4"}
    assert lexicon_join.marked(rows, "word", entries.limit(0), "word", F.col("bits")).where("found").count() == 0
    assert lexicon_join.marked(rows.limit(0), "word", entries, "word", F.col("bits")).count() == 0


def test_plan_of_a_large_lexicon_has_no_word_list(spark):
    docs = spark.createDataFrame([(1, "The w3 w3 W6 Zz"), (2, None), (3, "")], "doc_id bigint, text string")
    got = lexicon_join.lexicon_counts(docs, "doc_id", "text", spark.createDataFrame([("w",), ("zz",)], "word string"), "word")
    assert sorted(map(tuple, got.collect())) == [(1, 5, 4), (2, 0, 0), (3, 0, 0)]


@pytest.mark.parametrize("least,sample", [(20, 64), (3, 1), (1 << 40, 1)])
def test_texts_are_cut_once_and_their_words_counted_wherever_they_are_met(spark, monkeypatch, least, sample):
    rng = random.Random(11)
    monkeypatch.setattr(lexicon_join, "BITS", 1 << 15)
    monkeypatch.setattr(lexicon_join, "LEAST", least)
    monkeypatch.setattr(lexicon_join, "SAMPLE", sample)
    spell = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    texts = [" ".join(rng.choice(["The", "OF", spell(rng.randrange(4000)), "12", "é"]) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = {r[0] for r in docs.select(F.xxhash64("doc_id").cast("string")).collect()}
    lexicon = {"the", *map(spell, range(0, 4000, 3))} | own
    got = lexicon_join.lexicon_counts(docs, "doc_id", "text", spark.createDataFrame([(w,) for w in [*lexicon, "the", None]], "w string"), "w")
    words = [re.findall("[A-Za-z]+", t or "") for t in texts]
    assert sorted(map(tuple, got.collect())) == [(i, len(w), sum(x.lower() in lexicon for x in w)) for i, w in enumerate(words)]
    # once for the counts, once for the sample
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


@pytest.mark.parametrize("buckets,small", [(4, 3), (5, 1), (1024, 4096)])
def test_medians_are_exact(spark, buckets, small):
    rng = random.Random(7)
    keys = {
        "normal": [rng.gauss(0, 1) for _ in range(60)],
        "same": [2.5] * 40,
        "few": [1.0, 5.0],
        "one": [3.25],
        "pairs": [1.0, 1.0, 2.0, 2.0],
        "far": [1e308, -1e308, 1e-300, 2e-300, 3e-300, 5e-324],
        "scales": [10.0**k for k in range(-20, 21)],
        "infinite": [-math.inf, -math.inf, 1.0, 2.0, 3.0, 4.0, math.inf],
        None: [float(x) for x in range(30)],
    }
    rows = [(k, v) for k, values in keys.items() for v in values] + [("normal", None), ("few", math.nan), ("none", None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "low string, high double").repartition(3)
    got = {r["low"]: (r["n"], r["median"]) for r in selection.exact_median(table, "low", "high", 1, buckets, small).collect()}
    assert got == {k: (len(v), statistics.median(v)) for k, v in keys.items()}


def test_medians_need_enough_values(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)], "k string, v double")
    assert [tuple(r) for r in selection.exact_median(table, "k", "v", 3).collect()] == [("a", 3, 2.0)]
    assert selection.exact_median(table.limit(0), "k", "v", 3).count() == 0


def test_figures_of_one_pass_are_those_of_many(spark):
    rows = evaluate.completeness(cards.records(spark, "/root/testdata/sf0.001")).persist()
    figures = {r["jenis_dokumen"] if not r["whole"] else None: r.asDict() for r in evaluate.batch_figures(rows).collect()}
    whole = figures.pop(None)
    for part, names in ((evaluate.batch_stats(rows), {}), (evaluate.time_figures(rows), {}), (evaluate.naming_compliance(rows), {"valid": "names_valid", "invalid": "names_invalid"}), (evaluate.progress(rows), {"valid": "done", "error": "failed"})):
        for name, value in part.first().asDict().items():
            assert whole[names.get(name, name)] == value, name
    for r in evaluate.by_type(rows).collect():
        assert (figures[r["jenis_dokumen"]]["total"], figures[r["jenis_dokumen"]]["valid"], figures[r["jenis_dokumen"]]["avg_completeness"]) == (r["n"], r["n_valid"], r["avg_completeness"])
    assert {r["jenis_dokumen"]: r["avg_ms"] for r in evaluate.time_by_type(rows).collect()} == {k: r["avg_ms"] for k, r in figures.items()}
    # one reading of the records
    assert evaluate.batch_figures(cards.records(spark, "/root/testdata/sf0.001").transform(evaluate.completeness))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sinks.metrics(rows)["batch"]["total"] == rows.count()
    assert sinks.metrics(rows.limit(0))["progress"] == {"valid": 0, "dry_run": 0, "error": 0}
