"""What the queries on cards do for each row: shared values are computed once, small tables are dealt out, one shuffle is enough."""

from pyspark.sql import functions as F

from cardloom.functions import addresses as ax
from cardloom.functions import family
from cardloom.functions import fields as fx
from cardloom.functions import names as nx
from cardloom.functions import text as tx
from cardloom.operators import vote
from cardloom.plans import queries
from cardloom.plans.sql_surface import expression_sql


def times(function, part="text"):
    return expression_sql(function(F.col("text"))).count(part)


def test_a_name_and_a_city_are_read_once(spark):
    assert times(lambda t: nx.plausible(tx.clean_name(t))) == 1
    assert times(tx.normalize_city) == 1
    assert times(fx.nik) <= 3


def test_lines_of_a_licence_are_cut_once(spark):
    assert times(nx.name_on_licence, "split(text") == 1
    assert times(ax.licence_address_below_gender, "split(text") == 1
    assert times(fx.licence_number, "split(text") == 1


def test_ways_to_the_head_are_gone_once(spark):
    assert times(family.family_head, "split(text") <= 5
    plan = queries.family_heads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Direnfaturaban") == 1


def test_confidence_shuffles_once(spark):
    rows = spark.createDataFrame([(1, "A", ""), (1, "a ", "x"), (1, "b", None), (None, "q", "q")], "d int, f string, g string")
    out = vote.confidence(rows, "d", ["f", "g"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "f", 66.7), (1, "g", 33.3), (None, "f", 0.0), (None, "g", 0.0)}


def test_cities_are_dealt_over_all_cores(spark):
    assert queries.normalize_cities(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_city_endings_and_blanks(spark):
    inputs = ["xyzrta", "  Bekasi　", "SHEKASI", "asi", "", "Paris"]
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", tx.normalize_city(F.col("x")).alias("y")).collect()
    assert [r.y for r in sorted(rows)] == ["XYZRTA", "BEKASI", "BEKASI", "ASI", "", "PARIS"]
