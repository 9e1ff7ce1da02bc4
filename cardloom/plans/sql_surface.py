"""The library from SQL: the text functions as SQL functions, and votes as a table function.

``register(spark)`` makes a temporary SQL function of each native Column function, from the expression itself: what SQL calls is the same expression tree, inlined into
the plan, no UDF.  ``card_votes`` is a Python table function: it takes counts of readings, partitioned by document, and gives each field's settled value::

    WITH readings AS (SELECT doc_id, variant, nik(text) AS nik, gender(text) AS jenis_kelamin FROM cards),
    counts AS (SELECT doc_id, field, value, count(*) AS n, min(variant) AS first FROM readings UNPIVOT (value FOR field IN (nik, jenis_kelamin)) GROUP BY ALL)
    SELECT v.* FROM (SELECT 1) AS one, LATERAL card_votes(TABLE(counts) PARTITION BY doc_id) AS v

Readings are counted in SQL before they meet the table function, so a document with very many variants is as many rows as it has different values.

Defined results
* a null argument gives what the Column function gives for null; null and empty values have no vote; a null document is a document;
* of values with equal counts the one read first wins, of those the smaller value; counts that come in parts are added up; a document without a value has no row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cardloom.functions import addresses as ax
from cardloom.functions import family
from cardloom.functions import fields as fx
from cardloom.functions import lexicon as lx
from cardloom.functions import names as nx
from cardloom.functions import text as tx
from cardloom.operators import evaluate

#: SQL name of each function of one text.
OF_TEXT: dict[str, Callable[[Column], Column]] = {
    "clean_text": tx.clean_text,
    "quality_score": tx.quality_score,
    "slugify": tx.slugify,
    "normalize_for_compare": tx.normalize_for_compare,
    "normalize_date": tx.normalize_date,
    "normalize_city": tx.normalize_city,
    "clean_name": tx.clean_name,
    "is_plausible_name": tx.is_plausible_name,
    "word_digits": tx.word_digits,
    "card_kind": fx.classify,
    "nik": fx.nik,
    "birth_place": fx.birth_place,
    "birth_date": fx.birth_date,
    "gender": fx.gender,
    "card_address": fx.address,
    "name_from_label": fx.name_from_label,
    "name_after_number": nx.name_after_number,
    "name_in_capitals": nx.name_in_capitals,
    "name_on_licence": nx.name_on_licence,
    "licence_number": fx.licence_number,
    "rt_rw": fx.rt_rw,
    "family_number": family.family_number,
    "family_head": family.family_head,
    "family_address": ax.family_address,
    **{f"header_{f}": (lambda text, f=f: fx.header_field(text, f)) for f in lx.HEADER_PATTERNS},
}
#: Operators come out of an expression as names of functions; SQL takes them between backticks.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|not|[-+*/<>=!%]+)(?=\()", re.S | re.I)


def expression_sql(column: Column) -> str:
    """``column`` as SQL text."""
    return _OPERATOR.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], column._jc.node().sql())


def _define(spark: SparkSession, name: str, arguments: list[str], body: Column) -> None:
    kind = spark.createDataFrame([], ", ".join(f"{a} string" for a in arguments)).select(body.alias("x")).schema["x"].dataType.simpleString()
    taken = ", ".join(f"{a} STRING" for a in arguments)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({taken}) RETURNS {kind} RETURN {expression_sql(body)}")


class CardVotes:
    """Settled value of each field of a document from ``doc_id, field, value, n, first``."""

    def __init__(self) -> None:
        self.doc_id, self.counts = None, {}

    @staticmethod
    def analyze(counts: AnalyzeArgument) -> AnalyzeResult:
        if not counts.isTable or {"doc_id", "field", "value", "n", "first"} - {f.name for f in counts.dataType.fields}:
            raise Exception("card_votes takes a table with doc_id, field, value, n and first")
        kind = counts.dataType["doc_id"].dataType
        return AnalyzeResult(StructType().add("doc_id", kind).add("field", StringType()).add("value", StringType()).add("votes", LongType()))

    def eval(self, row):
        self.doc_id = row["doc_id"]
        if row["value"]:
            own = self.counts.setdefault((row["field"], row["value"]), [0, row["first"]])
            own[0] += row["n"]
            own[1] = min(own[1], row["first"])

    def terminate(self):
        best: dict[str, tuple] = {}
        for (field, value), (n, first) in self.counts.items():
            best[field] = min(best.get(field, (1,)), (-n, first, value))
        for field, (n, _, value) in sorted(best.items()):
            yield self.doc_id, field, value, -n


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session; their names."""
    for name, function in OF_TEXT.items():
        _define(spark, name, ["text"], function(F.col("text")))
    _define(spark, "naming_issues", ["name", "kind"], evaluate.naming_issues(F.col("name"), F.col("kind")))
    spark.udtf.register("card_votes", udtf(CardVotes))
    return [*OF_TEXT, "naming_issues", "card_votes"]
