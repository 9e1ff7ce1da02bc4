"""Connected components of an edge table by alternating star contractions.

Each round points all larger neighbours of a node to its smallest neighbour (large star), then does the same to the smaller
ones (small star), until the table stands still; a few rounds suffice for the stars and short paths that near-duplicate groups
are.  The minimum of a node's neighbours is a partial aggregation, so a node with millions of neighbours is no hot group, and
its edges meet the minimum in a join that may be split by skew.  Every round is written to the shared folder; the driver sees two numbers
of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cardloom.llm.rows_out import without
from cardloom.llm.scratch import forget, stage


def _table(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """``edges`` as a table, and two numbers that tell whether it has changed; they are taken as it is written."""
    seen = Observation()
    sums = F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("hash")
    table = stage(edges.observe(seen, F.count(F.lit(1)).alias("rows"), sums), name)
    return table, (seen.get["rows"], seen.get["hash"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a``, ``b``, any order); the root is the smallest node reachable.

    A root has no row of its own unless an edge joins it with itself; nodes without edges have none either.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    ordered, before = _table(ordered, "edges")
    while before[0]:
        both = ordered.union(ordered.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        forget(ordered)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        ordered, now = _table(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        forget(large)
        if now == before:
            break
        before = now
    return ordered.select(F.col("a").alias("node"), F.col("b").alias("root"))


def text_hash(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that come first in their group, with their columns.

    ``groups`` has ``doc_id, text_hash, root`` of each row.  The smallest id is first, null ids last, and of texts that share it the smaller
    hash; a row is dropped by its id and its text, so no other row of its id goes with it.
    """
    groups = stage(groups.select("doc_id", "text_hash", "root"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    firsts = groups.groupBy("root").agg(F.min(place).alias("first"))
    later = groups.join(firsts.hint("merge"), "root").where(~place.eqNullSafe(F.col("first")))
    gone = stage(later.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct(), "near-copies")
    same = lambda g: docs[id_col].eqNullSafe(g["gone_id"]) & (text_hash(docs[text_col]) == g["gone_text"])
    return without(docs, id_col, gone, same)
