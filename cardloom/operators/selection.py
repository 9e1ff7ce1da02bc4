"""Exact medians by counting, without ever holding a group.

Each round cuts a key's range of values into ``BUCKETS`` of equal width and counts; the bucket that has the middle rank is the next round's range, with the smallest and greatest value in it
as its ends, so values that lie close together far from the rest cost rounds, not memory.  A key whose range has ``SMALL`` values or fewer, or one value only, needs no further round.
What is shuffled are counts, ``BUCKETS`` for each key and task at most; values that lie outside their key's range are left behind round by round.  Rows meet their key's range in
a join that may be split where one key has very many of them.

Defined results
* nulls and NaN are left out, infinite values count; a key with fewer than ``least`` values has no row; null is a key;
* of an even number of values the median is the mean of the two in the middle; repeated values count each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.lineage import kept

BUCKETS = 1024
#: Values of a key that are sorted in one task at most.
SMALL = 4096


def _bucket(buckets: int) -> F.Column:
    """Number of a value's bucket between ``low`` and ``high``; these two have one for themselves, so every round leaves something out, also where the range is infinite."""
    x, low, high = (F.col(c) / 2 for c in ("x", "low", "high"))  # halved, so that no difference of numbers is infinite
    share = F.nanvl(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)), F.lit(0.0))
    inner = 1 + F.least(F.floor(share * (buckets - 2)).cast("int"), F.lit(buckets - 3))
    return F.when(F.col("x") == F.col("high"), buckets - 1).when(F.col("x") == F.col("low"), 0).otherwise(inner)


def kth(rows: DataFrame, ranks: DataFrame, buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """``key, value`` of ``rows`` (``key, x``, numbers only): the value of rank ``ranks.k`` (``key, k``, from 0)."""
    same = lambda a, b: a["key"].eqNullSafe(b["key"])
    ranges = rows.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    state = kept(ranges.join(ranks, same(ranges, ranks)).select(ranges["key"], "low", "high", "n", "k"))
    found = state.where("low = high").select("key", F.col("low").alias("value"))
    while True:
        active = state.where("low < high")
        ready = active.where(F.col("n") <= small)
        inside = rows.join(ready, same(rows, ready)).where("x BETWEEN low AND high").select(rows["key"], "x", "k")
        sorted_ = inside.groupBy("key", "k").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # ``small`` at most
        found = found.unionByName(sorted_.select("key", F.get("xs", F.col("k").cast("int")).alias("value")))
        wide = active.where(F.col("n") > small)
        if wide.isEmpty():
            return found
        counted = rows.join(wide, same(rows, wide)).where("x BETWEEN low AND high").select(rows["key"], "x", "low", "high", "k").withColumn("b", _bucket(buckets))
        cells = counted.groupBy("key", "k", "b").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        # a key's cells are ``buckets`` at most: prefix sums in one array
        line = F.sort_array(F.collect_list(F.struct("b", "n", "low", "high")))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("struct<low:double,high:double,n:bigint,k:bigint>").alias("hit"))

        def add(s, c):
            here = (s["hit"].isNull()) & (F.col("k") < s["before"] + c["n"])
            hit = F.when(here, F.struct(c["low"].alias("low"), c["high"].alias("high"), c["n"].alias("n"), (F.col("k") - s["before"]).alias("k"))).otherwise(s["hit"])
            return F.struct((s["before"] + c["n"]).alias("before"), hit.alias("hit"))

        hits = cells.groupBy("key", "k").agg(line.alias("line")).select("key", F.aggregate("line", start, add, lambda s: s["hit"]).alias("hit"))
        state = kept(hits.select("key", "hit.*"))
        found = found.unionByName(state.where("low = high").select("key", F.col("low").alias("value")))


def exact_median(rows: DataFrame, key: str, value: str, least: int = 1, buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """``key, n, median`` of the keys that have ``least`` values or more."""
    own = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    sizes = kept(own.groupBy("key").agg(F.count("x").alias("n")).where(F.col("n") >= least))
    lower = kept(kth(own, sizes.select("key", F.floor((F.col("n") - 1) / 2).cast("long").alias("k")), buckets, small))
    # of an even number: the lower one again if it is repeated, else the next greater value
    met = own.join(lower, own["key"].eqNullSafe(lower["key"])).select(own["key"], "x", "value")
    ahead = met.groupBy("key").agg(F.first("value").alias("value"), F.count_if(F.col("x") <= F.col("value")).alias("upto"), F.min(F.when(F.col("x") > F.col("value"), F.col("x"))).alias("more"))
    upper = F.when(F.col("n") % 2 == 1, F.col("value")).when(F.col("upto") > F.col("n") / 2, F.col("value")).otherwise(F.col("more"))
    out = ahead.join(sizes, ahead["key"].eqNullSafe(sizes["key"])).select(ahead["key"].alias(key), "n", ((F.col("value") + upper) / 2).alias("median"))
    return out
