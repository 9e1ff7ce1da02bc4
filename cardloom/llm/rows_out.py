"""Taking rows out of a table of texts without moving the texts that stay.

The keys of the rows to drop grow with the corpus, so they are never broadcast.  What is broadcast is a bitmap of fixed size: one bit
for each hash of a key, ``2 ** 26`` bits or 8 MB whatever the corpus.  A row whose bit isn't set has no key among those to drop and
stays where it is; only the others, the rows to drop and a few that share a bit with one, meet the keys in a merge join.  With far more keys than bits
the bitmap fills up and all rows take the join; the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.scratch import stage

#: Bits of the map, in bitmaps of 4096 bytes: 2048 rows at most.
BITS = 1 << 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(keys: DataFrame) -> DataFrame:
    """``bucket, bits``: the bits of the first column of ``keys``."""
    place = _place(F.col(f"`{keys.columns[0]}`"))
    marked = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    return stage(marked.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "bitmap")


def _met(rows: DataFrame, key: Column, bits: DataFrame, wanted: bool) -> DataFrame:
    """Rows of which ``key`` has its bit set, or those of which it hasn't."""
    at = F.bitmap_bit_position(_place(key))
    byte = F.conv(F.hex(F.substring(bits["bits"], F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    # BITS / 32768 rows of 4 KB at most
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(_place(key)) == bits["bucket"], "left")
    return joined.where(is_set if wanted else ~is_set).drop(bits["bucket"], bits["bits"])


def maybe(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """All rows whose ``key`` is in the first column of ``keys``, and a few others."""
    return _met(rows, rows[key], bitmap(keys), True)


def without(rows: DataFrame, key: str, gone: DataFrame, same: Callable[[DataFrame], Column]) -> DataFrame:
    """``rows`` without those for which ``same(gone)`` holds; the first column of ``gone`` is what ``key`` must equal, nulls too.

    ``rows`` is read twice and must give the same rows each time, as a table does.
    """
    bits = bitmap(gone)
    key_of = rows[f"`{key}`"].cast(gone.schema[0].dataType)
    merged = gone.hint("merge")
    return _met(rows, key_of, bits, False).unionByName(_met(rows, key_of, bits, True).join(merged, same(merged), "left_anti"))
