"""Operator 2, sharding: jump consistent hashing with native expressions.

The jump hash follows the published algorithm (Lamping and Veach): a 64-bit linear
congruential generator seeded with the key proposes ever larger buckets, and the shard is the
last one below the shard count.  The buckets visited do not depend on the shard count, so one
evaluation gives the shard for every count up to a maximum, and a shard that is appended
takes rows from the others without moving any row between those.

Spark's 64-bit products raise on overflow, so the generator's state is kept as two 32-bit
halves in longs and multiplied limb by limb.

Defined results
* a null key is placed like key 0, a null text has size 1 and the checksum of the empty text;
* rows that repeat a key go to the same shard and get different slots;
* ``slot`` numbers a shard's rows by (range, key, checksum, size); ranges only spread that
  sort over tasks: they depend on the row's own values, so a shard or a text that holds most rows is
  still numbered by many tasks;
* an empty table gives no rows; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.scratch import stage

# Fixed values of the generator: the multiplier 2862933555777941757 as 32-bit halves, the low one also as 16-bit halves.
MULT = 2862933555777941757
_MH, _ML = MULT >> 32, MULT & 0xFFFFFFFF
_ML_H, _ML_L = _ML >> 16, _ML & 0xFFFF
_MASK = 0xFFFFFFFF
#: Ranges per shard that are numbered independently.
RANGES = 1024
#: Rows of the table of offsets at most, 24 MB.
MOST_OFFSETS = 1_000_000


def jump_path(key: F.Column, most: int) -> F.Column:
    """Buckets below ``most`` that the jump hash of a long key visits, ascending and from 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    mask = long(_MASK)
    start = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(mask).alias("hi"),
        key.bitwiseAND(mask).alias("lo"),
        long(0).alias("at"),
        F.array(long(0)).alias("path"),
    )

    def step(s, _):
        hi, lo = s["hi"], s["lo"]
        p0, p1 = lo * _ML_L, lo * _ML_H
        low = p0 + F.shiftleft(p1.bitwiseAND(long(0xFFFF)), 16) + 1
        carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
        cross = hi * _ML_L + F.shiftleft((hi * _ML_H).bitwiseAND(long(0xFFFF)), 16)
        mh_l, mh_h = _MH & 0xFFFF, _MH >> 16
        cross = cross + lo * mh_l + F.shiftleft((lo * mh_h).bitwiseAND(long(0xFFFF)), 16)
        new_hi = (carry + cross).bitwiseAND(mask)
        to = F.floor((s["at"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double")))
        # a path that has left the range stays where it is
        return F.struct(
            new_hi.alias("hi"),
            low.bitwiseAND(mask).alias("lo"),
            F.when(s["at"] < most, to).otherwise(s["at"]).alias("at"),
            F.when((s["at"] < most) & (to < most), F.concat(s["path"], F.array(to))).otherwise(s["path"]).alias("path"),
        )

    if most < 2:
        return F.array(long(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["path"])


def shard_of(path: F.Column, shards: int) -> F.Column:
    """Shard among ``shards``: the last bucket of the path below that number."""
    return F.array_max(F.filter(path, lambda b: b < shards)).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, grown_shard, slot``.

    The texts are read once; the staged rows have 40 bytes each.  The table of offsets has at most
    ``shards * ranges`` rows, whatever the input, and is broadcast for that reason.
    """
    if shards * ranges > MOST_OFFSETS:
        raise ValueError("too many offsets to broadcast; take fewer ranges")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    crc = F.crc32(text.cast("binary"))
    placed = (
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            crc.alias("text_crc32"),
            jump_path(key, shards + 1).alias("path"),
        )
        .withColumn("shard", shard_of(F.col("path"), shards))
        .withColumn("grown_shard", shard_of(F.col("path"), shards + 1))
        .withColumn("span", F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ranges)) + F.col("text_crc32"), F.lit(ranges)).cast("int"))
        .drop("path")
    )
    placed = stage(placed, "placed")
    counts = placed.groupBy("shard", "span").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("span")) - F.col("n")
    offsets = stage(counts.select("shard", "span", before.alias("before")), "offsets")
    within = Window.partitionBy("shard", "span").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("slot", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "span"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Write whole rows below ``path/shard=K``; rows are not shuffled, each task writes to the shards it has rows of."""
    docs.withColumn("shard", shard_of(jump_path(F.col(id_col), shards), shards)).write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in eight shards by the law ``key``, and where a ninth shard would have it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = assign_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)
  )
), d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, 0) AS k, doc_id, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT rid, k, doc_id, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc_table
), jump AS (
  SELECT rid, (CASE WHEN k < 0 THEN 18446744073709551616::UHUGEINT - (-k)::UHUGEINT ELSE k::UHUGEINT END) AS key, 0::BIGINT AS cur, 0::BIGINT AS b8, 0::BIGINT AS b9, 0 AS step FROM d
  UNION ALL
  SELECT rid, nk, nat, CASE WHEN nat < 8 THEN nat ELSE b8 END, CASE WHEN nat < 9 THEN nat ELSE b9 END, step + 1 FROM (
    SELECT *, floor((cur + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE))::BIGINT AS nat FROM (
      SELECT *, ((key * {MULT}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT) AS nk FROM jump WHERE cur < 9))
), placed AS (
  SELECT rid, max(b8)::INTEGER AS shard, max(b9)::INTEGER AS grown_shard FROM jump GROUP BY rid
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ((k % {RANGES} + {RANGES}) % {RANGES} + text_crc32) % {RANGES}, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM sized JOIN placed USING (rid)
"""
