"""Operator 1, exact dedup: a persistent digest index and a sort-merge anti-join.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
normalised text.  A batch is reduced to one row per digest (partial aggregation, so a
text with millions of copies never meets in one task), anti-joined with the index and
the digests that remain are appended.  Only ids and 32-byte digests are shuffled; texts
are read once and stay where they are.  In both joins with the index its buckets are taken as they lie: only the batch is shuffled.

A batch has a name.  Digests that it has put into the index count as its own when it comes again, so a batch
that is repeated after a failure gets the verdict of its first attempt.  Each batch adds a file to every bucket; :meth:`DigestIndex.compact`
leaves one.

Defined results
* a null text counts as the empty text; empty texts are equal to each other;
* of equal texts the row with the smallest ``doc_id`` stays, null ids last; of rows that repeat
  text *and* id exactly one stays (the first in scan order);
* a text that a batch of another name has put into the index has its keeper there, so no row of
  this batch stays for it; ``group_size`` counts the rows of the batch at hand;
* an empty table gives an empty result; extra columns are ignored by :meth:`DigestIndex.ingest`
  and carried through by :func:`drop_duplicates`.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.rows_out import without
from cardloom.llm.scratch import fresh_path, stage

#: What one blank replaces before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def text_digest(text) -> F.Column:
    """32-byte SHA-256 of the normalised text in UTF-8."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256))


class DigestIndex:
    """Digests seen so far, in a table at ``path`` that outlives the session.

    The number of buckets is fixed when the index is created and read back from its
    ``meta`` table afterwards, so that a later session can't misread the bucket files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            latest = F.max(F.struct("version", "buckets", "folder")).alias("m")
            self.version, self.buckets, self.folder = spark.read.schema("version int, buckets int, folder string").json(f"{self.path}/meta").agg(latest).first()["m"]
        except (AnalysisException, TypeError):
            self._note(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "digests")
        self.table = self._open(self.folder)

    def _note(self, version: int, buckets: int, folder: str) -> None:
        """Say which folder holds the digests from now on; a file that is added at once or not at all."""
        self.version, self.buckets, self.folder = version, buckets, folder
        self.spark.createDataFrame([(version, buckets, folder)], "version int, buckets int, folder string").coalesce(1).write.mode("append").json(f"{self.path}/meta")

    def _open(self, folder: str) -> str:
        """The folder as a table of the catalog."""
        table = "digest_index_" + hashlib.sha256(f"{self.path}/{folder}".encode()).hexdigest()[:16]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest binary, keep_id bigint, batch string) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return table

    def close(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def entries(self) -> DataFrame:
        """``digest, keep_id, batch`` in the index's buckets."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def compact(self) -> None:
        """Write the digests anew, one file for each bucket.  No batch may run meanwhile; until the end the old files are in force."""
        folder = f"digests-{uuid.uuid4().hex[:12]}"
        table = self._open(folder)
        self.entries().repartition(self.buckets, "digest").write.insertInto(table)
        self.close()
        self._note(self.version + 1, self.buckets, folder)
        self.table = table

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append the digests that are new and return a verdict for each row of ``docs``:
        ``doc_id, row, keep_id, group_size, kept, digest``.  A batch that may be repeated needs a name."""
        batch = batch or uuid.uuid4().hex
        rows = stage(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.monotonically_increasing_id().alias("row"),
                text_digest(F.col(text_col)).alias("digest"),
            ),
            "digests",
        )
        # null ids sort last: the flag comes first in the struct that is minimised
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        groups = stage(rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size")), "groups")

        fresh = groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.table)

        own = F.when(F.col("batch") == batch, F.col("first.row")).alias("keep_row")
        owners = stage(groups.join(self.entries().hint("merge"), "digest").select("digest", "keep_id", "group_size", own), "owners")
        return rows.join(owners, "digest").select(
            "doc_id", "row", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest"
        )


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """``docs`` without the rows whose text another row or an earlier batch keeps.

    Only the ids to drop are joined with the texts.  Rows that repeat an id *and* a text are thinned to
    one row in a separate branch, which is empty where ids are unique.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark, fresh_path(spark, "index"))
    verdict = stage(own.ingest(docs, id_col, text_col, batch).select("doc_id", "digest", "kept"), "verdict")
    if index is None:
        own.close()
    pairs = verdict.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = stage(pairs.where("NOT kept OR n > 1").select(F.col("doc_id").alias("drop_id"), F.col("digest").alias("drop_digest"), "kept"), "dropped")
    same = lambda g: docs[id_col].cast("long").eqNullSafe(g["drop_id"]) & (text_digest(docs[text_col]) == g["drop_digest"])
    out = without(docs, id_col, gone, same)
    repeated = gone.where("kept")
    if not repeated.isEmpty():
        repeated = repeated.hint("merge")
        meant = docs.join(repeated, same(repeated))
        one = Window.partitionBy(repeated["drop_id"], repeated["drop_digest"]).orderBy(repeated["drop_id"])
        number = "row_" + uuid.uuid4().hex  # no column of the table has this name
        out = out.unionByName(meant.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*[docs[f"`{c}`"] for c in docs.columns]))
    return out


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every row of ``documents`` against an index that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, fresh_path(spark, "index"))
    verdict = index.ingest(docs)
    index.close()
    return verdict.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
