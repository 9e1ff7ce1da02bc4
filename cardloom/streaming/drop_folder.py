"""Drop folder: text variants that arrive as files become records, batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cardloom.operators.records import build_records

TEXTS = "doc_id bigint, label string, psm int, text string"


def stream_records(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Records of each batch of Parquet files below ``source`` are appended to ``target``.

    All variants of a document must arrive in one batch of files.  A batch that is run again overwrites its own folder; the folder's name holds
    the checkpoint's, so a new checkpoint, whose batches start at 0 again, overwrites none of an older one's.
    """
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        build_records(batch).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    texts = spark.readStream.schema(TEXTS).parquet(source)
    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
