"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that setting is absent a temporary folder of the driver is used, with a local
master only: on a cluster each executor would write to its own disk.  A staged table cuts the lineage: an executor that is lost
afterwards costs a reread of Parquet files and no recomputation.

Tables of rounds that are over are removed at once (:func:`forget`); the others are read by the DataFrame that a call returns, and
:func:`release` removes them when the session needs none of its results any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this session's scratch tables."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        root = _LOCAL[context.applicationId]
    return f"{root.rstrip('/')}/cardloom/{context.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside gets so many rows at most in an Arrow batch, which the executor and its Python worker hold whole; the session's own setting returns after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    spark.conf.set(name, min(own, rows) if own > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def forget(*tables: DataFrame) -> None:
    """Remove tables that :func:`stage` has returned; nothing that is still to run may read them."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this session; DataFrames that the operators have returned can't be read afterwards."""
    _delete(spark, shared_dir(spark))
