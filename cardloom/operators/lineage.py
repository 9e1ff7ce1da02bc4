"""Cutting the lineage of tables that a loop reads again and again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a checkpoint.

    The folder is the context's, or else the session's ``spark.checkpoint.dir``; where neither is set a temporary folder is taken, with a local master only.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        context.setCheckpointDir(root)
    return df.checkpoint()
