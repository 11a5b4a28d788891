"""Cutting the lineage of small tables that a loop builds on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster names, and read from there: later rounds don't recompute it.

    Only a local session without such a folder gets one of its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="aerolens-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
