"""Reliable cuts of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder, which the cluster names in spark.checkpoint.dir.

    One of our own is made only in local mode, where all tasks share the driver's
    folders; a cluster that names none gets an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once into the reliable checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
