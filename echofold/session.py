"""Session settings that operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a local session that has none gets a temporary one."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if where is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="echofold-")
    if own.isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder, and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
