"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, one of its own in local mode alone: other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(rows: DataFrame) -> DataFrame:
    """Writes rows to the shared folder and goes on from there."""
    spark = rows.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.checkpoint(eager=True)
