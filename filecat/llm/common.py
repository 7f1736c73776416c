"""What the text operators share: table access and bounded Arrow slices."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecat.plans.cuts import shared_dir

#: Texts are handled in slices of about this many bytes, so temporary arrays stay small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of the input can clash with nothing."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))


def checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder the cluster names in spark.checkpoint.dir; sets one only where none is named, in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Spark removes shuffle files (and checkpoints, where spark.cleaner.referenceTracking.cleanCheckpoints says so) of
    tables that nothing refers to any more, but only when the driver's garbage is collected: this asks for it before a
    step that needs much disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches where the text column passes the limit; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def set_out(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))
