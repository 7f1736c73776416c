"""Sinks of streams: a batch that comes again does no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from filecat.plans.maintenance import upsert_import_entries
from filecat.sources import snapshots


class EntrySink:
    """X1's sink: each batch of found files is applied to the import entries by T-21 and committed as one snapshot.

    The commit names the batch. A batch whose commit is there is not applied again, so a stream that starts
    anew after a loss between commit and checkpoint leaves the entries as they are; a loss before the commit
    leaves files that no commit names."""

    def __init__(self, spark: SparkSession, folder: str, empty: DataFrame, now: Column | Callable[[int], Column]):
        self.spark, self.folder, self.empty, self.now = spark, folder, empty, now

    def entries(self) -> DataFrame:
        found = snapshots.load(self.spark, self.folder)
        return found["import_entries"] if found else self.empty

    def __call__(self, batch: DataFrame, number: int) -> None:
        if snapshots.committed(self.spark, self.folder, f"batch-{number}"):
            return
        now = self.now(number) if callable(self.now) else self.now
        snapshots.save(self.spark, {"import_entries": upsert_import_entries(self.entries(), batch, now)}, self.folder, f"batch-{number}")
