"""Running maxima and places in an order over any number of rows: ranges are scanned apart and joined by what came before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.plans.cuts import cut


def max_before(rows: DataFrame, by: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """rows and `to`: the greatest value of the rows of the same group (by: no nulls) that sort before, null for none.

    Rows are dealt out by ranges of (by, order); a window runs over a range's part of a group, and another one
    over a single row for each range, so no group has to be sorted in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    tops = held.groupBy(*by, "_part").agg(F.max(value).alias("_top"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.withColumn("_earlier", F.max("_top").over(ahead(Window.partitionBy(*by).orderBy("_part")))).drop("_top")
    inner = F.max(value).over(ahead(Window.partitionBy(*by, "_part").orderBy(*order)))
    return held.withColumn("_inner", inner).join(earlier, [*by, "_part"]).withColumn(to, F.greatest("_inner", "_earlier")).drop("_part", "_inner", "_earlier")


def places(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """rows and `to`: gapless places from 1 in the given order, which has to tell all rows apart. Only counts of ranges are summed in one place."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return held.join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
