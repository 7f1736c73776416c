"""Places of rows in the order of their group, however large a group is: ranges are sorted and counted, nothing is numbered in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.common import cut


def join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys of which a null equals a null; the right keys go."""
    renamed = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    on = reduce(Column.__and__, (left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def numbered(rows: DataFrame, by: list[str], order: list[str], to: str) -> DataFrame:
    """rows and `to`: gapless places from 0 within `by`, ascending by `order`, nulls first.

    Rows are dealt out by ranges of (by, order), so a group that holds most rows is many ranges; rows that
    are equal in all of it are dealt out by a number drawn for each, since any order of them is the right one.
    Only counts for each range and group are summed: at most as many for a group as there are ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = rows.withColumn("_draw", F.rand(11))
    ranged = drawn.repartitionByRange(parts, *by, *order, "_draw").sortWithinPartitions(*by, *order)
    held = cut(ranged.drop("_draw").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = held.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")) - F.col("_n")).drop("_n")
    return join_safe(held, before, [*by, "_part"]).withColumn(to, (F.col("_before") + F.col("_at") - F.col("_first")).cast("long")).drop("_part", "_at", "_before", "_first")
