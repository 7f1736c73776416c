"""Snapshots of a catalog: tables first, then one small commit that names them, so that a broken write is never read.

A folder has `data/<version>/<table>` and a table of commits. The commit is one row in one file, which the
writer renames into its place; readers follow the newest commit. `nodes` is bucketed and sorted by parent_id,
so that a step of a walk, which joins a level with the children of its folders, moves the level alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "version string, number long, tag string, tables array<string>, buckets int"
#: Tables that are bucketed, and by what.
BUCKETED = {"nodes": "parent_id"}


def commits(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMITS).parquet(f"{folder}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The newest commit: one row."""
    found = commits(spark, folder)
    row = found.orderBy(F.desc("number"), F.desc("version")).first() if found is not None else None
    return row.asDict() if row else None


def committed(spark: SparkSession, folder: str, tag: str) -> bool:
    found = commits(spark, folder)
    return found is not None and not found.where(F.col("tag") == tag).isEmpty()


def save(spark: SparkSession, tables: dict[str, DataFrame], folder: str, tag: str = "", buckets: int = 8) -> str:
    """Writes the tables as a new version and commits it; the version's name. What is read from an older version may be among its inputs."""
    version, last = uuid.uuid4().hex, newest(spark, folder)
    for name, rows in tables.items():
        path, writer = f"{folder}/data/{version}/{name}", rows.write
        if name in BUCKETED:
            key = BUCKETED[name]
            made = f"filecat_writing_{version}_{name}"
            rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(made)
            spark.sql(f"DROP TABLE {made}")  # an external table: its files stay
        else:
            writer.parquet(path)
    row = [(version, (last["number"] if last else 0) + 1, tag, sorted(tables), buckets)]
    spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return version


def load(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest commit, or of the commit of that version; none: no commit."""
    found = commits(spark, folder)
    if found is None:
        return {}
    row = newest(spark, folder) if version is None else found.where(F.col("version") == version).first().asDict()
    if row is None:
        return {}
    out = {}
    for name in row["tables"]:
        path = f"{folder}/data/{row['version']}/{name}"
        rows = spark.read.parquet(path)
        if name in BUCKETED:
            made = f"filecat_{row['version']}_{name}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {made} ({columns}) USING parquet CLUSTERED BY ({BUCKETED[name]}) SORTED BY ({BUCKETED[name]}) INTO {row['buckets']} BUCKETS LOCATION '{path}'")
            rows = spark.table(made)
        out[name] = rows
    return out
