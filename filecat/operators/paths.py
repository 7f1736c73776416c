"""An index of paths: every node with all its ancestors, kept up to date under moves instead of walked again.

The index is made by pointer doubling: after k rounds a node knows the 2 ** k nodes above it, so a chain a
thousand deep takes ten joins. What a walk answers by a join for each level is then one join.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecat.operators.tree import MAX_DEPTH, normalised
from filecat.plans.cuts import cut

PARTS = ["path_ids", "path_names", "path_states"]


def _doubled(rows: DataFrame, parts: list[str], max_depth: int) -> DataFrame:
    """rows (id, up, parts): each part with those of all that `up` leads to before its own. Rows whose `up` leads nowhere go."""
    for _ in range(ceil(log2(max_depth)) + 1):
        open_ = rows.where("up IS NOT NULL")
        if open_.isEmpty():
            return rows.drop("up")
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), *(F.col(p).alias(f"_{p}") for p in parts))
        longer = open_.join(above, "up").select("id", F.col("_up").alias("up"), *(F.concat(f"_{p}", p).alias(p) for p in parts))
        rows = cut(rows.where("up IS NULL").unionByName(longer))
    raise ValueError(f"there is a cycle, or a chain of more than {max_depth}")


def path_index(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, path_ids, path_names, path_states of every node that a root leads to: itself last, the root first, its names and states beside."""
    first = nodes.select("id", F.col("parent_id").alias("up"), F.array("id").alias("path_ids"), F.array("name").alias("path_names"), F.array("lifecycle_state").alias("path_states"))
    return _doubled(cut(first), PARTS, max_depth)


def virtual_paths(index: DataFrame) -> DataFrame:
    """R8. id, path; the root is /."""
    return index.select("id", F.concat(F.lit("/"), F.array_join(F.slice("path_names", F.lit(2), F.size("path_names")), "/")).alias("path"))


def resolve(index: DataFrame, reqs: DataFrame) -> DataFrame:
    """R9. request_id, node_id of reqs (request_id, path, cwd) by one join on the path; null: no such path of active nodes."""
    active = index.where(F.forall("path_states", lambda s: s == "active"))
    return reqs.withColumn("path", normalised(F.col("path"), F.col("cwd"))).join(virtual_paths(active).withColumnRenamed("id", "node_id"), "path", "left").select("request_id", "node_id")


def unnested(index: DataFrame, selected: DataFrame) -> DataFrame:
    """R6. The selected ids of which no ancestor is selected."""
    ids = selected.select("id").distinct()
    above = ids.join(index, "id").select("id", F.explode(F.slice("path_ids", F.lit(1), F.size("path_ids") - 1)).alias("above"))
    return ids.join(above.join(ids.withColumnRenamed("id", "above"), "above", "left_semi").select("id"), "id", "left_anti")


def cycles(index: DataFrame, moves: DataFrame) -> DataFrame:
    """R7. id, target_id, cycle: whether the target is the moved node or below it."""
    there = index.select(F.col("id").alias("target_id"), F.col("path_ids").alias("_path"))
    return moves.join(there, "target_id", "left").select("id", "target_id", ((F.col("id") == F.col("target_id")) | F.coalesce(F.array_contains("_path", F.col("id")), F.lit(False))).alias("cycle"))


def _deepest(rows: DataFrame, key: str, moves: DataFrame) -> DataFrame:
    """key, _at, _moved: of each row's path the last place (from 0) with a moved node, and that node."""
    places = rows.select(key, F.posexplode("path_ids").alias("_at", "_moved"))
    hit = places.join(moves.select(F.col("moved").alias("_moved")), "_moved")
    return hit.groupBy(key).agg(F.max(F.struct("_at", "_moved")).alias("_hit")).select(key, "_hit.*")


def moved(index: DataFrame, moves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index after T-03's moves (id, target_id): what lies below a moved folder gets the new path of its target before its own tail.

    A node below several moved folders follows the deepest one; targets that move along have new paths
    themselves, which are found by doubling over the moves alone. Moves that lead in a circle raise."""
    own = moves.select(F.col("id").alias("moved"), "target_id").dropDuplicates(["moved"])
    targets = own.join(index.withColumnRenamed("id", "target_id"), "target_id")
    split = targets.join(_deepest(targets, "moved", own), "moved", "left")
    tail = lambda p, at: F.slice(p, at + 1, F.size(p))
    pieces = split.select(F.col("moved").alias("id"), F.col("_moved").alias("up"), *(F.when(F.col("_at").isNull(), F.col(p)).otherwise(tail(p, F.col("_at"))).alias(p) for p in PARTS))
    heads = _doubled(cut(pieces), PARTS, max_depth).select(F.col("id").alias("_moved"), *(F.col(p).alias(f"_{p}") for p in PARTS))
    rows = index.join(_deepest(index, "id", own), "id", "left").join(heads, "_moved", "left")
    return rows.select("id", *(F.when(F.col("_at").isNull(), F.col(p)).otherwise(F.concat(f"_{p}", tail(p, F.col("_at")))).alias(p) for p in PARTS))


def depth(path: str = "path_ids") -> Column:
    return F.size(path) - 1
