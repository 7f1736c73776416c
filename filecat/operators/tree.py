"""Walks over the folder tree, a level at a time for all starting points at once.

A walk keeps pairs (start, node) and joins the newest level with the nodes; levels are as few as the
tree is deep, and each is cut off by a checkpoint. A walk deeper than max_depth raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecat.plans.cuts import cut

ROOT, MAX_DEPTH = "root", 1000


def _walk(first: DataFrame, step, max_depth: int) -> DataFrame:
    """Union of all levels; step: from the newest level to the next one."""
    levels, level = [], cut(first)
    while not level.isEmpty():
        levels.append(level)
        if len(levels) > max_depth:
            raise ValueError(f"the tree has a cycle or more than {max_depth} levels")
        level = cut(step(level))
    return reduce(DataFrame.unionByName, levels) if levels else level


def descend(nodes: DataFrame, starts: DataFrame, state: str | None = "active", max_depth: int = MAX_DEPTH) -> DataFrame:
    """root_id, id, depth of the starts (column id) and all below them, by nodes of that state alone."""
    own = nodes if state is None else nodes.where(F.col("lifecycle_state") == state)
    own = cut(own.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")))  # each level reads it
    first = starts.select("id").distinct().join(own.select(F.col("child").alias("id")), "id", "left_semi").select(F.col("id").alias("root_id"), "id", F.lit(0).alias("depth"))
    return _walk(first, lambda level: level.join(own, level["id"] == own["parent"]).select("root_id", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth")), max_depth)


def active_descendants(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return descend(nodes, starts).where("depth > 0")


def active_subtree(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Ids in the union of the starts' subtrees, each once."""
    return descend(nodes, starts).select("id").distinct()


def trashed_subtree(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return descend(nodes, starts, "trashed")


def ancestor_pairs(nodes: DataFrame, ids: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node_id, ancestor_id, distance, of any state."""
    up = cut(nodes.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent")))
    first = ids.select("id").distinct().join(up, F.col("id") == up["child"]).select(F.col("id").alias("node_id"), F.col("parent").alias("ancestor_id"), F.lit(1).alias("distance"))
    return _walk(first, lambda level: level.join(up, level["ancestor_id"] == up["child"]).select("node_id", F.col("parent").alias("ancestor_id"), (F.col("distance") + 1).alias("distance")), max_depth)


def ancestors(nodes: DataFrame, ids: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node_id, ancestor_id, distance: the chain from each id (itself at 0) up through active folders; it ends where one is not."""
    folders = cut(nodes.where("kind = 'folder' AND lifecycle_state = 'active'").select(F.col("id").alias("at"), F.col("parent_id").alias("above")))
    first = ids.select("id").distinct().join(folders, F.col("id") == folders["at"]).select(F.col("id").alias("node_id"), F.col("at").alias("ancestor_id"), F.lit(0).alias("distance"), "above")
    step = lambda level: level.drop("ancestor_id").join(folders.withColumnRenamed("above", "next"), F.col("above") == F.col("at")).select("node_id", F.col("at").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"), F.col("next").alias("above"))
    return _walk(first, step, max_depth).select("node_id", "ancestor_id", "distance")


def with_paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, path_ids, path_names, path_states, depth of every node that the root leads to; names and states without the root's."""
    nodes = cut(nodes.select("id", "parent_id", "name", "lifecycle_state"))
    own = nodes.select(F.col("id").alias("child"), "parent_id", "name", "lifecycle_state")
    none = F.array().cast("array<string>")
    first = nodes.where("parent_id is null").select("id", F.array("id").alias("path_ids"), none.alias("path_names"), none.alias("path_states"), F.lit(0).alias("depth"))
    step = lambda level: level.join(own, level["id"] == own["parent_id"]).select(F.col("child").alias("id"), F.array_append("path_ids", F.col("child")).alias("path_ids"), F.array_append("path_names", F.col("name")).alias("path_names"), F.array_append("path_states", F.col("lifecycle_state")).alias("path_states"), (F.col("depth") + 1).alias("depth"))
    return _walk(first, step, max_depth)


def drop_nested_selection(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected ids of which no ancestor is selected."""
    ids = selected.select("id").distinct()
    nested = ancestor_pairs(nodes, ids).join(ids.withColumnRenamed("id", "ancestor_id"), "ancestor_id", "left_semi").select(F.col("node_id").alias("id"))
    return ids.join(nested, "id", "left_anti")


def cycle_check(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """id, target_id, cycle: whether the target is the moved node or below it."""
    above = ancestor_pairs(nodes, moves.select(F.col("target_id").alias("id"))).select(F.col("node_id").alias("target_id"), F.col("ancestor_id").alias("id"), F.lit(True).alias("below")).distinct()
    return moves.join(above, ["id", "target_id"], "left").select("id", "target_id", ((F.col("id") == F.col("target_id")) | F.coalesce("below", F.lit(False))).alias("cycle"))


def virtual_path(paths: DataFrame) -> DataFrame:
    """id, path such as /a/b; the root is /."""
    return paths.select("id", F.concat(F.lit("/"), F.array_join("path_names", "/")).alias("path"))


def normalised(path: Column, cwd: Column) -> Column:
    """Path with blank and . segments dropped and .. applied, from cwd unless it begins with /."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(cwd, F.lit("/"), path))
    parts = F.filter(F.transform(F.split(full, "/"), lambda s: F.trim(s)), lambda s: ~s.isin("", "."))
    up = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def resolve_paths(nodes: DataFrame, reqs: DataFrame) -> DataFrame:
    """request_id, node_id (null: no such path): exact names, active nodes only."""
    active = with_paths(nodes.where("lifecycle_state = 'active'"))
    return reqs.withColumn("path", normalised(F.col("path"), F.col("cwd"))).join(virtual_path(active).withColumnRenamed("id", "node_id"), "path", "left").select("request_id", "node_id")


def ensure_folder_paths(nodes: DataFrame, files: DataFrame, base: str = ROOT) -> DataFrame:
    """path, folder_id, outcome (exists, created, conflict) of each folder above the files' relative paths.

    Level by level an active folder of that name is used again, a file of that name is a conflict, and what
    lies below a conflict is one as well; a new folder's id is the hash of its parent's id and its name."""
    dirs = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    prefixes = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda k: F.slice(dirs, F.lit(1), k))).alias("parts")).where(F.element_at("parts", 1) != "").distinct()
    wanted = prefixes.select(F.array_join("parts", "/").alias("path"), F.size("parts").alias("level"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/").alias("above"), F.element_at("parts", -1).alias("name"))
    taken = nodes.where("lifecycle_state = 'active'").select(F.col("parent_id").alias("parent"), F.col("name").alias("own_name"), F.col("id").alias("own_id"), F.col("kind").alias("own_kind"))

    def place(rows: DataFrame) -> DataFrame:
        found = rows.join(taken, (F.col("parent") == F.col("parent_id")) & (F.col("own_name") == F.col("name")), "left")
        outcome = F.when(F.col("above_outcome") == "conflict", "conflict").when(F.col("own_kind") == "file", "conflict").when(F.col("own_id").isNotNull(), "exists").otherwise("created")
        new = F.sha2(F.concat(F.col("parent_id"), F.lit("/"), F.col("name")), 256)
        return found.select("path", "level", outcome.alias("outcome"), F.when(outcome == "exists", F.col("own_id")).when(outcome == "created", new).alias("folder_id"))

    first = place(wanted.where("level = 1").withColumn("parent_id", F.lit(base)).withColumn("above_outcome", F.lit("exists")))
    step = lambda done: place(wanted.join(done.select(F.col("path").alias("above"), F.col("folder_id").alias("parent_id"), F.col("outcome").alias("above_outcome"), (F.col("level") + 1).alias("level")), ["above", "level"]))
    return _walk(first, step, MAX_DEPTH).select("path", "folder_id", "outcome")
