"""Lookups, joins, listings and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.operators.rollups import processing_status

SORTS = {"name": "name", "kind": "folder_rank", "size": "byte_size", "updated_at": "updated_at", "created_at": "created_at", "type": "folder_rank", "modified": "updated_at", "date": "updated_at", "created": "created_at"}
KINDS = ("image", "document", "video", "audio")


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi")


def list_children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Active children of the parents (column id), by name and id."""
    return nodes.where("lifecycle_state = 'active'").join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").orderBy("parent_id", "name", "id")


def child_name_exists(nodes: DataFrame, reqs: DataFrame) -> DataFrame:
    """reqs (parent_id, name) with name_taken: an active child of exactly that name."""
    taken = nodes.where("lifecycle_state = 'active'").select("parent_id", "name").distinct().withColumn("name_taken", F.lit(True))
    return reqs.join(taken, ["parent_id", "name"], "left").withColumn("name_taken", F.coalesce("name_taken", F.lit(False)))


def active_exists(nodes: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """ids (column id) with `exists`: an active node of that kind."""
    own = nodes.where((F.col("lifecycle_state") == "active") & (F.col("kind") == kind)).select("id", F.lit(True).alias("exists"))
    return ids.join(own, "id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def parse_kinds(kinds: str | None) -> list[str]:
    """Kinds of a comma-separated list; blanks and `all` say nothing, unknown ones raise."""
    out = [k for k in (x.strip() for x in (kinds or "").split(",")) if k and k != "all"]
    if unknown := sorted(set(out) - {"folder", *KINDS}):
        raise ValueError(f"unknown kinds: {', '.join(unknown)}")
    return out


def kind_filter(kinds: list[str]) -> Column:
    """Whether a listing row is of one of the kinds; no kinds: every row is."""
    tests = [(F.col("kind") == "folder") if k == "folder" else ((F.col("kind") == "file") & (F.col("media_kind") == k)) for k in kinds]
    out = F.lit(True) if not tests else F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def import_entries(entries: DataFrame, state: str | None = None) -> DataFrame:
    rows = entries if state is None else entries.where(F.col("state") == state)
    return rows.orderBy(F.desc("updated_at"), "id")


def pending_entries(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("state").isin("discovered", "stable", "importing")).orderBy("created_at", "id")


def interrupted_entries(entries: DataFrame) -> DataFrame:
    return entries.where("state = 'importing'").orderBy("updated_at", "id")


def active_sessions(sessions: DataFrame, folders: DataFrame) -> DataFrame:
    return sessions.where("state = 'active'").join(folders.select(F.col("id").alias("target_folder_id")), "target_folder_id", "left_semi").orderBy("created_at", "id")


def expired_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Active sessions whose end lies strictly before now."""
    return sessions.where((F.col("state") == "active") & (F.col("expires_at") < now)).orderBy("expires_at", "id")


def metadata_records(records: DataFrame, nodes: DataFrame, raw: bool = False) -> DataFrame:
    own = records.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return (own if raw else own.drop("raw_payload")).orderBy("node_id", "extractor_name")


def rows_for(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keyed lookup: artifacts, sessions, jobs, sources or objects of the keys."""
    return rows.join(keys.select(key), key, "left_semi")


def media_streams(streams: DataFrame, nodes: DataFrame) -> DataFrame:
    """The streams of the nodes (node_id) with their place, nth from 1, in the order of stream_index."""
    order = Window.partitionBy("node_id").orderBy("stream_index")
    return rows_for(streams, nodes, "node_id").withColumn("nth", F.row_number().over(order))


def favorite_flags(page: DataFrame, favorites: DataFrame) -> DataFrame:
    own = favorites.select(F.col("node_id").alias("id"), F.lit(True).alias("favorite")).distinct()
    return page.join(own, "id", "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))


def listing_base(nodes: DataFrame, objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Active nodes with size (0 where there is none), MIME and media kind, and their rank: folders 0, files 1."""
    own = objects.where("upload_state = 'finalized'").select(F.col("node_id").alias("id"), "byte_size", "mime_type")
    kinds = metadata.select(F.col("node_id").alias("id"), "media_kind")
    rows = nodes.where("lifecycle_state = 'active' AND parent_id IS NOT NULL").join(own, "id", "left").join(kinds, "id", "left")
    return rows.withColumns({"byte_size": F.coalesce("byte_size", F.lit(0).cast("long")), "folder_rank": F.when(F.col("kind") == "folder", 0).otherwise(1)})


def _order(sort: str, order: str) -> list[Column]:
    key = F.col(SORTS[sort])
    return [F.col("folder_rank"), key.desc() if order == "desc" else key.asc(), F.col("id")]


def children_pages(base: DataFrame, sort: str = "name", order: str = "asc", kinds: str | None = None, limit: int = 50, parents: DataFrame | None = None) -> DataFrame:
    """The first rows of every folder (or of the parents, column id) with their rank and has_more.

    Folders come before files, then the sort key, then the id, ascending. limit is held between 1 and 100."""
    if sort not in SORTS or order not in ("asc", "desc"):
        raise ValueError(f"unknown sort or order: {sort} {order}")
    limit = min(max(limit, 1), 100)
    rows = base.where(kind_filter(parse_kinds(kinds)))
    if parents is not None:
        rows = rows.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    own = Window.partitionBy("parent_id").orderBy(*_order(sort, order))
    shown = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= limit + 1)
    return shown.withColumn("has_more", F.max("rank").over(Window.partitionBy("parent_id")) > limit).where(F.col("rank") <= limit)


def after_cursor(base: DataFrame, cursors: DataFrame, sort: str = "name", order: str = "asc", reference_cursor: bool = False) -> DataFrame:
    """Rows that follow each folder's cursor (columns parent_id, cursor_id) in the listing's order.

    A cursor that is no child of the folder gives an empty page. reference_cursor compares (name, id)
    alone, which around the end of the folders skips or repeats rows."""
    key = SORTS["name" if reference_cursor else sort]
    ends = cursors.join(base.select(F.col("parent_id").alias("p"), F.col("id").alias("c"), F.col("folder_rank").alias("c_rank"), F.col(key).alias("c_key")), (F.col("parent_id") == F.col("p")) & (F.col("cursor_id") == F.col("c"))).select("parent_id", "c_rank", "c_key", "c")
    rows = base.join(ends, "parent_id")
    later = (F.col(key) < F.col("c_key")) if order == "desc" and not reference_cursor else (F.col(key) > F.col("c_key"))
    later = later | ((F.col(key) == F.col("c_key")) & (F.col("id") > F.col("c")))
    if not reference_cursor:
        later = (F.col("folder_rank") > F.col("c_rank")) | ((F.col("folder_rank") == F.col("c_rank")) & later)
    return rows.where(later).drop("c_rank", "c_key", "c")


def file_details(nodes: DataFrame, objects: DataFrame, metadata: DataFrame, jobs: DataFrame, records: DataFrame) -> DataFrame:
    files = downloadable_files(nodes, objects).join(metadata.select(F.col("node_id").alias("id"), "detected_mime", "media_kind"), "id", "left")
    status = processing_status(jobs, records).withColumnRenamed("node_id", "id")
    return files.join(status, "id", "left").withColumn("processing_status", F.coalesce("processing_status", F.lit("processing")))


def downloadable_files(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    own = objects.where("upload_state = 'finalized'").select(F.col("node_id").alias("id"), "byte_size", "mime_type", "storage_key")
    return nodes.where("kind = 'file' AND lifecycle_state = 'active'").join(own, "id")


def list_trash(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.where("lifecycle_state = 'trashed'").select(F.col("id").alias("node_id"), "name", "kind")
    return entries.join(own, "node_id").orderBy(F.desc("trashed_at"), "name", "node_id")


def list_favorites(favorites: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.where("lifecycle_state = 'active'").select(F.col("id").alias("node_id"), "name", "kind")
    return favorites.join(own, "node_id").orderBy(F.desc(favorites["created_at"]), "name", "node_id")


def import_source_status(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Each source with how many of its entries are in each state; sources without entries have zeros."""
    states = ["discovered", "stable", "importing", "imported", "failed"]
    own = entries.groupBy("source_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    return sources.join(own.withColumnRenamed("source_id", "id"), "id", "left").fillna(0, subset=states)


def destination_conflicts(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (id, name, target_id) whose target has an active child of that name which does not move itself."""
    taken = nodes.where("lifecycle_state = 'active'").join(moves.select("id"), "id", "left_anti").select(F.col("parent_id").alias("target_id"), "name").distinct()
    return moves.join(taken, ["target_id", "name"], "left_semi")


def restore_parent(entries: DataFrame, nodes: DataFrame, root: str = "root") -> DataFrame:
    """Each trash entry with the folder to go back to: the original parent, else the node's; the root where that is no active folder."""
    own = nodes.select(F.col("id").alias("node_id"), "parent_id", "name")
    folders = nodes.where("kind = 'folder' AND lifecycle_state = 'active'").select(F.col("id").alias("wanted"), F.lit(True).alias("there"))
    rows = entries.join(own, "node_id", "left").withColumn("wanted", F.coalesce("original_parent_id", "parent_id"))
    return rows.join(folders, "wanted", "left").withColumn("restore_to", F.when(F.col("there"), F.col("wanted")).otherwise(root)).drop("wanted", "there", "parent_id")


def storage_keys_for_deletion(tree: DataFrame, objects: DataFrame, artifacts: DataFrame) -> DataFrame:
    """root_id, id, storage_key (of the first finalized object), artifact_keys (sorted, empty if none) of every node of the trees."""
    first = objects.where("upload_state = 'finalized'").groupBy(F.col("node_id").alias("id")).agg(F.min_by("storage_key", "id").alias("storage_key"))
    keys = artifacts.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list("storage_key")).alias("artifact_keys"))
    return tree.join(first, "id", "left").join(keys, "id", "left").withColumn("artifact_keys", F.coalesce("artifact_keys", F.array().cast("array<string>"))).select("root_id", "id", "storage_key", "artifact_keys")
