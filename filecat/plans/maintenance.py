"""Batch maintenance of a catalog: each plan takes tables, requests and the moment `now`, and returns changed
tables or the rows to add, with an outcome for each request. Nothing is changed in place: the caller
writes the result as a new snapshot. Requests of one batch do not depend on each other; of two that
want the same name or key, the one with the smaller request id wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.functions.columns import has_artifacts, is_safe_relative, projected_percent
from filecat.functions.intervals import Ranges
from filecat.operators import rollups as R
from filecat.operators import tree as T
from filecat.operators.listing import destination_conflicts, restore_parent
from filecat.plans.cuts import cut


def days(ts: Column, n: int) -> Column:
    return ts + F.make_interval(days=F.lit(n))


def _new_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("/", *parts), 256)


def _first(rows: DataFrame, key: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy("request_id")) == 1


def _siblings(nodes: DataFrame) -> DataFrame:
    return nodes.where("lifecycle_state = 'active'").select("parent_id", "name", F.lit(True).alias("taken")).distinct()


def _folders(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.where("kind = 'folder' AND lifecycle_state = 'active'").select(F.col("id").alias(column), F.lit(True).alias("folder"))


def _node_rows(rows: DataFrame, kind: str, now: Column) -> DataFrame:
    return rows.select("id", "parent_id", "name", F.lit(kind).alias("kind"), F.lit("active").alias("lifecycle_state"), now.alias("created_at"), now.alias("updated_at"))


def create_folders(nodes: DataFrame, reqs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """T-01. reqs: request_id, parent_id, name. New folder rows, and request_id, outcome, id."""
    rows = reqs.join(_folders(nodes, "parent_id"), "parent_id", "left").join(_siblings(nodes), ["parent_id", "name"], "left")
    ok = F.col("folder").isNotNull() & (F.col("name") != "") & F.col("taken").isNull()
    rows = rows.withColumn("ok", ok).withColumn("first", F.row_number().over(Window.partitionBy("parent_id", "name", "ok").orderBy("request_id")) == 1)
    outcome = F.when(F.col("name") == "", "invalid_name").when(F.col("folder").isNull(), "parent_not_found").when(F.col("taken").isNotNull() | ~F.col("first"), "name_conflict").otherwise("ok")
    done = rows.select("request_id", "parent_id", "name", outcome.alias("outcome"), F.when(outcome == "ok", _new_id("parent_id", "name")).alias("id"))
    return _node_rows(done.where("outcome = 'ok'"), "folder", now), done.select("request_id", "outcome", "id")


def update_folders(nodes: DataFrame, reqs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """T-02. reqs: request_id, id, new_name, new_parent (null: as it is). The nodes with changes, and outcomes."""
    own = nodes.where("kind = 'folder' AND lifecycle_state = 'active'").select("id", "parent_id", "name")
    rows = reqs.join(own, "id", "left").withColumn("to_name", F.coalesce("new_name", "name")).withColumn("target_id", F.coalesce("new_parent", "parent_id"))
    rows = rows.join(_folders(nodes, "target_id"), "target_id", "left").join(T.cycle_check(nodes, rows.where("target_id IS NOT NULL").select("id", "target_id").distinct()), ["id", "target_id"], "left")
    there = nodes.where("lifecycle_state = 'active'").select(F.col("parent_id").alias("target_id"), F.col("name").alias("to_name"), F.col("id").alias("sibling"))
    clash = rows.join(there, ["target_id", "to_name"]).where("sibling <> id").select("request_id", F.lit(True).alias("clash")).distinct()
    rows = rows.join(clash, "request_id", "left").withColumn("first", _first(rows, ["target_id", "to_name"]))
    outcome = F.when(F.col("name").isNull(), "not_found").when(F.col("to_name") == "", "invalid_name").when(F.col("folder").isNull(), "parent_not_found").when(F.col("cycle"), "cycle").when(F.col("clash") | ~F.col("first"), "name_conflict").otherwise("ok")
    done = rows.select("request_id", "id", "to_name", "target_id", outcome.alias("outcome"))
    change = done.where("outcome = 'ok'").select("id", F.col("to_name").alias("_name"), F.col("target_id").alias("_parent"))
    out = nodes.join(change, "id", "left")
    return out.withColumns({"name": F.coalesce("_name", "name"), "parent_id": F.coalesce("_parent", "parent_id"), "updated_at": F.when(F.col("_name").isNotNull(), now).otherwise(F.col("updated_at"))}).select(nodes.columns), done.select("request_id", "outcome")


def move_conflicts(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """batch, id, conflict of the moves (batch, id, target_id) that can't be made: not_found, cycle or name_conflict, one for each id."""
    nodes = cut(nodes.select("id", "parent_id", "name", "kind", "lifecycle_state"))  # read once, for a check and a walk
    own = nodes.where("kind = 'folder' AND lifecycle_state = 'active'").select("id", "name")
    rows = moves.join(own, "id", "left").join(_folders(nodes, "target_id"), "target_id", "left").join(T.cycle_check(nodes, moves.select("id", "target_id").distinct()), ["id", "target_id"], "left")
    duplicate = R.batch_duplicate_names(rows).select("batch", "id", F.lit(True).alias("twice")).distinct()
    there = destination_conflicts(nodes, rows).select("batch", "id", F.lit(True).alias("there")).distinct()
    rows = rows.join(duplicate, ["batch", "id"], "left").join(there, ["batch", "id"], "left")
    conflict = F.when(F.col("name").isNull() | F.col("folder").isNull(), "not_found").when(F.col("cycle"), "cycle").when(F.col("twice") | F.col("there"), "name_conflict")
    return rows.select("batch", "id", conflict.alias("conflict")).where("conflict IS NOT NULL").distinct()


def move_folders(nodes: DataFrame, moves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """T-03. moves: batch, id, target_id. A batch with any conflict moves nothing. Nodes with changes, and batch, id, outcome."""
    moves = moves.dropDuplicates(["batch", "id"])
    conflicts = move_conflicts(nodes, moves)
    bad = conflicts.select("batch").distinct()
    done = moves.join(bad, "batch", "left_anti").select("id", F.col("target_id").alias("_to"))
    out = nodes.join(done, "id", "left").withColumns({"parent_id": F.coalesce("_to", "parent_id"), "updated_at": F.when(F.col("_to").isNotNull(), now).otherwise(F.col("updated_at"))}).select(nodes.columns)
    results = moves.join(conflicts, ["batch", "id"], "left").join(bad.withColumn("bad", F.lit(True)), "batch", "left")
    return out, results.select("batch", "id", F.coalesce("conflict", F.when(F.col("bad"), "not_moved").otherwise("ok")).alias("outcome"))


def trash_nodes(nodes: DataFrame, entries: DataFrame, favorites: DataFrame, reqs: DataFrame, now: Column, root: str = T.ROOT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """T-04. reqs: batch, id. Nodes, entries, favorites with changes, and batch, outcome.

    A batch that names the root or anything that isn't active does nothing. Entries are for the topmost ids alone."""
    reqs = reqs.select("batch", "id").distinct()
    narrow = cut(nodes.select("id", "parent_id", "lifecycle_state"))  # read once, for two walks
    active = narrow.where("lifecycle_state = 'active'").select("id", F.lit(True).alias("there"))
    state = reqs.join(active, "id", "left").groupBy("batch").agg(F.max(F.col("id") == root).alias("root"), F.count_if(F.col("there").isNull()).alias("missing"))
    results = state.select("batch", F.when(F.col("root"), "root_refused").when(F.col("missing") > 0, "not_found").otherwise("ok").alias("outcome"))
    wanted = reqs.join(results.where("outcome = 'ok'"), "batch").select("id").distinct()
    top = cut(T.drop_nested_selection(narrow, wanted))
    gone = T.active_subtree(narrow, top)
    mark = gone.select("id", F.lit(True).alias("_gone"))
    out = nodes.join(mark, "id", "left").withColumns({"lifecycle_state": F.when(F.col("_gone"), "trashed").otherwise(F.col("lifecycle_state")), "updated_at": F.when(F.col("_gone"), now).otherwise(F.col("updated_at"))}).select(nodes.columns)
    new = nodes.join(top, "id", "left_semi").select(_new_id(F.lit("trash"), "id").alias("id"), F.col("id").alias("node_id"), F.col("parent_id").alias("original_parent_id"), now.alias("trashed_at"), days(now, 30).alias("scheduled_purge_at"))
    return out, entries.unionByName(new), favorites.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti"), results


def restore_nodes(nodes: DataFrame, entries: DataFrame, reqs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T-05. reqs: request_id, id. Nodes and entries with changes, and request_id, id, restore_to, outcome.

    The whole trashed subtree comes back, the root of it under its parent or the catalog's root; entries of
    what lies below go as well. Two requests for one name: the first is granted."""
    ids = reqs.join(entries.select(F.col("node_id").alias("id"), "original_parent_id", F.lit(True).alias("entry")), "id", "left")
    placed = restore_parent(ids.select("request_id", F.col("id").alias("node_id"), "original_parent_id", "entry"), nodes)
    placed = placed.join(_siblings(nodes).withColumnRenamed("parent_id", "restore_to"), ["restore_to", "name"], "left")
    can = F.col("entry").isNotNull() & F.col("taken").isNull()
    placed = placed.withColumn("can", can).withColumn("first", F.row_number().over(Window.partitionBy("restore_to", "name", "can").orderBy("request_id")) == 1)
    outcome = F.when(F.col("entry").isNull(), "not_trashed").when(F.col("taken").isNotNull() | ~F.col("first"), "name_conflict").otherwise("ok")
    results = placed.select("request_id", F.col("node_id").alias("id"), "restore_to", outcome.alias("outcome"))
    back = results.where("outcome = 'ok'").select("id", "restore_to")
    tree = T.trashed_subtree(nodes, back).select("id").distinct()
    out = nodes.join(tree.withColumn("_back", F.lit(True)), "id", "left").join(back.withColumnRenamed("restore_to", "_to"), "id", "left")
    out = out.withColumns({"lifecycle_state": F.when(F.col("_back"), "active").otherwise(F.col("lifecycle_state")), "parent_id": F.coalesce("_to", "parent_id"), "updated_at": F.when(F.col("_back"), now).otherwise(F.col("updated_at"))}).select(nodes.columns)
    return out, entries.join(tree.withColumnRenamed("id", "node_id"), "node_id", "left_anti"), results


def request_permanent_deletion(nodes: DataFrame, jobs: DataFrame, reqs: DataFrame) -> DataFrame:
    """T-06. request_id, id, outcome: queued (at priority 10), already_queued, not_trashed or already_deleted."""
    busy = jobs.where(F.col("state").isin(*R.ACTIVE) & (F.col("job_type") == "permanent_deletion")).select(F.col("target_node_id").alias("id"), F.lit(True).alias("busy")).distinct()
    rows = reqs.join(nodes.select("id", "lifecycle_state"), "id", "left").join(busy, "id", "left").withColumn("first", F.row_number().over(Window.partitionBy("id").orderBy("request_id")) == 1)
    outcome = F.when(F.col("lifecycle_state").isNull(), "already_deleted").when(F.col("lifecycle_state") != "trashed", "not_trashed").when(F.col("busy") | ~F.col("first"), "already_queued").otherwise("queued")
    return rows.select("request_id", "id", outcome.alias("outcome"))


def purge(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """T-07. The tables without the trashed subtrees of ids, and the storage keys to delete. What is gone already is no error."""
    from filecat.operators.listing import storage_keys_for_deletion

    tree = T.trashed_subtree(tables["nodes"], ids)
    keys = storage_keys_for_deletion(tree, tables["file_objects"], tables["derived_artifacts"])
    gone = tree.select("id").distinct()
    columns = {"nodes": "id", "file_objects": "node_id", "jobs": "target_node_id", "metadata_records": "node_id", "media_streams": "node_id", "node_metadata": "node_id", "derived_artifacts": "node_id", "trash_entries": "node_id", "favorites": "node_id"}
    out = {t: rows.join(gone.select(F.col("id").alias(columns[t])), columns[t], "left_anti") if t in columns else rows for t, rows in tables.items()}
    for table, column in (("upload_sessions", "completed_node_id"), ("import_entries", "resulting_node_id"), ("trash_entries", "original_parent_id")):
        if table in out and column in out[table].columns:
            mark = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
            out[table] = out[table].join(mark, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(out[table].columns)
    return out, keys


def plan_work(jobs: DataFrame, reqs: DataFrame, priority: int = 0, max_attempts: int = 3) -> DataFrame:
    """T-10. Rows to add to jobs for requests (id, job_type, target_node_id, created_at)."""
    rows = R.one_active_per_key(reqs, jobs)
    return rows.select("id", "job_type", "target_node_id", F.lit("pending").alias("state"), F.lit(priority).alias("priority"), F.lit(0).alias("attempts"), F.lit(max_attempts).alias("max_attempts"), "created_at")


def enqueue_expired_trash(entries: DataFrame, nodes: DataFrame, jobs: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """T-08."""
    due = R.purge_batch(entries, nodes, jobs, now, limit).select(_new_id(F.lit("purge"), "node_id").alias("id"), F.lit("permanent_deletion").alias("job_type"), F.col("node_id").alias("target_node_id"), now.alias("created_at"))
    return plan_work(jobs, due, priority=5)


def enqueue_reprocessing(records: DataFrame, jobs: DataFrame, extractor: str, version: str, now: Column, limit: int = 10) -> DataFrame:
    """T-14."""
    old = R.reprocess_candidates(records, jobs, extractor, version, limit).select(_new_id(F.lit("reprocess"), "node_id").alias("id"), F.lit("metadata_extraction").alias("job_type"), F.col("node_id").alias("target_node_id"), now.alias("created_at"))
    return plan_work(jobs, old, priority=-100)


def add_favorites(favorites: DataFrame, nodes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """T-09. Active nodes other than the root that are no favorites yet become some."""
    new = nodes.where((F.col("lifecycle_state") == "active") & F.col("parent_id").isNotNull()).join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("node_id")).join(favorites, "node_id", "left_anti")
    return favorites.unionByName(new.withColumn("created_at", now))


def remove_favorites(favorites: DataFrame, ids: DataFrame) -> DataFrame:
    return favorites.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def backlog_plan(jobs: DataFrame, capacity_per_type: int, now: Column, lease_seconds: int = 300) -> DataFrame:
    """T-11. The jobs, those that run next leased with one more attempt."""
    chosen = R.next_jobs(jobs, capacity_per_type).select("id", F.lit(True).alias("_run"))
    rows = jobs.join(chosen, "id", "left")
    lease = now + F.make_interval(secs=F.lit(lease_seconds).cast("decimal(18,6)"))
    return rows.withColumns({"state": F.when(F.col("_run"), "leased").otherwise(F.col("state")), "attempts": F.col("attempts") + F.when(F.col("_run"), 1).otherwise(0), "lease_expires_at": F.when(F.col("_run"), lease).otherwise(F.col("lease_expires_at"))}).select(jobs.columns)


def fold_attempts(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """T-12. results: id, ok, error. Leased jobs become completed, failed (no attempts left) or pending again; the lease ends."""
    rows = jobs.join(results.select("id", "ok", "error"), "id", "left")
    hit = (F.col("state") == "leased") & F.col("ok").isNotNull()
    after = F.when(F.col("ok"), "completed").when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")
    kept = F.col("last_error") if "last_error" in jobs.columns else F.lit(None).cast("string")
    changed = {"last_error": F.when(hit & ~F.col("ok"), F.col("error")).otherwise(kept), "lease_expires_at": F.when(~hit, F.col("lease_expires_at")), "state": F.when(hit, after).otherwise(F.col("state"))}
    return rows.withColumns(changed).drop("ok", "error")


def stale_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """T-13. Jobs whose lease ended strictly before now, pending again whatever their attempts; `exhausted` tells those with none left."""
    stale = jobs.where((F.col("state") == "leased") & (F.col("lease_expires_at") < now))
    return stale.withColumns({"state": F.lit("pending"), "lease_expires_at": F.lit(None).cast("timestamp_ntz"), "exhausted": F.col("attempts") >= F.col("max_attempts")})


def admit_uploads(nodes: DataFrame, sessions: DataFrame, reqs: DataFrame, total: int, used: int, now: Column, threshold: int = 90) -> DataFrame:
    """T-15. reqs: request_id, folder_id, name, size. request_id, outcome, expires_at. Each request is measured against the volume as it is."""
    taken = nodes.where("lifecycle_state = 'active'").select(F.col("parent_id").alias("folder_id"), "name").union(sessions.where("state IN ('active', 'finalizing')").select("target_folder_id", "display_name")).distinct().withColumn("taken", F.lit(True))
    rows = reqs.join(_folders(nodes, "folder_id"), "folder_id", "left").join(taken, ["folder_id", "name"], "left")
    full = projected_percent(F.lit(total), F.lit(used), F.coalesce("size", F.lit(0))) >= threshold
    sound = (F.col("name") != "") & F.coalesce(F.col("size") >= 0, F.lit(True)) & F.col("folder").isNotNull() & F.col("taken").isNull()
    rows = rows.withColumn("sound", sound & ~full).withColumn("first", F.row_number().over(Window.partitionBy("folder_id", "name", "sound").orderBy("request_id")) == 1)
    outcome = F.when(F.col("name") == "", "invalid_name").when(F.col("size") < 0, "invalid_size").when(F.col("folder").isNull(), "folder_not_found").when(full, "disk_full").when(F.col("taken").isNotNull() | ~F.col("first"), "name_conflict").otherwise("ok")
    return rows.select("request_id", outcome.alias("outcome"), F.when(outcome == "ok", days(now, 1)).alias("expires_at"))


def _first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by session and arrival those whose range is still free. Only the current session's merged ranges are held."""
    session, taken = None, Ranges()
    for batch in batches:
        keep = []
        for own, start, end in zip(*(batch.column(c).to_pylist() for c in ("session_id", "start_byte", "end_byte"))):
            if own != session:
                session, taken = own, Ranges()
            keep.append(taken.add(start, end))
        yield batch.filter(pa.array(keep, pa.bool_()))


def apply_chunks(sessions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-16. Accepted chunks of active sessions, first come first kept; and id, received of every session.

    Sessions without an overlap need no order; the others pass their chunks in order of arrival by a set of
    sorted ranges: a binary search for each chunk, and no session is a cell of a table."""
    live = chunks.join(sessions.where("state = 'active'").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    mixed = R.overlapping_chunks(live).select("session_id").distinct()
    plain = live.join(mixed, "session_id", "left_anti").select("session_id", "id", "start_byte", "end_byte")
    arrived = live.join(mixed, "session_id", "left_semi").select("session_id", "id", "start_byte", "end_byte", "created_at")
    sorted_ = arrived.repartition("session_id").sortWithinPartitions("session_id", "created_at", "id", "start_byte", "end_byte").drop("created_at")
    folded = sorted_.mapInArrow(_first_come, "session_id string, id string, start_byte long, end_byte long")
    accepted = plain.unionByName(folded)
    sums = accepted.groupBy(F.col("session_id").alias("id")).agg(F.sum(F.col("end_byte") - F.col("start_byte") + 1).alias("received"))
    return accepted, sessions.select("id").join(sums, "id", "left").withColumn("received", F.coalesce("received", F.lit(0).cast("long")))


def finalize_uploads(nodes: DataFrame, sessions: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """T-17. sessions: those to finalize. New node rows, and id, outcome, node_id, has_gaps.

    A null expected size is always complete; sizes alone decide, has_gaps tells where bytes are missing all the same."""
    progress = R.session_progress(sessions, chunks)
    gaps = R.missing_ranges(sessions, chunks).select(F.col("session_id").alias("id"), F.lit(True).alias("gap")).distinct()
    taken = _siblings(nodes).select(F.col("parent_id").alias("target_folder_id"), F.col("name").alias("display_name"), "taken")
    rows = progress.join(gaps, "id", "left").join(taken, ["target_folder_id", "display_name"], "left").join(_folders(nodes, "target_folder_id"), "target_folder_id", "left")
    can = (F.col("state") == "active") & F.col("complete") & F.col("taken").isNull() & F.col("folder").isNotNull()
    rows = rows.withColumn("can", can).withColumn("first", F.row_number().over(Window.partitionBy("target_folder_id", "display_name", "can").orderBy("id")) == 1)
    outcome = F.when(F.col("state") == "completed", "already_completed").when(F.col("state") != "active", "not_active").when(~F.col("complete"), "incomplete").when(F.col("folder").isNull(), "folder_not_found").when(F.col("taken").isNotNull() | ~F.col("first"), "name_conflict").otherwise("ok")
    done = rows.select("id", "target_folder_id", "display_name", outcome.alias("outcome"), F.when(outcome == "ok", _new_id(F.lit("node"), "id")).alias("node_id"), F.coalesce("gap", F.lit(False)).alias("has_gaps"))
    new = done.where("outcome = 'ok'").select(F.col("node_id").alias("id"), F.col("target_folder_id").alias("parent_id"), F.col("display_name").alias("name"))
    return _node_rows(new, "file", now), done.select("id", "outcome", "node_id", "has_gaps")


def expire_sessions(sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """T-18. Sessions with those past their end expired, and the staging keys to delete."""
    past = (F.col("state") == "active") & (F.col("expires_at") < now)
    return sessions.withColumn("state", F.when(past, "expired").otherwise(F.col("state"))), sessions.where(past).select("id", "staging_key")


def upsert_import_entries(entries: DataFrame, found: DataFrame, now: Column, key: tuple[str, ...] = ("source_id", "source_path")) -> DataFrame:
    """T-21. found: source_id, source_path, source_size, source_modified_at (of several rows for one path the latest counts). New ones are
    discovered; size and time of what is found again are renewed; imported ones start anew, without node and checksum; failed ones stay failed until a retry.
    key: the columns, of both tables, that tell entries apart."""
    key = list(key)
    seen = found.groupBy(*key).agg(F.max(F.struct("source_modified_at", "source_size")).alias("s")).select(*key, F.col("s.source_size").alias("_size"), F.col("s.source_modified_at").alias("_at"), F.lit(True).alias("_seen"))
    rows = entries.join(seen, key, "full_outer")
    new, again = F.col("id").isNull(), F.col("_seen").isNotNull()
    anew = again & (F.col("state") == "imported")
    changed = {
        "id": F.coalesce("id", _new_id(*key)), "state": F.when(new | anew, "discovered").otherwise(F.col("state")), "source_size": F.when(again, F.col("_size")).otherwise(F.col("source_size")), "source_modified_at": F.when(again, F.col("_at")).otherwise(F.col("source_modified_at")),
        "source_checksum": F.when(~F.coalesce(anew, F.lit(False)), F.col("source_checksum")), "resulting_node_id": F.when(~F.coalesce(anew, F.lit(False)), F.col("resulting_node_id")), "created_at": F.when(new, now).otherwise(F.col("created_at")), "updated_at": F.when(again, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in entries.columns))


def stability(before: DataFrame, after: DataFrame, key: str = "source_path") -> DataFrame:
    """T-22. source_path, stable: the same size and time in both listings (source_path, source_size, source_modified_at). key: the column that tells files apart."""
    later = after.select(key, F.col("source_size").alias("_size"), F.col("source_modified_at").alias("_at"))
    rows = before.join(later, key, "left")
    return rows.select("source_path", (F.col("source_size").eqNullSafe(F.col("_size")) & F.col("source_modified_at").eqNullSafe(F.col("_at"))).alias("stable"))


def entry_transitions(entries: DataFrame, reqs: DataFrame) -> DataFrame:
    """T-23. reqs: id, to, message. id, outcome, state, message: importing only from stable or importing, discovered (a retry) only from failed."""
    rows = reqs.join(entries.select("id", "state"), "id", "left")
    ok = F.when(F.col("to") == "importing", F.col("state").isin("stable", "importing")).when(F.col("to") == "discovered", F.col("state") == "failed").when(F.col("to") == "imported", F.col("state") == "importing").otherwise(F.col("state").isNotNull())
    outcome = F.when(F.col("state").isNull(), "not_found").when(ok, "ok").otherwise("invalid_transition")
    return rows.select("id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("to")).otherwise(F.col("state")).alias("state"), F.when((outcome == "ok") & (F.col("to") == "failed"), F.col("message")).alias("message"))


def finalize_imports(nodes: DataFrame, entries: DataFrame, destination: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """T-24. entries: id, source_path, state. New node rows (folders and files), and id, outcome, node_id; a conflict fails its entry only."""
    ready = entries.where("state IN ('stable', 'importing')").withColumn("safe", is_safe_relative("source_path"))
    files = ready.where("safe").select("id", F.col("source_path").alias("path"), F.regexp_replace("source_path", "/?[^/]*$", "").alias("dir"), F.element_at(F.split("source_path", "/"), -1).alias("name"))
    folders = T.ensure_folder_paths(nodes, files.select("path"), destination)
    placed = files.join(folders.select(F.col("path").alias("dir"), "folder_id", F.col("outcome").alias("dir_outcome")), "dir", "left").withColumn("parent_id", F.when(F.col("dir") == "", F.lit(destination)).otherwise(F.col("folder_id")))
    placed = placed.join(_siblings(nodes), ["parent_id", "name"], "left").withColumn("first", F.row_number().over(Window.partitionBy("parent_id", "name").orderBy("id")) == 1)
    outcome = F.when(F.col("parent_id").isNull() | (F.col("dir_outcome") == "conflict"), "path_conflict").when(F.col("taken").isNotNull() | ~F.col("first"), "name_conflict").otherwise("ok")
    done = placed.select("id", "parent_id", "name", outcome.alias("outcome"), F.when(outcome == "ok", _new_id("parent_id", "name")).alias("node_id"))
    parts = F.split("path", "/")
    new_folders = folders.where("outcome = 'created'").select(F.col("folder_id").alias("id"), F.regexp_replace("path", "/?[^/]*$", "").alias("above"), F.element_at(parts, -1).alias("name"))
    new_folders = new_folders.join(folders.select(F.col("path").alias("above"), F.col("folder_id").alias("parent")), "above", "left").select("id", F.coalesce("parent", F.lit(destination)).alias("parent_id"), "name")
    made = _node_rows(new_folders, "folder", now).unionByName(_node_rows(done.where("outcome = 'ok'").select(F.col("node_id").alias("id"), "parent_id", "name"), "file", now))
    rest = entries.join(files.select("id"), "id", "left_anti").select("id", F.when(F.col("state") == "imported", "already_imported").when(F.col("state").isin("stable", "importing"), "unsafe_path").otherwise("not_ready").alias("outcome"), F.lit(None).cast("string").alias("node_id"))
    return made, done.select("id", "outcome", "node_id").unionByName(rest)


def recover_interrupted(nodes: DataFrame, entries: DataFrame, destination: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """T-25. T-24 over entries that were being imported; new nodes, outcomes, a row of the summary, and the failures (id, message)."""
    made, done = finalize_imports(nodes, entries.where("state = 'importing'"), destination, now)
    results = done.withColumn("message", F.col("outcome"))
    return made, done, R.recovery_summary(results), R.recovery_failures(results)


def plan_artifacts(files: DataFrame, artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """T-26. files: id, mime_type. id, artifact_type, plan: serve, wait, generate, queued (generate, but its job is there already) or unsupported."""
    wanted = files.crossJoin(files.sparkSession.createDataFrame([("thumbnail",), ("preview",)], "artifact_type string"))  # two types
    have = artifacts.select(F.col("node_id").alias("id"), "artifact_type", F.col("state").alias("have"))
    busy = jobs.where(F.col("state").isin(*R.ACTIVE) & (F.col("job_type") == "preview_generation")).select(F.col("target_node_id").alias("id"), F.lit(True).alias("busy")).distinct()
    rows = wanted.join(have, ["id", "artifact_type"], "left").join(busy, "id", "left")
    plan = F.when(~has_artifacts("mime_type"), "unsupported").when(F.col("have") == "ready", "serve").when(F.col("have") == "generating", "wait").when(F.col("busy"), "queued").otherwise("generate")
    return rows.select("id", "artifact_type", plan.alias("plan"))


def new_artifacts(planned: DataFrame, now: Column) -> DataFrame:
    """Rows of derived_artifacts to put in place of those with the same node and type: what is to be generated begins empty, under a new key."""
    rows = planned.where("plan IN ('generate', 'queued')")
    key = F.md5(F.concat_ws("/", "id", "artifact_type", now.cast("string")))
    return rows.select(F.concat_ws("-", F.lit("a"), "id", "artifact_type").alias("id"), F.col("id").alias("node_id"), "artifact_type", F.lit("application/octet-stream").alias("format"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), key.alias("storage_key"), F.lit(0).cast("long").alias("byte_size"), F.lit("preview-v1").alias("generator_version"), F.lit("generating").alias("state"), now.alias("created_at"), now.alias("updated_at"))


def new_preview_jobs(planned: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """id, job_type, target_node_id, state, priority, created_at of one job for each node that waits for an artifact and has no active one."""
    busy = jobs.where(F.col("state").isin(*R.ACTIVE) & (F.col("job_type") == "preview_generation")).select(F.col("target_node_id").alias("id"))
    nodes = planned.where("plan IN ('generate', 'queued', 'wait')").select("id").distinct().join(busy, "id", "left_anti")
    return nodes.select(_new_id("id").alias("id"), F.lit("preview_generation").alias("job_type"), F.col("id").alias("target_node_id"), F.lit("pending").alias("state"), F.lit(0).alias("priority"), now.alias("created_at"))


def replace_rows(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """T-27. Rows with those of the same key replaced by the new ones."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
