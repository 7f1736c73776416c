"""Schemas of the catalog's tables, their allowed values and checks of their constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "nodes": "id string, parent_id string, name string, kind string, lifecycle_state string, source_created_at timestamp_ntz, source_modified_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "file_objects": "id string, node_id string, storage_key string, byte_size long, mime_type string, checksum_sha256 string, upload_state string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "upload_sessions": "id string, target_folder_id string, display_name string, expected_byte_size long, received_bytes long, staging_key string, state string, checksum_sha256 string, completed_node_id string, source_created_at timestamp_ntz, source_modified_at timestamp_ntz, expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "upload_chunks": "id string, session_id string, start_byte long, end_byte long, created_at timestamp_ntz",
    "jobs": "id string, job_type string, target_node_id string, state string, priority int, attempts int, max_attempts int, lease_owner string, lease_expires_at timestamp_ntz, last_error string, created_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz",
    "import_sources": "id string, watch_path string, destination_folder_id string, enabled boolean, last_scan_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "import_entries": "id string, source_id string, source_path string, source_size long, source_modified_at timestamp_ntz, source_checksum string, state string, resulting_node_id string, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "metadata_records": "id string, node_id string, extractor_name string, extractor_version string, status string, raw_payload string, warnings array<string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "media_streams": "id string, node_id string, stream_index int, stream_type string, codec string, width int, height int, duration_ms long, bitrate_bps long, frame_rate string, language string, created_at timestamp_ntz",
    "node_metadata": "node_id string, detected_mime string, media_kind string, duration_ms long, width int, height int, capture_time timestamp_ntz, page_count int, orientation int, has_gps boolean, gps_latitude double, gps_longitude double, camera_make string, camera_model string, document_title string, document_author string, document_created_at timestamp_ntz, document_modified_at timestamp_ntz, updated_at timestamp_ntz",
    "derived_artifacts": "id string, node_id string, artifact_type string, format string, width int, height int, storage_key string, byte_size long, generator_version string, state string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "trash_entries": "id string, node_id string, original_parent_id string, trashed_at timestamp_ntz, scheduled_purge_at timestamp_ntz",
    "favorites": "node_id string, created_at timestamp_ntz",
}

VALUES: dict[tuple[str, str], set[str]] = {
    ("nodes", "kind"): {"folder", "file"},
    ("nodes", "lifecycle_state"): {"active", "trashed", "deleted"},
    ("file_objects", "upload_state"): {"staging", "finalized"},
    ("upload_sessions", "state"): {"active", "finalizing", "completed", "cancelled", "expired"},
    ("jobs", "job_type"): {"metadata_extraction", "preview_generation", "trash_cleanup", "permanent_deletion"},
    ("jobs", "state"): {"pending", "leased", "completed", "failed", "cancelled"},
    ("import_entries", "state"): {"discovered", "stable", "importing", "imported", "failed"},
    ("metadata_records", "status"): {"pending", "completed", "failed", "unsupported"},
    ("media_streams", "stream_type"): {"video", "audio", "subtitle"},
    ("node_metadata", "media_kind"): {"document", "image", "video", "audio", "other"},
    ("derived_artifacts", "artifact_type"): {"thumbnail", "preview"},
    ("derived_artifacts", "state"): {"generating", "ready", "failed"},
}

#: (rule, condition that a row must meet); a null condition counts as met, as in a CHECK.
CHECKS: dict[str, list[tuple[str, str]]] = {
    "nodes": [("not_own_parent", "id <> parent_id")],
    "file_objects": [("size", "byte_size >= 0"), ("finalized_has_node", "upload_state <> 'finalized' OR node_id IS NOT NULL")],
    "upload_sessions": [("name", "display_name <> ''")],
    "upload_chunks": [("range", "0 <= start_byte AND start_byte <= end_byte")],
    "import_entries": [("relative_path", "source_path <> '' AND NOT startswith(source_path, '/')")],
    "media_streams": [("sizes", "coalesce(width, 0) >= 0 AND coalesce(height, 0) >= 0 AND coalesce(duration_ms, 0) >= 0 AND coalesce(bitrate_bps, 0) >= 0")],
    "node_metadata": [("gps_pair", "(gps_latitude IS NULL) = (gps_longitude IS NULL)")],
    "trash_entries": [("purge_after_trash", "scheduled_purge_at >= trashed_at")],
}

#: (rule, key, rows it is about).
UNIQUE: dict[str, list[tuple[str, list[str], str]]] = {
    "nodes": [("sibling_name", ["parent_id", "name"], "lifecycle_state = 'active' AND parent_id IS NOT NULL")],
    "file_objects": [("one_finalized", ["node_id"], "upload_state = 'finalized'")],
    "upload_sessions": [("session_name", ["target_folder_id", "display_name"], "state IN ('active', 'finalizing')")],
    "upload_chunks": [("exact_range", ["session_id", "start_byte", "end_byte"], "true")],
    "jobs": [("one_active", ["job_type", "target_node_id"], "state IN ('pending', 'leased')")],
    "import_sources": [("watch_path", ["watch_path"], "true")],
    "import_entries": [("entry_path", ["source_id", "source_path"], "true")],
    "metadata_records": [("one_record", ["node_id", "extractor_name"], "true")],
    "media_streams": [("one_stream", ["node_id", "stream_index"], "true")],
    "node_metadata": [("one_metadata", ["node_id"], "true")],
    "derived_artifacts": [("one_artifact", ["node_id", "artifact_type"], "true")],
    "trash_entries": [("one_entry", ["node_id"], "true")],
    "favorites": [("one_favorite", ["node_id"], "true")],
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def violations(table: str, rows: DataFrame) -> DataFrame:
    """rule, n: how many rows break each rule of the table (for keys: rows beyond the first). Rules that hold are not listed."""
    tests = [(rule, F.expr(f"NOT ({cond})")) for rule, cond in CHECKS.get(table, [])]
    tests += [(f"{column}_value", ~F.col(column).isin(sorted(allowed))) for (t, column), allowed in VALUES.items() if t == table and column in rows.columns]
    out = rows.select(*(F.coalesce(c, F.lit(False)).alias(rule) for rule, c in tests)) if tests else None
    found = []
    if out is not None:
        counts = out.agg(*(F.count_if(F.col(rule)).alias(rule) for rule, _ in tests))
        found.append(counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(r) for r, _ in tests)), F.array(*(F.col(r) for r, _ in tests)))).alias("rule", "n")))
    for rule, key, where in UNIQUE.get(table, []):
        found.append(rows.where(where).groupBy(*key).count().where("count > 1").agg(F.lit(rule).alias("rule"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.where("n > 0")


def latest_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")
