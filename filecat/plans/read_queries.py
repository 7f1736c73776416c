"""Registered queries of lookups, listings, sums, queues, ranges and trees, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecat.functions import columns as C
from filecat.operators import listing as L
from filecat.operators import rollups as R
from filecat.operators import tree as T
from filecat.operators.scans import places
from filecat.plans.derived import NOW, NOW_EVENTS, Catalog, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None, more: str = "") -> Callable:
    """Registers a function of the catalog as a query, with its SQL over the derived tables."""

    def take(f: Callable[[Catalog], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck_sql(sql, more)
        return f

    return take


BASE = """base AS (SELECT n.*, coalesce(f.byte_size, 0) AS byte_size, m.media_kind, CASE WHEN n.kind = 'folder' THEN 0 ELSE 1 END AS folder_rank, v.node_id IS NOT NULL AS favorite
  FROM nodes n LEFT JOIN file_objects f ON f.node_id = n.id AND f.upload_state = 'finalized' LEFT JOIN node_metadata m ON m.node_id = n.id LEFT JOIN favorites v ON v.node_id = n.id
  WHERE n.lifecycle_state = 'active' AND n.parent_id IS NOT NULL)"""


def base(cat: Catalog) -> DataFrame:
    return L.listing_base(cat.nodes, cat.file_objects, cat.node_metadata)


def pages_sql(key: str, direction: str, where: str, limit: int) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY folder_rank, {key} {direction}, id) AS rank, count(*) OVER (PARTITION BY parent_id) AS n FROM base WHERE {where}"
    return f"SELECT parent_id, id, name, byte_size, favorite, CAST(rank AS BIGINT) AS rank, n > {limit} AS has_more FROM ({ranked}) x WHERE rank <= {limit}"


def page(cat: Catalog, **how) -> DataFrame:
    rows = L.favorite_flags(L.children_pages(base(cat), **how), cat.favorites)
    return rows.select("parent_id", "id", "name", "byte_size", "favorite", F.col("rank").cast("long").alias("rank"), "has_more")


@registered(pages_sql("name", "ASC", "true", 50), BASE)
def children_page_name(cat):
    return page(cat)


@registered(pages_sql("byte_size", "DESC", "true", 20), BASE)
def children_page_size_desc(cat):
    return page(cat, sort="size", order="desc", limit=20)


@registered(pages_sql("updated_at", "ASC", "kind = 'folder' OR media_kind IN ('image', 'audio')", 10), BASE)
def children_page_kind_filter(cat):
    return page(cat, sort="modified", kinds="folder, image,audio", limit=10)


@registered(pages_sql("created_at", "DESC", "true", 100), BASE)
def children_pages_all_folders(cat):
    return page(cat, sort="created", order="desc", limit=1000)


CURSORS = ", cursors AS (SELECT parent_id, max_by(id, rank) AS cursor_id FROM (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY folder_rank, name, id) AS rank FROM base) y WHERE rank <= 5 GROUP BY parent_id)"


@registered("SELECT x.parent_id, id, CAST(rank AS BIGINT) AS rank FROM (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY folder_rank, name, id) AS rank FROM base) x WHERE rank > 5", BASE)
def keyset_page(cat):
    rows = base(cat)
    ends = L.children_pages(rows, limit=5).groupBy("parent_id").agg(F.max_by("id", "rank").alias("cursor_id"))
    own = L.Window.partitionBy("parent_id").orderBy("folder_rank", "name", "id")
    return L.after_cursor(rows, ends).select("parent_id", "id", (F.row_number().over(own) + 5).cast("long").alias("rank"))


@registered("SELECT c.id, c.parent_id, c.name FROM nodes c JOIN nodes p ON c.parent_id = p.id WHERE c.lifecycle_state = 'active' AND p.id LIKE 'n%'")
def list_children(cat):
    return L.list_children(cat.nodes, cat.sql("SELECT id FROM nodes WHERE id LIKE 'n%'")).select("id", "parent_id", "name")


@registered("SELECT id, name, lifecycle_state FROM nodes WHERE id IN (SELECT concat('c', o_custkey) FROM orders)")
def nodes_by_id(cat):
    return L.nodes_by_id(cat.nodes, cat.sql("SELECT concat('c', o_custkey) AS id FROM orders")).select("id", "name", "lifecycle_state")


@registered("SELECT c.id, CAST((c.c + 1) % 25 AS INTEGER) AS nation, EXISTS (SELECT 1 FROM nodes n WHERE n.lifecycle_state = 'active' AND n.parent_id = concat('n', (c.c + 1) % 25) AND n.name = c.name) AS name_taken FROM (SELECT concat('c', c_custkey) AS id, c_nationkey AS c, folder_name AS name FROM customer_nodes) c")
def child_name_exists(cat):
    reqs = cat.sql("SELECT concat('c', c_custkey) AS id, CAST((c_nationkey + 1) % 25 AS INTEGER) AS nation, concat('n', (c_nationkey + 1) % 25) AS parent_id, folder_name AS name FROM customer_nodes")
    return L.child_name_exists(cat.nodes, reqs).select("id", "nation", "name_taken")


@registered("SELECT DISTINCT concat('c', o_custkey) AS id, c.state = 'active' AS \"exists\" FROM orders JOIN customer_nodes c ON o_custkey = c_custkey")
def active_folder_exists(cat):
    return L.active_exists(cat.nodes, cat.sql("SELECT DISTINCT concat('c', o_custkey) AS id FROM orders"), "folder")


@registered("SELECT concat('o', o_orderkey) AS id, state = 'active' AS \"exists\" FROM order_nodes")
def active_file_exists(cat):
    return L.active_exists(cat.nodes, cat.sql("SELECT concat('o', o_orderkey) AS id FROM orders"), "file")


STATUS = """status AS (SELECT node_id, CASE WHEN active > 0 THEN 'processing' WHEN ok > 0 AND bad > 0 THEN 'partially_processed' WHEN failed > 0 OR bad > 0 THEN 'failed' WHEN ok > 0 THEN 'ready' ELSE 'processing' END AS processing_status
  FROM (SELECT node_id, count(*) FILTER (WHERE src = 'j' AND state IN ('pending', 'leased')) AS active, count(*) FILTER (WHERE src = 'r' AND state IN ('completed', 'unsupported')) AS ok, count(*) FILTER (WHERE src = 'r' AND state = 'failed') AS bad, count(*) FILTER (WHERE src = 'j' AND state = 'failed') AS failed
    FROM (SELECT target_node_id AS node_id, 'j' AS src, state FROM jobs UNION ALL SELECT node_id, 'r', status FROM metadata_records) u GROUP BY node_id) s)"""


@registered("SELECT * FROM status", STATUS)
def processing_status(cat):
    return R.processing_status(cat.jobs, cat.metadata_records)


@registered("SELECT n.id, n.name, f.byte_size, f.mime_type, m.media_kind, coalesce(s.processing_status, 'processing') AS processing_status FROM nodes n JOIN file_objects f ON f.node_id = n.id AND f.upload_state = 'finalized' LEFT JOIN node_metadata m ON m.node_id = n.id LEFT JOIN status s ON s.node_id = n.id WHERE n.kind = 'file' AND n.lifecycle_state = 'active'", STATUS)
def file_details(cat):
    return L.file_details(cat.nodes, cat.file_objects, cat.node_metadata, cat.jobs, cat.metadata_records).select("id", "name", "byte_size", "mime_type", "media_kind", "processing_status")


@registered("SELECT n.id, n.name, f.byte_size, f.storage_key FROM nodes n JOIN file_objects f ON f.node_id = n.id WHERE f.upload_state = 'finalized' AND n.lifecycle_state = 'active'")
def downloadable_files(cat):
    return L.downloadable_files(cat.nodes, cat.file_objects).select("id", "name", "byte_size", "storage_key")


@registered("SELECT t.node_id, n.name, epoch_us(t.trashed_at) AS trashed_us, CAST(row_number() OVER (ORDER BY t.trashed_at DESC, n.name, t.node_id) AS BIGINT) AS place FROM trash_entries t JOIN nodes n ON n.id = t.node_id AND n.lifecycle_state = 'trashed'")
def list_trash(cat):
    listed = places(L.list_trash(cat.trash_entries, cat.nodes), [F.desc("trashed_at"), F.asc("name"), F.asc("node_id")], "place")
    return listed.select("node_id", "name", C.micros("trashed_at").alias("trashed_us"), "place")


@registered("SELECT v.node_id, n.name, epoch_us(v.created_at) AS created_us FROM favorites v JOIN nodes n ON n.id = v.node_id AND n.lifecycle_state = 'active'")
def list_favorites(cat):
    return L.list_favorites(cat.favorites, cat.nodes).select("node_id", "name", C.micros("created_at").alias("created_us"))


@registered("SELECT s.id, count(e.id) FILTER (WHERE state = 'discovered') AS discovered, count(e.id) FILTER (WHERE state = 'stable') AS stable, count(e.id) FILTER (WHERE state = 'importing') AS importing, count(e.id) FILTER (WHERE state = 'imported') AS imported, count(e.id) FILTER (WHERE state = 'failed') AS failed FROM import_sources s LEFT JOIN import_entries e ON e.source_id = s.id GROUP BY s.id")
def import_source_status(cat):
    return L.import_source_status(cat.import_sources, cat.import_entries).select("id", "discovered", "stable", "importing", "imported", "failed")


@registered("SELECT id, source_id, source_size, epoch_us(updated_at) AS updated_us FROM import_entries WHERE state = 'failed'")
def import_entries_failed(cat):
    return L.import_entries(cat.import_entries, "failed").select("id", "source_id", "source_size", C.micros("updated_at").alias("updated_us"))


@registered("SELECT id, state, epoch_us(created_at) AS created_us FROM import_entries WHERE state IN ('discovered', 'stable', 'importing')")
def pending_entries(cat):
    return L.pending_entries(cat.import_entries).select("id", "state", C.micros("created_at").alias("created_us"))


@registered("SELECT id, source_path FROM import_entries WHERE state = 'importing'")
def interrupted_entries(cat):
    return L.interrupted_entries(cat.import_entries).select("id", "source_path")


@registered("SELECT s.id, s.display_name FROM upload_sessions s JOIN nodes n ON s.target_folder_id = n.id WHERE s.state = 'active' AND n.lifecycle_state = 'active'")
def active_sessions(cat):
    return L.active_sessions(cat.upload_sessions, cat.sql("SELECT id FROM nodes WHERE lifecycle_state = 'active'")).select("id", "display_name")


@registered(f"SELECT id, staging_key, epoch_us(expires_at) AS expires_us FROM upload_sessions WHERE state = 'active' AND expires_at < TIMESTAMP '{NOW}'")
def expired_sessions(cat):
    return L.expired_sessions(cat.upload_sessions, C.at(NOW)).select("id", "staging_key", C.micros("expires_at").alias("expires_us"))


@registered("SELECT r.node_id, r.extractor_name, r.extractor_version, r.status FROM metadata_records r JOIN nodes n ON n.id = r.node_id WHERE n.lifecycle_state = 'active'")
def metadata_records(cat):
    return L.metadata_records(cat.metadata_records, cat.sql("SELECT id FROM nodes WHERE lifecycle_state = 'active'")).select("node_id", "extractor_name", "extractor_version", "status")


@registered("SELECT id, node_id, state FROM derived_artifacts WHERE node_id IN (SELECT node_id FROM favorites)")
def artifacts_for(cat):
    return L.rows_for(cat.derived_artifacts, cat.favorites, "node_id").select("id", "node_id", "state")


@registered(f"SELECT sum(CASE WHEN lifecycle_state = 'active' THEN byte_size ELSE 0 END)::BIGINT AS active_bytes, sum(CASE WHEN lifecycle_state = 'trashed' THEN byte_size ELSE 0 END)::BIGINT AS trashed_bytes, (SELECT sum(byte_size)::BIGINT FROM derived_artifacts WHERE state = 'ready') AS artifact_bytes, CAST(85.0 AS DOUBLE) AS volume_percent FROM file_objects f JOIN nodes n ON n.id = f.node_id WHERE upload_state = 'finalized'")
def storage_usage(cat):
    return R.storage_usage(cat.nodes, cat.file_objects, cat.derived_artifacts, total=1000, used=850)


@registered("SELECT count(*) AS n FROM jobs WHERE state IN ('pending', 'leased')")
def job_count(cat):
    return R.job_count(cat.jobs, " pending, ,leased ")


@registered("SELECT s.id, coalesce(received, 0)::BIGINT AS received, coalesce(ranges, '') AS ranges, s.expected_byte_size = coalesce(received, 0) AS complete FROM upload_sessions s LEFT JOIN (SELECT session_id, sum(end_byte - start_byte + 1) AS received, string_agg(concat(start_byte, '-', end_byte), ',' ORDER BY start_byte, end_byte) AS ranges FROM upload_chunks GROUP BY session_id) c ON c.session_id = s.id")
def session_progress(cat):
    rows = R.session_progress(cat.upload_sessions, cat.upload_chunks)
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start_byte"].cast("string"), r["end_byte"].cast("string"))), ",")
    return rows.select("id", "received", F.coalesce(text, F.lit("")).alias("ranges"), "complete")


# --- queues and ranges


@registered("SELECT job_type, id, CAST(priority AS INTEGER) AS priority, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY priority DESC, created_at, id) AS rank FROM jobs WHERE state = 'pending') x WHERE rank <= 20")
def next_jobs(cat):
    return R.next_jobs(cat.jobs, 20).select("job_type", "id", "priority", F.col("rank").cast("long").alias("rank"))


@registered("SELECT id, job_type, CAST(row_number() OVER (ORDER BY CASE job_type WHEN 'permanent_deletion' THEN 0 WHEN 'trash_cleanup' THEN 1 WHEN 'metadata_extraction' THEN 2 ELSE 3 END, priority DESC, created_at, id) AS BIGINT) AS rank FROM jobs WHERE state = 'pending' QUALIFY rank <= 100")
def claim_order(cat):
    return R.claim_order(cat.jobs, 100).select("id", "job_type", F.col("rank").cast("long").alias("rank"))


@registered("SELECT node_id, extractor_version FROM (SELECT * FROM metadata_records WHERE extractor_name = 'exiftool' AND extractor_version <> 'adapter-v1' ORDER BY updated_at, node_id LIMIT 200) x WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.target_node_id = x.node_id AND j.job_type = 'metadata_extraction' AND j.state IN ('pending', 'leased'))")
def reprocess_candidates(cat):
    return R.reprocess_candidates(cat.metadata_records, cat.jobs, "exiftool", "adapter-v1", limit=200).select("node_id", "extractor_version")


DUE = f"FROM trash_entries t JOIN nodes n ON n.id = t.node_id AND n.lifecycle_state = 'trashed' WHERE t.scheduled_purge_at <= TIMESTAMP '{NOW}'"
BUSY = "NOT EXISTS (SELECT 1 FROM jobs j WHERE j.target_node_id = t.node_id AND j.job_type = 'permanent_deletion' AND j.state IN ('pending', 'leased'))"


@registered(f"SELECT t.node_id, CAST(row_number() OVER (ORDER BY t.scheduled_purge_at, t.node_id) AS BIGINT) AS rank {DUE} AND {BUSY} QUALIFY rank <= 50")
def purge_batch(cat):
    return R.purge_batch(cat.trash_entries, cat.nodes, cat.jobs, C.at(NOW)).select("node_id", F.col("rank").cast("long").alias("rank"))


@registered(f"SELECT t.node_id {DUE}")
def expired_trash(cat):
    return R.expired_trash(cat.trash_entries, cat.nodes, C.at(NOW)).select("node_id")


@registered(f"SELECT t.node_id {DUE} AND {BUSY}")
def expired_without_job(cat):
    return R.expired_without_job(cat.trash_entries, cat.nodes, cat.jobs, C.at(NOW)).select("node_id")


@registered(
    """SELECT session_id, CAST(f AS BIGINT) AS start_byte, CAST(start_byte - 1 AS BIGINT) AS end_byte FROM (
  SELECT session_id, start_byte, coalesce(max(end_byte) OVER (PARTITION BY session_id ORDER BY start_byte, end_byte, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS f FROM (
    SELECT c.session_id, c.start_byte, c.end_byte, c.id FROM upload_chunks c JOIN upload_sessions s ON s.id = c.session_id WHERE c.start_byte < s.expected_byte_size
    UNION ALL SELECT id, expected_byte_size, expected_byte_size, '' FROM upload_sessions) u) w WHERE start_byte > f"""
)
def missing_ranges(cat):
    return R.missing_ranges(cat.upload_sessions, cat.upload_chunks)


@registered("SELECT DISTINCT b.id, b.session_id, b.start_byte, b.end_byte FROM upload_chunks a JOIN upload_chunks b ON a.session_id = b.session_id AND (a.start_byte, a.end_byte, a.id) < (b.start_byte, b.end_byte, b.id) AND b.start_byte <= a.end_byte")
def overlapping_chunks(cat):
    return R.overlapping_chunks(cat.upload_chunks).select("id", "session_id", "start_byte", "end_byte")


@registered("SELECT id AS request_id, EXISTS (SELECT 1 FROM upload_chunks c WHERE c.session_id = s.id AND c.start_byte <= 2600 AND c.end_byte >= 2400) AS overlaps FROM upload_sessions s")
def range_overlap_requests(cat):
    reqs = cat.upload_sessions.select(F.col("id").alias("request_id"), F.col("id").alias("session_id"), F.lit(2400).alias("start"), F.lit(2600).alias("end"))
    return R.range_overlaps(cat.upload_chunks, reqs)


@registered("SELECT job_type, target_node_id, min_by(id, (created_at, id)) AS id FROM job_requests WHERE state IN ('pending', 'leased') GROUP BY job_type, target_node_id")
def one_active_per_key(cat):
    return R.one_active_per_key(cat.job_requests.where("state IN ('pending', 'leased')")).select("job_type", "target_node_id", "id")


# --- scalar functions


@registered("SELECT o_orderkey, media_kind, extractor, CASE WHEN mime = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' THEN 'generated' WHEN mime LIKE 'image/%' OR mime LIKE 'video/%' OR mime LIKE 'audio/%' OR mime = 'application/pdf' THEN 'native' ELSE 'unsupported' END AS route FROM order_nodes")
def scalar_media_kind(cat):
    return cat.order_nodes.select("o_orderkey", C.media_kind("mime").alias("media_kind"), C.extractor_for("mime").alias("extractor"), C.preview_route("mime").alias("route"))


HEADER = "CASE o_orderkey % 6 WHEN 0 THEN concat('bytes=', o_orderkey % 50, '-', o_orderkey % 70) WHEN 1 THEN concat('bytes=', o_orderkey % 120, '-') WHEN 2 THEN concat('bytes=-', o_orderkey % 130) WHEN 3 THEN 'bytes=0-1,3-4' WHEN 4 THEN 'bytes=-' ELSE concat('items=', o_orderkey) END"


@registered(
    f"""SELECT k AS o_orderkey, CASE WHEN ok THEN s END AS first_byte, CASE WHEN ok THEN e END AS last_byte FROM (SELECT k, s, e, (f IS NOT NULL OR l > 0) AND s < n AND e >= s AND n > 0 AND (f IS NULL OR l IS NULL OR l >= f) AND (f IS NOT NULL OR l IS NOT NULL) AS ok FROM (
  SELECT k, n, f, l, CASE WHEN f IS NULL THEN greatest(n - l, 0) ELSE f END AS s, CASE WHEN f IS NULL OR l IS NULL THEN n - 1 ELSE least(l, n - 1) END AS e FROM (
  SELECT o_orderkey AS k, o_orderkey % 101 AS n, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 50 WHEN 1 THEN o_orderkey % 120 END AS f, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 70 WHEN 2 THEN o_orderkey % 130 END AS l FROM orders) a) b) c"""
)
def scalar_byte_range(cat):
    rows = cat.sql(f"SELECT o_orderkey, o_orderkey % 101 AS n, {HEADER} AS h FROM orders").withColumn("r", C.parse_byte_range("h", "n"))
    return rows.select("o_orderkey", F.col("r.start").cast("long").alias("first_byte"), F.col("r.end").cast("long").alias("last_byte"))


CONTENT = "CASE o_orderkey % 4 WHEN 0 THEN concat('bytes ', o_orderkey % 50, '-', o_orderkey % 70, '/', o_orderkey % 90) WHEN 1 THEN concat('bytes ', o_orderkey % 50, '-', o_orderkey % 70, '/*') WHEN 2 THEN 'bytes 1-2' ELSE 'bytes a-b/c' END"


@registered("SELECT o_orderkey, CASE WHEN ok THEN a END AS first_byte, CASE WHEN ok THEN b END AS last_byte, CASE WHEN ok THEN t END AS total FROM (SELECT o_orderkey, a, b, CASE WHEN m = 0 THEN t END AS t, m < 2 AND b >= a AND (m = 1 OR t > b) AS ok FROM (SELECT o_orderkey, o_orderkey % 4 AS m, o_orderkey % 50 AS a, o_orderkey % 70 AS b, o_orderkey % 90 AS t FROM orders) x) y")
def scalar_content_range(cat):
    rows = cat.sql(f"SELECT o_orderkey, {CONTENT} AS h FROM orders").withColumn("r", C.parse_content_range("h"))
    return rows.select("o_orderkey", F.col("r.start").alias("first_byte"), F.col("r.end").alias("last_byte"), F.col("r.total").alias("total"))


@registered(
    """SELECT id, CASE WHEN kind = 'folder' OR b IS NULL THEN '—' WHEN b < 1000 THEN concat(b, ' B') WHEN b < 1000000 THEN concat(CASE WHEN b < 10000 THEN concat((b + 50) // 100 // 10, '.', (b + 50) // 100 % 10) ELSE concat((b + 500) // 1000) END, ' KB')
  ELSE concat(CASE WHEN b < 10000000 THEN concat((b + 50000) // 1000000, '.', (b + 50000) // 100000 % 10) ELSE concat((b + 500000) // 1000000) END, ' MB') END AS shown FROM (SELECT n.id, n.kind, f.byte_size AS b FROM nodes n LEFT JOIN file_objects f ON f.node_id = n.id UNION ALL SELECT concat('small', o_orderkey), 'file', CAST(o_orderkey % 12000 AS BIGINT) FROM orders) x"""
)
def scalar_format_size(cat):
    rows = cat.nodes.join(cat.file_objects.select(F.col("node_id").alias("id"), "byte_size"), "id", "left").select("id", "kind", "byte_size")
    rows = rows.union(cat.sql("SELECT concat('small', o_orderkey), 'file', CAST(o_orderkey % 12000 AS BIGINT) FROM orders"))
    return rows.select("id", C.format_size("byte_size", "kind").alias("shown"))


@registered("SELECT p_partkey, translate(concat(p_name, chr(13), '\"', p_brand, chr(92), p_type), concat(chr(13), '\"', chr(92)), '___') AS safe FROM part")
def scalar_safe_filename(cat):
    return cat.sql("SELECT p_partkey, concat(p_name, char(13), '\"', p_brand, char(92), p_type) AS raw FROM part").select("p_partkey", C.safe_filename("raw").alias("safe"))


@registered("SELECT o_orderkey, coalesce((u + 50) * 100 // nullif(t, 0), 100) AS percent, coalesce((u + 50) * 100 // nullif(t, 0), 100) >= 90 AS exceeded, coalesce(CAST(u * 1000 // nullif(t, 0) AS DOUBLE) / 10, 0) AS used_percent FROM (SELECT o_orderkey, o_orderkey % 1000 AS t, o_orderkey % 900 AS u FROM orders) x")
def disk_guard(cat):
    rows = cat.sql("SELECT o_orderkey, o_orderkey % 1000 AS t, o_orderkey % 900 AS u FROM orders")
    return rows.select("o_orderkey", C.projected_percent("t", "u", F.lit(50)).alias("percent"), C.guard_exceeded("t", "u", F.lit(50)).alias("exceeded"), C.disk_usage_percent("t", "u").alias("used_percent"))


# --- trees


PATHS = "paths(id, ids, path, active) AS (SELECT id, [id], '', true FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, list_append(p.ids, n.id), concat(p.path, '/', n.name), p.active AND n.lifecycle_state = 'active' FROM paths p JOIN nodes n ON n.parent_id = p.id)"


@registered("SELECT n.id AS node_id, a.id AS ancestor_id, CAST(len(p.ids) - list_position(p.ids, a.id) AS BIGINT) AS distance FROM nodes n JOIN paths p ON p.id = n.id, unnest(p.ids) AS u(aid) JOIN nodes a ON a.id = u.aid WHERE n.kind = 'folder' AND n.lifecycle_state = 'active'", PATHS)
def ancestors(cat):
    return T.ancestors(cat.nodes, cat.sql("SELECT id FROM nodes WHERE kind = 'folder'")).withColumn("distance", F.col("distance").cast("long"))


@registered("SELECT u.rid AS root_id, p.id FROM paths p, unnest(p.ids) AS u(rid) WHERE u.rid LIKE 'r%' AND u.rid <> 'root' AND u.rid <> p.id AND p.active", PATHS)
def active_descendants(cat):
    return T.active_descendants(cat.nodes, cat.sql("SELECT concat('r', r_regionkey) AS id FROM region")).select("root_id", "id")


@registered("SELECT DISTINCT p.id FROM paths p, unnest(p.ids) AS u(rid) WHERE u.rid IN ('r0', 'n0', 'n7', 'c4') AND p.active", PATHS)
def active_subtree(cat):
    return T.active_subtree(cat.nodes, cat.sql("SELECT * FROM (VALUES ('r0'), ('n0'), ('n7'), ('c4')) AS v(id)"))


@registered("SELECT u.rid AS root_id, p.id FROM paths p, unnest(p.ids) AS u(rid) JOIN trash_entries t ON t.node_id = u.rid", PATHS)
def trashed_subtree(cat):
    return T.trashed_subtree(cat.nodes, cat.sql("SELECT node_id AS id FROM trash_entries")).select("root_id", "id")


@registered("SELECT p.id AS node_id, u.aid AS ancestor_id FROM paths p, unnest(p.ids) AS u(aid) WHERE p.id LIKE 'c%' AND u.aid <> p.id", PATHS)
def ancestor_pairs(cat):
    return T.ancestor_pairs(cat.nodes, cat.sql("SELECT id FROM nodes WHERE id LIKE 'c%'")).select("node_id", "ancestor_id")


SELECTED = "SELECT concat('c', c_custkey) AS id FROM customer_nodes WHERE state = 'active' AND c_custkey % 31 = 0 UNION ALL SELECT concat('o', o_orderkey) FROM order_nodes WHERE state = 'active' AND o_custkey % 62 = 0 UNION ALL SELECT concat('o', o_orderkey) FROM order_nodes WHERE state = 'active' AND o_orderkey % 701 = 0"


@registered("SELECT DISTINCT s.id FROM s JOIN paths p ON p.id = s.id WHERE NOT EXISTS (SELECT 1 FROM unnest(p.ids) AS u(aid) JOIN s x ON x.id = u.aid WHERE u.aid <> s.id)", PATHS + f", s AS ({SELECTED})")
def drop_nested_selection(cat):
    return T.drop_nested_selection(cat.nodes, cat.sql(SELECTED))


MOVES = "SELECT concat('n', (c_nationkey + c_custkey % 3) % 25) AS id, concat('c', c_custkey) AS target_id FROM customer UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey) FROM nation UNION ALL SELECT concat('r', (n_regionkey + 1) % 5), concat('n', n_nationkey) FROM nation UNION ALL SELECT concat('n', n_nationkey), concat('n', n_nationkey) FROM nation"


@registered("SELECT m.id, m.target_id, list_contains(p.ids, m.id) AS cycle FROM m JOIN paths p ON p.id = m.target_id", PATHS + f", m AS ({MOVES})")
def cycle_check(cat):
    return T.cycle_check(cat.nodes, cat.sql(MOVES))


@registered("SELECT id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM paths", PATHS)
def virtual_path(cat):
    return T.virtual_path(T.with_paths(cat.nodes))


@registered("SELECT concat('q', c_custkey) AS request_id, CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'root' WHEN 1 THEN concat('n', c_nationkey) ELSE CASE WHEN state = 'active' THEN concat('c', c_custkey) END END AS node_id FROM customer_nodes")
def resolve_paths(cat):
    reqs = cat.sql("SELECT concat('q', c_custkey) AS request_id, CASE c_custkey % 4 WHEN 0 THEN concat('./', n_name, '/ ', folder_name, ' /.') WHEN 1 THEN concat('/', r_name, '/x/../', n_name) WHEN 2 THEN '../../..' ELSE 'no/such' END AS path, concat('/', r_name) AS cwd FROM customer_nodes JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    return T.resolve_paths(cat.nodes, reqs)


@registered("SELECT u.rid AS root_id, p.id, f.storage_key, coalesce(a.keys, '') AS artifact_keys FROM paths p, unnest(p.ids) AS u(rid) JOIN trash_entries t ON t.node_id = u.rid LEFT JOIN file_objects f ON f.node_id = p.id AND f.upload_state = 'finalized' LEFT JOIN (SELECT node_id, string_agg(storage_key, ',' ORDER BY storage_key) AS keys FROM derived_artifacts GROUP BY node_id) a ON a.node_id = p.id", PATHS)
def storage_keys_for_deletion(cat):
    tree = T.trashed_subtree(cat.nodes, cat.sql("SELECT node_id AS id FROM trash_entries"))
    return L.storage_keys_for_deletion(tree, cat.file_objects, cat.derived_artifacts).withColumn("artifact_keys", F.array_join("artifact_keys", ","))


ODD_PATHS = "CASE page_id % 6 WHEN 0 THEN concat('.hidden/', source_path) WHEN 1 THEN concat('a/../', source_path) WHEN 2 THEN concat('/', source_path) WHEN 3 THEN concat('x/.', source_path) WHEN 4 THEN '' ELSE source_path END"


@registered(f"SELECT id, p LIKE '.%' OR p LIKE '%/.%' AS is_hidden, p <> '' AND p NOT LIKE '/%' AND concat('/', p, '/') NOT LIKE '%/../%' AS is_safe, array_to_string(string_split(p, '/')[1:-2], '/') AS dirs, string_split(p, '/')[-1] AS name FROM (SELECT id, {ODD_PATHS} AS p FROM import_entries) x")
def scalar_paths(cat):
    parts = F.col("s")
    rows = cat.sql(f"SELECT id, {ODD_PATHS} AS p FROM import_entries").withColumn("s", C.split_dir_name("p"))
    return rows.select("id", C.is_hidden("p").alias("is_hidden"), C.is_safe_relative("p").alias("is_safe"), F.array_join(parts["dirs"], "/").alias("dirs"), parts["name"].alias("name"))


@registered(
    """SELECT o_orderkey, CASE WHEN ms IS NULL THEN '—' ELSE concat((ms + 500) // 1000 // 60, ':', lpad(CAST((ms + 500) // 1000 % 60 AS VARCHAR), 2, '0')) END AS shown, ms // 10 AS seek_ms, CASE WHEN p >= 90 THEN 'error' WHEN p >= 80 THEN 'warning' ELSE 'none' END AS severity, replace(uuid, '-', '') AS storage_key, name <> '' AS is_valid,
  CAST(CASE WHEN greatest(w, h) <= 256 THEN w ELSE greatest(1, (w * 512 + greatest(w, h)) // (greatest(w, h) * 2)) END AS INTEGER) AS width, CAST(CASE WHEN greatest(w, h) <= 256 THEN h ELSE greatest(1, (h * 512 + greatest(w, h)) // (greatest(w, h) * 2)) END AS INTEGER) AS height
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey * 137 % 9000000 AS BIGINT) END AS ms, o_orderkey % 101 AS p, concat(o_orderkey, '-aa-', o_custkey) AS uuid, CASE WHEN o_orderkey % 8 > 0 THEN o_orderstatus ELSE '' END AS name, CAST(o_orderkey % 700 + 1 AS BIGINT) AS w, CAST(o_orderkey % 900 + 1 AS BIGINT) AS h FROM orders) x"""
)
def scalar_display(cat):
    rows = cat.sql("SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey * 137 % 9000000 AS BIGINT) END AS ms, o_orderkey % 101 AS p, concat(o_orderkey, '-aa-', o_custkey) AS uuid, CASE WHEN o_orderkey % 8 > 0 THEN o_orderstatus ELSE '' END AS name, CAST(o_orderkey % 700 + 1 AS BIGINT) AS w, CAST(o_orderkey % 900 + 1 AS BIGINT) AS h FROM orders")
    box = C.fit_box("w", "h")
    return rows.select("o_orderkey", C.format_duration("ms").alias("shown"), C.thumbnail_seek_ms("ms").alias("seek_ms"), C.storage_severity("p").alias("severity"), C.storage_key("uuid").alias("storage_key"), C.valid_name("name").alias("is_valid"), box["width"].alias("width"), box["height"].alias("height"))


@registered("SELECT 'session' AS what, id FROM upload_sessions WHERE target_folder_id IN (SELECT parent_id FROM nodes n JOIN favorites f ON f.node_id = n.id) UNION ALL SELECT 'object', id FROM file_objects WHERE node_id IN (SELECT node_id FROM favorites) UNION ALL SELECT 'source', CAST(id AS VARCHAR) FROM import_sources WHERE id IN (SELECT source_id FROM import_entries WHERE state = 'failed')")
def lookups_for(cat):
    folders = cat.nodes.join(cat.favorites.select(F.col("node_id").alias("id")), "id", "left_semi").select(F.col("parent_id").alias("target_folder_id")).distinct()
    failed = cat.import_entries.where("state = 'failed'").select(F.col("source_id").alias("id")).distinct()
    found = (("session", L.rows_for(cat.upload_sessions, folders, "target_folder_id")), ("object", L.rows_for(cat.file_objects, cat.favorites, "node_id")), ("source", L.rows_for(cat.import_sources, failed, "id")))
    own = [rows.select(F.lit(what).alias("what"), F.col("id").cast("string").alias("id")) for what, rows in found]
    return own[0].union(own[1]).union(own[2])
