"""Sums, windows over byte ranges and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.operators.scans import max_before

ACTIVE = ("pending", "leased")
#: Job types in the order in which they are served, whatever their priority.
PRECEDENCE = ["permanent_deletion", "trash_cleanup", "metadata_extraction", "preview_generation"]


def processing_status(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """node_id, processing_status from the states of its jobs and of its metadata records."""
    work = jobs.select(F.col("target_node_id").alias("node_id"), F.lit("job").alias("source"), "state").unionByName(records.select("node_id", F.lit("record").alias("source"), F.col("status").alias("state")))
    job, record = F.col("source") == "job", F.col("source") == "record"
    sums = work.groupBy("node_id").agg(
        F.count_if(job & F.col("state").isin(*ACTIVE)).alias("active"), F.count_if(record & F.col("state").isin("completed", "unsupported")).alias("ok"),
        F.count_if(record & (F.col("state") == "failed")).alias("failed_records"), F.count_if(job & (F.col("state") == "failed")).alias("failed_jobs"),
    )
    status = F.when(F.col("active") > 0, "processing").when((F.col("ok") > 0) & (F.col("failed_records") > 0), "partially_processed").when((F.col("failed_jobs") > 0) | (F.col("failed_records") > 0), "failed").when(F.col("ok") > 0, "ready").otherwise("processing")
    return sums.select("node_id", status.alias("processing_status"))


def storage_usage(nodes: DataFrame, objects: DataFrame, artifacts: DataFrame, total: int, used: int) -> DataFrame:
    """One row: bytes of active and of trashed files, of ready artifacts, and the volume's percent in use."""
    files = objects.where("upload_state = 'finalized'").join(nodes.select(F.col("id").alias("node_id"), "lifecycle_state"), "node_id")
    of = lambda state: F.coalesce(F.sum(F.when(F.col("lifecycle_state") == state, F.col("byte_size"))), F.lit(0).cast("long"))
    one = files.agg(of("active").alias("active_bytes"), of("trashed").alias("trashed_bytes"))
    other = artifacts.agg(F.coalesce(F.sum(F.when(F.col("state") == "ready", F.col("byte_size"))), F.lit(0).cast("long")).alias("artifact_bytes"))
    return one.crossJoin(other).withColumn("volume_percent", F.lit(100.0 * used / total if total else 0.0))  # two rows of sums


def job_count(jobs: DataFrame, states: str = "pending,leased") -> DataFrame:
    return jobs.where(F.col("state").isin([s.strip() for s in states.split(",") if s.strip()])).agg(F.count("*").alias("n"))


def session_progress(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sessions with received bytes, ordered ranges and whether all expected bytes are there (unknown: null expected is complete)."""
    own = chunks.groupBy(F.col("session_id").alias("id")).agg(F.sum(F.col("end_byte") - F.col("start_byte") + 1).alias("received"), F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias("ranges"))
    rows = sessions.join(own, "id", "left").withColumn("received", F.coalesce("received", F.lit(0).cast("long")))
    return rows.withColumn("complete", F.coalesce(F.col("expected_byte_size") == F.col("received"), F.lit(True)))


def batch_duplicate_names(moves: DataFrame) -> DataFrame:
    """moves whose name another move brings to the same target."""
    return moves.withColumn("_n", F.count("*").over(Window.partitionBy("target_id", "name"))).where("_n > 1").drop("_n")


def scan_summary(outcomes: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row of counts; entries that are unchanged but unstable are in none of them. With the inventory's report also what it skipped."""
    counts = outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("discovered", "imported", "failed", "skipped")))
    if report is None:
        return counts
    return counts.crossJoin(report.select(F.col("hidden_entries_skipped").alias("skipped_hidden"), F.col("special_entries_skipped").alias("skipped_special")))  # two rows


def recovery_summary(results: DataFrame) -> DataFrame:
    """One row: attempted, completed and failed entries."""
    return results.agg(F.count("*").alias("attempted"), F.count_if(F.col("outcome") == "ok").alias("completed"), F.count_if(F.col("outcome") != "ok").alias("failed"))


def recovery_failures(results: DataFrame) -> DataFrame:
    """id, message of each entry that could not be recovered."""
    return results.where(F.col("outcome") != "ok").select("id", "message")


def next_jobs(jobs: DataFrame, per_type: int = 1) -> DataFrame:
    """The first pending jobs of each type by priority, age and id, with their rank."""
    own = Window.partitionBy("job_type").orderBy(F.desc("priority"), "created_at", "id")
    return jobs.where("state = 'pending'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= per_type)


def claim_order(jobs: DataFrame, limit: int) -> DataFrame:
    """The jobs that would be claimed first, with their rank: by type, then priority, age and id."""
    served = F.coalesce(*(F.when(F.col("job_type") == t, F.lit(k)) for k, t in enumerate(PRECEDENCE)))
    first = jobs.where("state = 'pending'").withColumn("served", served).orderBy("served", F.desc("priority"), "created_at", "id").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("served", F.desc("priority"), "created_at", "id"))).drop("served")  # `limit` rows


def reprocess_candidates(records: DataFrame, jobs: DataFrame, extractor: str, version: str, limit: int = 10) -> DataFrame:
    """Nodes whose record is of another version, oldest first; the limit comes before nodes with an active extraction job go."""
    if extractor not in ("exiftool", "ffprobe", "tika", "generic", "mime"):
        raise ValueError(f"unknown extractor: {extractor}")
    old = records.where((F.col("extractor_name") == extractor) & (F.col("extractor_version") != version)).orderBy("updated_at", "node_id").limit(limit)
    busy = jobs.where(F.col("state").isin(*ACTIVE) & (F.col("job_type") == "metadata_extraction")).select(F.col("target_node_id").alias("node_id"))
    return old.join(busy, "node_id", "left_anti")


def expired_trash(entries: DataFrame, nodes: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Entries of trashed nodes that are due (at now included), longest due first, with their rank if there is a limit."""
    due = entries.where(F.col("scheduled_purge_at") <= now).join(nodes.where("lifecycle_state = 'trashed'").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    if limit is None:
        return due
    first = due.orderBy("scheduled_purge_at", "node_id").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("scheduled_purge_at", "node_id")))  # `limit` rows


def purge_batch(entries: DataFrame, nodes: DataFrame, jobs: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """As expired_trash, without nodes that have an active deletion job; the limit comes last."""
    busy = jobs.where(F.col("state").isin(*ACTIVE) & (F.col("job_type") == "permanent_deletion")).select(F.col("target_node_id").alias("node_id"))
    return expired_trash(entries.join(busy, "node_id", "left_anti"), nodes, now, limit)


def expired_without_job(entries: DataFrame, nodes: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    busy = jobs.where(F.col("state").isin(*ACTIVE) & (F.col("job_type") == "permanent_deletion")).select(F.col("target_node_id").alias("node_id"))
    return expired_trash(entries, nodes, now).join(busy, "node_id", "left_anti")


def _before() -> Column:
    """The furthest end of a session's chunks that sort before this one; -1 for the first."""
    own = Window.partitionBy("session_id").orderBy("start_byte", "end_byte", "id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max("end_byte").over(own), F.lit(-1).cast("long"))


def missing_ranges(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_id, start_byte, end_byte of gaps below the expected size; overlaps do no harm, and nothing is missing of size 0."""
    size = sessions.where("expected_byte_size > 0").select(F.col("id").alias("session_id"), F.col("expected_byte_size").alias("total"))
    ends = size.select("session_id", F.col("total").alias("start_byte"), F.col("total").alias("end_byte"), F.lit("").alias("id"))
    own = chunks.select("session_id", "start_byte", "end_byte", "id").join(size, "session_id")
    rows = own.where(F.col("start_byte") < F.col("total")).select("session_id", "start_byte", "end_byte", "id").unionByName(ends)
    gaps = rows.withColumn("from", _before() + 1).where(F.col("start_byte") > F.col("from"))
    return gaps.select("session_id", F.col("from").alias("start_byte"), (F.col("start_byte") - 1).alias("end_byte"))


def overlapping_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that begin at or before the end of one that sorts before them."""
    return chunks.withColumn("_before", _before()).where(F.col("start_byte") <= F.col("_before")).drop("_before")


def range_overlaps(chunks: DataFrame, reqs: DataFrame) -> DataFrame:
    """request_id, overlaps of reqs (request_id, session_id, start, end): whether the session has a byte of the range.

    It has one exactly if, of the chunks that begin at or before the range's end, the furthest end reaches its
    start: a running maximum over chunks and requests in one order, dealt out by ranges of it. Chunks with a null end are none."""
    there = chunks.where("session_id IS NOT NULL AND start_byte IS NOT NULL").select("session_id", F.col("start_byte").alias("_at"), F.lit(0).alias("_kind"), F.col("end_byte").alias("_end"), F.lit(None).cast(reqs.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast("long").alias("start"))
    asked = reqs.where("session_id IS NOT NULL").select("session_id", F.col("end").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), "request_id", F.col("start").cast("long").alias("start"))
    seen = max_before(there.unionByName(asked), ["session_id"], ["_at", "_kind"], "_end", "_reach").where("_kind = 1")
    hit = seen.where(F.col("_reach") >= F.col("start")).select("request_id", F.lit(True).alias("overlaps")).distinct()
    return reqs.join(hit, "request_id", "left").select("request_id", F.coalesce("overlaps", F.lit(False)).alias("overlaps"))


def one_active_per_key(reqs: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Requests that may become work: the first of each (job_type, target) for which no job is pending or leased."""
    key = ["job_type", "target_node_id"]
    if jobs is not None:
        reqs = reqs.join(jobs.where(F.col("state").isin(*ACTIVE)).select(*key).distinct(), key, "left_anti")
    return reqs.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("created_at", "id"))).where("_nth = 1").drop("_nth")
