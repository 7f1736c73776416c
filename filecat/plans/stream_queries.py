"""Registered streaming queries: a log that is late, out of order and repeats is replayed from files through the stream, to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecat.functions.columns import at
from filecat.plans.cuts import shared_dir
from filecat.plans.derived import NOW_EVENTS, Catalog, duck_sql
from filecat.streaming import streams as X
from filecat.streaming.sinks import EntrySink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def arriving(log: DataFrame, folder: str, slices: int, heartbeat: dict | None = None) -> Iterator[None]:
    """Adds the log to a folder in the order of `arrives` (microseconds), a slice at each turn, and at last the heartbeat.

    The log is made once, and its slices are written by as many tasks as they take; what was added by a turn is one batch."""
    spark, kept = log.sparkSession, [c for c in log.columns if c != "arrives"]
    ends = log.agg(F.min("arrives").alias("low"), F.max("arrives").alias("high")).first()  # two numbers
    slice_ = F.least(F.floor((F.col("arrives") - ends["low"]) * slices / (ends["high"] - ends["low"] + 1)), F.lit(slices - 1)).cast("int")
    log.select(*kept, slice_.alias("_slice")).hint("rebalance", "_slice").write.partitionBy("_slice").parquet(f"{folder}-slices")
    made = spark.read.parquet(f"{folder}-slices")
    for k in range(slices):
        made.where(F.col("_slice") == k).select(kept).write.mode("append").parquet(folder)
        yield
    if heartbeat:
        beat = spark.createDataFrame([tuple(heartbeat.get(c) for c in kept)], log.select(kept).schema)
        for _ in range(2):  # the first moves the watermark, the second is a batch that sees it
            beat.coalesce(1).write.mode("append").parquet(folder)
            yield


@contextmanager
def batches_of_data(spark: SparkSession) -> Iterator[None]:
    """A replay has heartbeats, so it needs no empty batches between its slices."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replayed(spark: SparkSession, log: DataFrame, stream: Callable[[DataFrame], DataFrame], files: int, mode: str = "update", heartbeat: dict | None = None) -> DataFrame:
    """What the stream puts out over the log, with the number of the batch; a log with `arrives` is cut by it, a slice a batch."""
    X.use_rocksdb(spark)
    folder = shared_folder(spark)
    schema, reader = log.drop("arrives").schema, spark.readStream
    if "arrives" in log.columns:
        turns = arriving(log, f"{folder}/log", files, heartbeat)
    else:
        log.repartition(files).write.parquet(f"{folder}/log")
        turns, reader = [None], reader.option("maxFilesPerTrigger", max(1, files // 2))
    out = None
    with batches_of_data(spark) if heartbeat else nullcontext():
        for _ in turns:
            out = out or stream(reader.schema(schema).parquet(f"{folder}/log"))  # the folder is there
            X.run_to_end(out, f"{folder}/checkpoint", lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}"), mode)
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{folder}/out")


def last_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))).where("_n = 1").drop("_n", "batch")


FAR = 4_000_000_000_000_000
DAY = 86_400_000_000

#: Chunks of all sessions, which end 60 days after their first ship date: a third of the ranges come again as the same event, some again under another id; some come after the end.
SHIPPED = """log AS (SELECT session_id, id, start_byte, end_byte, {us} AS created_us, {end} AS expires_us, {n} AS n FROM upload_chunks c JOIN (SELECT session_id AS own, min(created_at) AS first FROM upload_chunks GROUP BY session_id) f ON f.own = c.session_id),
twice AS (SELECT session_id, id, start_byte, end_byte, created_us, expires_us, n FROM log UNION ALL SELECT session_id, concat(id, '-again'), start_byte, end_byte, created_us + 3600000000, expires_us, n FROM log WHERE n % 4 = 0)"""
SPARK_SHIPPED = SHIPPED.format(us="unix_micros(CAST(c.created_at AS TIMESTAMP))", end="unix_micros(CAST(timestampadd(DAY, 60, f.first) AS TIMESTAMP))", n="CAST(split(c.id, '-')[2] AS BIGINT)")
DUCK_SHIPPED = SHIPPED.format(us="epoch_us(c.created_at)", end="epoch_us(f.first + to_days(60))", n="CAST(string_split(c.id, '-')[3] AS BIGINT)")


def with_query(cat: Catalog, tables: str, query: str) -> DataFrame:
    """query over further tables, which use derived ones."""
    return cat.sql(f"SELECT * FROM (WITH {tables} {query}) x")


def stream_upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's last row: chunks come up to 20 days late and out of order, a third of them twice, some overlap, some are gone."""
    query = f"SELECT session_id, id, start_byte, end_byte, created_us, expires_us, created_us + n % 20 * {DAY} AS arrives FROM twice UNION ALL SELECT session_id, id, start_byte, end_byte, created_us, expires_us, created_us + n % 17 * {DAY} FROM twice WHERE n % 3 = 0"
    log = with_query(Catalog(spark, sf_dir), SPARK_SHIPPED, query)
    beat = {"session_id": X.HEARTBEAT, "id": "", "start_byte": 0, "end_byte": 0, "created_us": FAR, "expires_us": FAR}
    rows = replayed(spark, log, lambda chunks: X.stream_upload_progress(chunks, "30 days"), 4, heartbeat=beat)
    gone = rows.where("state = 'gone'").groupBy("session_id").agg(F.sum("rejected").alias("gone"))
    return last_of(rows.where("state <> 'gone'"), "session_id").join(gone, "session_id", "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))


#: The fold of T-16 over the same log, and how often chunks that came too late were sent.
ORACLES["stream_upload_progress"] = duck_sql(
    """SELECT f.session_id, coalesce(list_sum(list_transform(kept, lambda x: x.end_byte - x.start_byte + 1)), 0)::BIGINT AS received, len(kept)::BIGINT AS chunks, (len(l) - len(kept))::BIGINT AS rejected, 'expired' AS state, coalesce(g.gone, 0)::BIGINT AS gone
  FROM folded f LEFT JOIN (SELECT session_id, sum(CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END) AS gone FROM twice WHERE created_us >= expires_us GROUP BY session_id) g ON g.session_id = f.session_id""",
    DUCK_SHIPPED + """, ordered AS (SELECT session_id, list({'start_byte': start_byte, 'end_byte': end_byte} ORDER BY created_us, id) AS l FROM (SELECT DISTINCT * FROM twice) t WHERE created_us < expires_us GROUP BY session_id),
  steps AS (SELECT session_id, l, 0 AS i, l[1:0] AS kept FROM ordered UNION ALL SELECT session_id, l, i + 1, CASE WHEN len(list_filter(kept, lambda a: a.start_byte <= l[i + 1].end_byte AND a.end_byte >= l[i + 1].start_byte)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END FROM steps WHERE i < len(l)),
  folded AS (SELECT session_id, l, kept FROM steps WHERE i = len(l))""",
)

MINUTE = 60_000_000
#: Up to six events of every job: claims with five minutes of lease, renewals, outcomes in and out of time.
EVENTS = """base AS (SELECT event_id AS n, id AS job_id, {us} AS t FROM job_requests),
log AS (SELECT job_id, n, CAST(0 AS BIGINT) AS seq, 'claimed' AS event, t AS at_us, t + 300000000 AS lease_us FROM base WHERE n % 11 <> 0
  UNION ALL SELECT job_id, n, 1, 'renewed', t + 240000000, t + 540000000 FROM base WHERE n % 3 = 0
  UNION ALL SELECT job_id, n, 2, CASE n % 4 WHEN 0 THEN 'ok' ELSE 'error' END, t + CASE WHEN n % 13 = 0 THEN 5 ELSE 7 END * 60000000, NULL FROM base WHERE n % 4 < 2
  UNION ALL SELECT job_id, n, 3, 'claimed', t + 1200000000, t + 1500000000 FROM base WHERE n % 2 = 0
  UNION ALL SELECT job_id, n, 4, CASE n % 6 WHEN 0 THEN 'error' ELSE 'ok' END, t + 1320000000, NULL FROM base WHERE n % 6 IN (0, 2)
  UNION ALL SELECT job_id, n, 5, 'claimed', t + 2400000000, t + 2700000000 FROM base WHERE n % 5 = 0
  UNION ALL SELECT job_id, n, 6, 'error', t + 2460000000, NULL FROM base WHERE n % 10 = 0)"""


def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's last state after up to seven events, late by up to nine minutes, a fifth of them sent twice."""
    query = f"SELECT job_id, seq, event, at_us, lease_us, CAST(2 AS INT) AS max_attempts, at_us + (n + seq) % 10 * {MINUTE} AS arrives FROM log UNION ALL SELECT job_id, seq, event, at_us, lease_us, CAST(2 AS INT), at_us + 9 * {MINUTE} FROM log WHERE n % 5 = 1"
    log = with_query(Catalog(spark, sf_dir), EVENTS.format(us="unix_micros(CAST(created_at AS TIMESTAMP))"), query)
    beat = {"job_id": X.HEARTBEAT, "seq": 0, "event": "", "at_us": FAR, "max_attempts": 0}
    return last_of(replayed(spark, log, lambda events: X.stream_job_state(events, "30 minutes"), 4, heartbeat=beat), "job_id").select("job_id", "state", "attempts", "seq")


ORACLES["stream_job_state"] = duck_sql(
    """SELECT job_id, CASE WHEN state = 'leased' THEN 'pending' ELSE state END AS state, attempts::BIGINT AS attempts, (l[len(l)].seq)::BIGINT AS seq FROM steps WHERE i = len(l)""",
    EVENTS.format(us="epoch_us(created_at)") + """, ordered AS (SELECT job_id, list({'seq': seq, 'event': event, 'at': at_us, 'lease': lease_us} ORDER BY at_us, seq) AS l FROM log GROUP BY job_id),
  steps AS (SELECT job_id, l, 0 AS i, 'pending' AS state, 0 AS attempts, CAST(NULL AS BIGINT) AS lease FROM ordered
  UNION ALL SELECT job_id, l, i + 1, CASE WHEN e.event = 'claimed' AND now = 'pending' THEN 'leased' WHEN now = 'leased' AND e.event = 'ok' THEN 'completed' WHEN now = 'leased' AND e.event = 'error' THEN CASE WHEN attempts >= 2 THEN 'failed' ELSE 'pending' END ELSE now END,
    attempts + CASE WHEN e.event = 'claimed' AND now = 'pending' THEN 1 ELSE 0 END, CASE WHEN (e.event = 'claimed' AND now = 'pending') OR (e.event = 'renewed' AND now = 'leased') THEN e.lease WHEN e.event IN ('ok', 'error') THEN NULL ELSE lease END
    FROM (SELECT *, l[i + 1] AS e, CASE WHEN state = 'leased' AND lease < l[i + 1].at THEN 'pending' ELSE state END AS now FROM steps WHERE i < len(l)) x)""",
)

#: Restores of some trashed nodes, before and after their purge is due.
RESTORED = "SELECT node_id, {since} AS restored_at FROM trash_entries WHERE {n} % 3 < 2"


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due purges of everything that was ever trashed: T-08's due set at a moment after the log's end, without what was restored in time."""
    cat, folder = Catalog(spark, sf_dir), shared_folder(spark)
    X.use_rocksdb(spark)
    number = "CAST(substr(node_id, 2) AS BIGINT)"
    trash = cat.sql(f"SELECT node_id, CAST(trashed_at AS TIMESTAMP) AS trashed_at, unix_micros(CAST(trashed_at AS TIMESTAMP)) + {number} % 9 * {DAY} AS arrives FROM trash_entries")
    back = cat.sql(f"SELECT node_id, CAST(timestampadd(DAY, {number} % 50, trashed_at) AS TIMESTAMP) AS restored_at, unix_micros(CAST(timestampadd(DAY, {number} % 50, trashed_at) AS TIMESTAMP)) + {number} % 7 * {DAY} AS arrives FROM trash_entries WHERE {number} % 3 < 2")
    far = spark.sql(f"SELECT timestamp_micros({FAR}) AS far").first()["far"]
    turns = zip(arriving(trash, f"{folder}/trash", 4, {"node_id": X.HEARTBEAT, "trashed_at": far}), arriving(back, f"{folder}/back", 4, {"node_id": X.HEARTBEAT, "restored_at": far}))
    read = lambda rows, name: spark.readStream.schema(rows.drop("arrives").schema).parquet(f"{folder}/{name}")
    with batches_of_data(spark):
        for _ in turns:
            out = X.stream_retention(read(trash, "trash"), read(back, "back"), late="10 days")
            X.run_to_end(out, f"{folder}/checkpoint", lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"), "append")
    due = spark.read.schema(out.schema).parquet(f"{folder}/out/batch=*")
    return due.select("node_id", F.unix_micros("purge_at").alias("purge_us"))


ORACLES["stream_retention"] = duck_sql("SELECT node_id, epoch_us(scheduled_purge_at) AS purge_us FROM trash_entries WHERE NOT (CAST(substr(node_id, 2) AS BIGINT) % 3 < 2 AND CAST(substr(node_id, 2) AS BIGINT) % 50 < 30)")


def dedupe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk, half of them again within the day, a third again 700 days later, when their state is gone."""
    query = f"""SELECT session_id, start_byte, end_byte, created_us, created_us AS arrives FROM log UNION ALL SELECT session_id, start_byte, end_byte, created_us + 1800000000, created_us + 1800000000 FROM log WHERE n % 2 = 0
  UNION ALL SELECT session_id, start_byte, end_byte, created_us + 700 * {DAY}, created_us + 700 * {DAY} FROM log WHERE n % 3 = 0"""
    log = with_query(Catalog(spark, sf_dir), UNLIKE.format(us="unix_micros(CAST(created_at AS TIMESTAMP))", n="CAST(split(id, '-')[2] AS BIGINT)"), query)
    rows = log.select("session_id", "start_byte", "end_byte", F.timestamp_micros("created_us").alias("created_at"), "arrives")
    out = replayed(spark, rows, X.dedupe_chunks, 12, "append", {"session_id": X.HEARTBEAT, "start_byte": 0, "end_byte": 0, "created_at": spark.sql(f"SELECT timestamp_micros({FAR}) AS far").first()["far"]})
    return out.where(F.col("session_id") != X.HEARTBEAT).groupBy("session_id", "start_byte", "end_byte").agg(F.count("*").alias("times"))


#: One chunk for each range of a session.
UNLIKE = "log AS (SELECT * FROM (SELECT session_id, id, start_byte, end_byte, {us} AS created_us, {n} AS n, row_number() OVER (PARTITION BY session_id, start_byte, end_byte ORDER BY id) AS nth FROM upload_chunks) x WHERE nth = 1)"
ORACLES["dedupe_chunks"] = duck_sql("SELECT session_id, start_byte, end_byte, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS times FROM log", UNLIKE.format(us="epoch_us(created_at)", n="CAST(string_split(id, '-')[3] AS BIGINT)"))

#: What three scans found, in turn: each finds some files again, changed.
SCANS = "SELECT source_id, concat(source_path, CASE WHEN page_id % 4 = 0 THEN '.new' ELSE '' END) AS source_path, source_size + s.k AS source_size, {at} AS source_modified_at, s.k FROM import_entries CROSS JOIN (VALUES (0), (1), (2)) AS s(k) WHERE page_id % (s.k + 2) = 0 AND page_id % 4 < 3"


def stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import entries after a stream of three scans: what T-21 gives for all of them at once. The last batch is sent twice."""
    cat, folder = Catalog(spark, sf_dir), shared_folder(spark)
    found = cat.sql(SCANS.format(at="timestampadd(HOUR, s.k, updated_at)"))
    entries = cat.import_entries.withColumns({"source_modified_at": F.col("created_at"), "source_checksum": F.sha2("source_path", 256), "resulting_node_id": F.concat(F.lit("n"), "page_id")})
    sink = EntrySink(spark, f"{folder}/entries", entries, at(NOW_EVENTS))
    sent: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        sink(batch, number)  # a repeated batch
        sent.append(number)

    schema = found.drop("k").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for k in range(3):  # a scan a batch, written by as many tasks as it takes
        found.where(F.col("k") == k).drop("k").write.mode("append").parquet(f"{folder}/log")
        X.run_to_end(X.stream_inventory(spark, f"{folder}/log", schema), f"{folder}/checkpoint", put, "append")
    rows = sink.entries()
    return rows.select("source_id", "source_path", "source_size", "state", F.unix_micros(F.col("source_modified_at").cast("timestamp")).alias("modified_us"), "source_checksum", "resulting_node_id")


_SEEN = "seen AS (SELECT source_id, source_path, max({'at': source_modified_at, 'size': source_size}) AS s FROM (" + SCANS.format(at="updated_at + to_hours(CAST(s.k AS INTEGER))") + ") x GROUP BY source_id, source_path)"
ORACLES["stream_inventory"] = duck_sql(
    """SELECT coalesce(e.source_id, f.source_id) AS source_id, coalesce(e.source_path, f.source_path) AS source_path, coalesce(f.s.size, e.source_size) AS source_size, CASE WHEN e.id IS NULL OR (f.s IS NOT NULL AND state = 'imported') THEN 'discovered' ELSE state END AS state, epoch_us(coalesce(f.s.at, e.created_at)) AS modified_us,
  CASE WHEN e.id IS NOT NULL AND NOT (f.s IS NOT NULL AND state = 'imported') THEN sha256(e.source_path) END AS source_checksum, CASE WHEN e.id IS NOT NULL AND NOT (f.s IS NOT NULL AND state = 'imported') THEN concat('n', page_id) END AS resulting_node_id FROM import_entries e FULL JOIN seen f ON f.source_id = e.source_id AND f.source_path = e.source_path""",
    _SEEN,
)

QUERIES |= {f.__name__: f for f in (stream_upload_progress, stream_job_state, stream_retention, dedupe_chunks, stream_inventory)}
