"""The catalog's event logs as streams. Each stream gives, over a complete log, what its batch plan gives.

Logs come late and out of order, so the stateful operators hold a key's events until the watermark has
passed them and then apply them in the order of their own times: what has been applied is never revised,
however the log was cut into batches. Keys share buckets, and each bucket has one timer, armed anew whenever
its next moment changes (an event that waits, the end of a lease or of a session). A key's state ends with the
thing it describes.
State is kept with transformWithStateInPandas (RocksDB).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filecat.functions.intervals import Ranges

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The log's columns: a session's chunks, with the session's own end.
CHUNKS = "session_id string, id string, start_byte long, end_byte long, created_us long, expires_us long"
PROGRESS = "session_id string, received long, chunks long, rejected long, state string"
#: A job's events: claimed and renewed (with the end of the lease), ok, error.
JOBS = "job_id string, seq long, event string, at_us long, lease_us long, max_attempts int"
JOB_STATE = "job_id string, state string, attempts long, seq long, lease_us long"


#: A key of rows that only move time on. (A filter for them would be pushed below the watermark, which then would not see them.)
HEARTBEAT = ""
#: Buckets that keys are dealt to; a checkpoint keeps the number it began with.
BUCKETS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Holds events (tuples that begin with their time in microseconds) until the watermark has passed them.

    A group is a bucket of keys, not one key: what its keys hold is read and written at once, which costs as
    much as for a single key. The state is a dictionary, pickled: of each key what has been applied (None:
    nothing yet), the events that wait, and its next moment. Rows of a bucket come out in one frame."""

    id_column, output = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("held", "keys binary")

    def arm(self, moments: list[int]) -> None:
        """One timer, at the first of these moments (microseconds): it fires once the watermark has reached it."""
        first = -(-min(moments) // 1000) if moments else None
        armed = list(self.handle.listTimers())
        for at in armed:
            if at != first:
                self.handle.deleteTimer(at)
        if first is not None and first not in armed:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list[tuple]] = {}
        for frame in rows:
            for own, event in zip(frame[self.id_column].tolist(), self.events(frame)):
                if own != HEARTBEAT:
                    new.setdefault(own, []).append(event)
        yield from self.advance(new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance({}, timerValues.getCurrentWatermarkInMs() * 1000)

    def advance(self, new: dict[str, list[tuple]], passed: int) -> Iterator[pd.DataFrame]:
        """Keys with new events, and those whose next moment has passed, go on; the others stay as they are."""
        held = pickle.loads(self.cell.get()[0]) if self.cell.exists() else {}
        due = new.keys() | {own for own, (_, _, moment) in held.items() if moment is not None and moment <= passed}
        out: list[tuple] = []
        for own in due:
            before, waiting, _ = held.get(own, (None, [], None))
            rows, after, wait, moments = self.step(own, before, waiting, new.get(own, []), passed)
            out += rows
            if after is None:
                held.pop(own, None)
            else:
                held[own] = (after, wait, min(moments, default=None))
        if due and held:
            self.cell.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        elif due and self.cell.exists():
            self.cell.clear()
        if due:
            self.arm([moment for _, _, moment in held.values() if moment is not None])
        if out:
            names, types = zip(*(c.split() for c in self.output.split(", ")))
            yield pd.DataFrame({n: pd.array(values, "Int64") if t == "long" else list(values) for n, t, values in zip(names, types, zip(*out))})

    def close(self) -> None:
        pass


class UploadProgress(InOrder):
    """X2: what a session has received. First come, first kept; a chunk at or after the session's end is gone.

    States of a row: active (events that still wait counted in as they stand), expired (the last row: the
    watermark has passed the end, state is gone), and gone (chunks that came for an ended session, no state)."""

    id_column, output = "session_id", PROGRESS

    def events(self, frame: pd.DataFrame) -> Iterator[tuple]:
        return zip(*(frame[c].tolist() for c in ("created_us", "id", "start_byte", "end_byte", "expires_us")))

    def step(self, session: str, now: tuple | None, waiting: list[tuple], new: list[tuple], passed: int) -> tuple:
        gone = sum(e[0] >= e[4] for e in new)
        rows = [(session, 0, 0, gone, "gone")] if gone else []
        events = sorted(set(waiting) | {e for e in new if e[0] < e[4]})  # an event sent again is one event
        if not events and now is None:
            return rows, None, [], []
        now = now or (0, 0, 0, events[0][4], [], [])
        ranges = Ranges(now[4], now[5])
        sums = self.fold(ranges, [e for e in events if e[0] <= passed], now[:3])
        wait, end = [e for e in events if e[0] > passed], now[3]
        if end <= passed and not wait:
            return [*rows, (session, *sums, "expired")], None, [], []
        after = (*sums, end, list(ranges.starts), list(ranges.ends))
        rows.append((session, *self.fold(ranges, wait, sums), "active"))
        return rows, after, wait, [end, *(e[0] for e in wait)]

    @staticmethod
    def fold(ranges: Ranges, events: list[tuple], sums: tuple) -> tuple[int, int, int]:
        received, chunks, rejected = sums
        for _, _, start, end, _ in events:
            if ranges.add(start, end):
                received, chunks = received + end - start + 1, chunks + 1
            else:
                rejected += 1
        return received, chunks, rejected


class JobState(InOrder):
    """X3: a job's events folded into its state by the rules of T-12; the timer at its lease's end is T-13.

    A lease ends strictly before now, so an outcome at that very moment still counts. Events may be sent
    again and may be late as long as the watermark allows; a finished job's state stays for `keep` after its
    last event, so that late repeats find it, and then goes."""

    id_column, output = "job_id", JOB_STATE

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def events(self, frame: pd.DataFrame) -> Iterator[tuple]:
        lease = [None if pd.isna(x) else int(x) for x in frame["lease_us"].tolist()]
        return zip(frame["at_us"].tolist(), frame["seq"].tolist(), frame["event"].tolist(), lease, frame["max_attempts"].tolist())

    def step(self, job: str, before: tuple | None, waiting: list[tuple], new: list[tuple], passed: int) -> tuple:
        before = before or ("pending", 0, -1, None, 0)
        events = sorted(set(waiting) | {e for e in new if e[1] > before[2]})
        now = before
        for at, seq, event, lease, most in (e for e in events if e[0] <= passed):
            now = job_step(reaped(now, at), at, seq, event, lease, most)
        now, wait = reaped(now, passed), [e for e in events if e[0] > passed]
        rows = [(job, *now[:4])] if now != before else []
        if now[0] in ("completed", "failed") and not wait and now[4] + self.keep_us <= passed:
            return rows, None, [], []
        ends = [now[3] + 1] if now[0] == "leased" else [now[4] + self.keep_us] if now[0] in ("completed", "failed") else []
        return rows, now, wait, [*ends, *(e[0] for e in wait)]

    # a job that waits for a claim has no end of its own, so its few numbers stay


def reaped(now: tuple, at: int) -> tuple:
    """T-13: a lease that ended strictly before this moment leaves the job pending, whatever its attempts."""
    state, attempts, seq, lease, last = now
    return ("pending", attempts, seq, None, last) if state == "leased" and lease is not None and lease < at else now


def job_step(now: tuple, at: int, seq: int, event: str, lease: int | None, most: int) -> tuple:
    """T-11's claim, a renewal of the lease, and T-12's outcomes; what does not fit the state changes nothing but seq."""
    state, attempts, _, until, _ = now
    if event == "claimed" and state == "pending":
        return "leased", attempts + 1, seq, lease, at
    if state == "leased" and event == "renewed":
        return state, attempts, seq, lease, at
    if state == "leased" and event in ("ok", "error"):
        return "completed" if event == "ok" else "failed" if attempts >= most else "pending", attempts, seq, None, at
    return state, attempts, seq, until, at


def _timed(rows: DataFrame, column: str, late: str) -> DataFrame:
    return rows.withColumn("at", F.timestamp_micros(column)).withWatermark("at", late)


def _in_buckets(rows: DataFrame, key: str, buckets: int):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("bucket")


def stream_upload_progress(chunks: DataFrame, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """X2 over chunks (CHUNKS); late: how much later than others a chunk may come. Rows of the session HEARTBEAT move time alone."""
    return _in_buckets(_timed(chunks, "created_us", late), "session_id", buckets).transformWithStateInPandas(UploadProgress(), PROGRESS, "Update", "EventTime")


def stream_job_state(events: DataFrame, late: str = "1 hour", keep: int = 86_400, buckets: int = BUCKETS) -> DataFrame:
    """X3 over events (JOBS); keep: seconds for which a finished job's state stays. Rows of the job HEARTBEAT move time alone."""
    return _in_buckets(_timed(events, "at_us", late), "job_id", buckets).transformWithStateInPandas(JobState(keep * 1_000_000), JOB_STATE, "Update", "EventTime")


def stream_inventory(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """X1: files of an inventory listing as they appear; each trigger sees the new ones alone. Its sink is streaming.sinks.EntrySink."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def stream_retention(trash: DataFrame, restored: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """X4: node_id, purge_at of trashed nodes that no restore follows before they are due.

    An outer join in event time: the purge is out once the restores' watermark has passed its moment."""
    t = trash.withWatermark("trashed_at", late).withColumn("purge_at", F.col("trashed_at") + F.make_dt_interval(F.lit(days)))
    r = restored.withWatermark("restored_at", late).select(F.col("node_id").alias("back"), "restored_at")
    return t.join(r, F.expr(f"node_id = back AND restored_at >= trashed_at AND restored_at < trashed_at + INTERVAL {days} DAYS"), "leftOuter").where("back IS NULL").select("node_id", "purge_at")


def dedupe_chunks(chunks: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """X5: each exact range of a session once within the time a session lives; a range that comes again after that is a new one."""
    return chunks.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["session_id", "start_byte", "end_byte"])


def run_to_end(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over what there is; sink gets each batch and its number, and must bear a repeated one."""
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
