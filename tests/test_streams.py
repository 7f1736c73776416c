"""A stream over a complete log gives what the batch plan gives."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from filecat.functions import columns as C
from filecat.functions.intervals import Ranges
from filecat.plans import maintenance as M
from filecat.plans.stream_queries import last_of, replayed
from filecat.sources import snapshots
from filecat.streaming import streams as X
from filecat.streaming.sinks import EntrySink

MINUTE = 60_000_000
CHUNKS = [("s", "1", 0, 9, 5, 100), ("s", "2", 5, 14, 6, 100), ("s", "3", 20, 29, 3, 100), ("s", "4", 30, 39, 100, 100), ("t", "5", 0, 4, 1, 100), ("t", "6", 0, 4, 2, 100)]


def slices_of(spark, folder, slices, schema):
    """A file for each slice, in order, and a stream that reads one a batch."""
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put_out(spark, out, folder, mode="update"):
    """All rows that come out, with their batch."""
    X.use_rocksdb(spark)
    X.run_to_end(out, f"{folder}/checkpoint", lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}"), mode)
    return spark.read.parquet(*[str(p) for p in sorted((folder / "out").glob("n=*"))]).collect() if (folder / "out").exists() else []


def test_upload_progress_is_the_batch_fold(spark):
    """One file, and no watermark yet: rows tell how things stand; the chunk at the session's end is gone."""
    log = spark.createDataFrame(CHUNKS, X.CHUNKS)
    rows = replayed(spark, log, X.stream_upload_progress, 1)
    got = {r["session_id"]: (r["received"], r["chunks"], r["rejected"]) for r in last_of(rows.where("state = 'active'"), "session_id").collect()}
    sessions = spark.createDataFrame([("s", "active"), ("t", "active")], "id string, state string")
    chunks = log.where("created_us < expires_us").withColumn("created_at", F.timestamp_micros("created_us").cast("timestamp_ntz"))
    accepted, received = M.apply_chunks(sessions, chunks)
    want = {r["id"]: r["received"] for r in received.collect()}
    kept = {r["session_id"]: r["n"] for r in accepted.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: (want[k], kept[k]) for k in want} == {"s": (20, 2), "t": (5, 1)}
    assert {k: v[2] for k, v in got.items()} == {"s": 1, "t": 1}
    assert [(r["session_id"], r["rejected"]) for r in rows.where("state = 'gone'").collect()] == [("s", 1)]


def test_late_chunks_are_folded_in_their_own_order(spark, tmp_path):
    """A chunk that comes two batches late but was first wins; the session's end clears its state, and what comes after it is gone."""
    m = MINUTE
    slices = [
        [("s", "b", 5, 14, 20 * m, 300 * m), ("s", "c", 30, 39, 30 * m, 300 * m)],
        [("s", "a", 0, 9, 10 * m, 300 * m), ("s", "a", 0, 9, 10 * m, 300 * m)],  # sent twice, before b in time
        [("z", "z", 0, 0, 150 * m, 400 * m)],
        [("s", "d", 15, 19, 160 * m, 300 * m), ("s", "e", 31, 31, 161 * m, 300 * m)],
        [("z", "y", 1, 1, 380 * m, 400 * m)],
        [("s", "f", 50, 59, 390 * m, 300 * m)],
        [(X.HEARTBEAT, "", 0, 0, 900 * m, 900 * m)],
    ]
    rows = put_out(spark, X.stream_upload_progress(slices_of(spark, str(tmp_path / "log"), slices, X.CHUNKS), "60 minutes"), tmp_path)
    of_s = sorted(((r["batch"], r["state"], r["received"], r["chunks"], r["rejected"]) for r in rows if r["session_id"] == "s"))
    assert of_s[0][1:] == ("active", 20, 2, 0)
    assert [x[1:] for x in of_s if x[1] == "expired"] == [("expired", 25, 3, 2)] and [x[1:] for x in of_s if x[1] == "gone"] == [("gone", 0, 0, 1)]
    assert [(r["state"], r["received"]) for r in sorted(rows, key=lambda r: r["batch"]) if r["session_id"] == "z"][-1] == ("expired", 2)


JOB_EVENTS = [
    ("a", 0, "claimed", 0, 5, 2), ("a", 1, "error", 2, None, 2), ("a", 2, "claimed", 3, 8, 2), ("a", 3, "error", 8, None, 2),  # an outcome at the end of the lease counts
    ("b", 0, "claimed", 0, 5, 2), ("b", 1, "renewed", 4, 20, 2), ("b", 2, "ok", 15, None, 2), ("b", 3, "claimed", 30, 40, 2),
    ("c", 0, "claimed", 0, 5, 1), ("c", 1, "ok", 6, None, 1), ("c", 2, "claimed", 50, 55, 1),  # the lease had ended
    ("d", 0, "ok", 0, None, 1), ("e", 0, "claimed", 70, 75, 3),
]


def batch_states(spark, events):
    """T-11's claims, T-12 and T-13 over a table of jobs, minute by minute."""
    ids = sorted({e[0] for e in events})
    most = {e[0]: e[5] for e in events}
    jobs = {j: ["pending", 0, None] for j in ids}
    for now in range(0, 200):
        for j, seq, event, at, lease, _ in sorted(events, key=lambda e: (e[3], e[1])):
            if at != now:
                continue
            table = spark.createDataFrame([(k, s, a, most[k], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=u) if u is not None else None, None) for k, (s, a, u) in jobs.items()], "id string, state string, attempts int, max_attempts int, lease_expires_at timestamp_ntz, last_error string")
            moment = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=now)).cast("timestamp_ntz")
            for r in M.stale_leases(table, moment).collect():
                jobs[r["id"]] = ["pending", r["attempts"], None]
            state, attempts, until = jobs[j]
            if event == "claimed" and state == "pending":
                jobs[j] = ["leased", attempts + 1, lease]
            elif event == "renewed" and state == "leased":
                jobs[j][2] = lease
            elif event in ("ok", "error"):
                table = spark.createDataFrame([(j, state, attempts, most[j], None, None)], "id string, state string, attempts int, max_attempts int, lease_expires_at timestamp_ntz, last_error string")
                after = M.fold_attempts(table, spark.createDataFrame([(j, event == "ok", event)], "id string, ok boolean, error string")).first()
                jobs[j] = [after["state"], attempts, None if after["state"] != "leased" else until]
    return {j: ("pending" if s == "leased" else s, a) for j, (s, a, _) in jobs.items()}


def test_job_state_is_the_batch_fold(spark, tmp_path):
    """Events in any order within the watermark, some sent twice: T-12 plus T-13 over the same log; leases end by a timer alone."""
    rows = [(j, seq, e, (1000 + at) * MINUTE, None if lease is None else (1000 + lease) * MINUTE, most) for j, seq, e, at, lease, most in JOB_EVENTS]
    slices = [rows[1::2], rows[0::2] + rows[3:5], [(X.HEARTBEAT, 0, "", 9_000 * MINUTE, None, 0)], [(X.HEARTBEAT, 0, "", 9_000 * MINUTE, None, 0)]]
    out = put_out(spark, X.stream_job_state(slices_of(spark, str(tmp_path / "log"), slices, X.JOBS), "90 minutes"), tmp_path)
    last = {}
    for r in sorted(out, key=lambda r: r["batch"]):
        last[r["job_id"]] = (r["state"], r["attempts"])
    assert last == batch_states(spark, JOB_EVENTS) == {"a": ("failed", 2), "b": ("completed", 1), "c": ("pending", 2), "d": ("pending", 0), "e": ("pending", 1)}


def test_timers_move_with_the_lease(spark, tmp_path):
    """A lease that was renewed is not reaped at its first end; one that was not is, by time alone."""
    m = MINUTE
    slices = [[("r", 0, "claimed", m, 10 * m, 2), ("q", 0, "claimed", m, 10 * m, 2)], [("r", 1, "renewed", 5 * m, 100 * m, 2)], [(X.HEARTBEAT, 0, "", 14 * m, None, 0)], [(X.HEARTBEAT, 0, "", 31 * m, None, 0)], [(X.HEARTBEAT, 0, "", 200 * m, None, 0)]]
    out = sorted(put_out(spark, X.stream_job_state(slices_of(spark, str(tmp_path / "log"), slices, X.JOBS), "10 minutes"), tmp_path), key=lambda r: r["batch"])
    states = {j: [(r["state"], r["lease_us"]) for r in out if r["job_id"] == j] for j in "rq"}
    assert states["q"] == [("leased", 10 * m), ("pending", None)] and states["r"][-2:] == [("leased", 100 * m), ("pending", None)]
    reaped = {j: next(r["batch"] for r in out if r["job_id"] == j and r["state"] == "pending") for j in "rq"}
    assert reaped["q"] < reaped["r"]


def test_ranges():
    """A set of ranges against numbers held one by one; and 100,000 ranges, most of which overlap, in seconds."""
    rng, taken, ranges = random.Random(4), set(), Ranges()
    for _ in range(3000):
        start = rng.randint(0, 4000)
        end = start + rng.randint(0, 6)
        own = set(range(start, end + 1))
        assert ranges.add(start, end) == (not own & taken)
        taken |= own if not own & taken else set()
        assert all(b < c - 1 for b, c in zip(ranges.ends, ranges.starts[1:]))
    assert {x for a, b in zip(ranges.starts, ranges.ends) for x in range(a, b + 1)} == taken


def test_chunks_of_one_large_session(spark):
    """T-16 over 100,000 overlapping chunks of one session in seconds, and equal to a plain fold on a small log."""
    kind = "id string, session_id string, start_byte long, end_byte long, created_at timestamp_ntz"
    sessions = spark.createDataFrame([("s", "active"), ("t", "active"), ("u", "expired")], "id string, state string")
    began = time.time()
    large = spark.range(100_000).selectExpr("concat('c', id) AS id", "'s' AS session_id", "id * 7919 % 100000 * 6 AS start_byte", "id * 7919 % 100000 * 6 + id % 9 AS end_byte", "CAST(timestamp_micros(id) AS timestamp_ntz) AS created_at")
    accepted, received = M.apply_chunks(sessions, large)
    n, total = accepted.count(), {r["id"]: r["received"] for r in received.collect()}
    assert time.time() - began < 60
    taken, want, sums = Ranges(), 0, 0
    for i in range(100_000):
        start = i * 7919 % 100_000 * 6
        if taken.add(start, start + i % 9):
            want, sums = want + 1, sums + i % 9 + 1
    assert (n, total) == (want, {"s": sums, "t": 0, "u": 0})
    rng = random.Random(8)
    rows = [(f"c{i}", rng.choice("stu"), a := rng.randint(0, 300), a + rng.randint(0, 9), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 40))) for i in range(300)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        if r[1] != "u" and not any(k[1] == r[1] and k[2] <= r[3] and k[3] >= r[2] for k in kept):
            kept.append(r)
    assert sorted(r["id"] for r in M.apply_chunks(sessions, spark.createDataFrame(rows, kind))[0].collect()) == sorted(r[0] for r in kept)


def test_sink_bears_repeated_batches(spark, tmp_path):
    """A batch that comes again after its commit changes nothing; a version without a commit is not read."""
    kind = "source_id string, source_path string, source_size long, source_modified_at timestamp_ntz"
    columns = "id string, source_id string, source_path string, source_size long, source_modified_at timestamp_ntz, source_checksum string, state string, resulting_node_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
    sink = EntrySink(spark, str(tmp_path / "entries"), spark.createDataFrame([], columns), C.at("2024-01-01"))
    one, two = (spark.createDataFrame([("s", p, n, dt.datetime(2024, 1, n))], kind) for p, n in (("a", 1), ("b", 2)))
    for number, batch in ((0, one), (0, two), (1, two), (1, one)):
        sink(batch, number)
    spark.createDataFrame([("x",)], "id string").write.parquet(str(tmp_path / "entries/data/broken/import_entries"))
    assert sorted(r["source_path"] for r in sink.entries().collect()) == ["a", "b"]
    assert snapshots.commits(spark, str(tmp_path / "entries")).count() == 2


def test_dedupe_lets_state_go(spark, tmp_path):
    """A repeat within the time is dropped; one that comes when the watermark has let the first go is a new chunk."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    kind = "session_id string, start_byte long, end_byte long, created_at timestamp"
    slices = [[("s", 0, 9, day(0)), ("s", 0, 9, day(0.4)), ("s", 0, 8, day(0))], [("s", 0, 9, day(0.9)), ("t", 0, 9, day(5))], [("u", 0, 1, day(6))], [("s", 0, 9, day(7)), ("v", 0, 0, day(30))]]
    out = put_out(spark, X.dedupe_chunks(slices_of(spark, str(tmp_path / "log"), slices, kind)), tmp_path, "append")
    assert sorted((r["session_id"], r["end_byte"]) for r in out) == [("s", 8), ("s", 9), ("s", 9), ("t", 9), ("u", 1), ("v", 0)]


def test_retention_leaves_out_what_was_restored(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    kinds = "node_id string, trashed_at timestamp", "node_id string, restored_at timestamp"
    for part, (trash, back) in enumerate([([("a", day(0)), ("b", day(0)), ("c", day(1))], [("b", day(5)), ("c", day(40))]), ([("z", day(200))], [("z2", day(200))]), ([("y", day(201))], [("y2", day(201))])]):
        spark.createDataFrame(trash, kinds[0]).coalesce(1).write.parquet(str(tmp_path / f"log/trash{part}"))
        spark.createDataFrame(back, kinds[1]).coalesce(1).write.parquet(str(tmp_path / f"log/back{part}"))
    read = lambda kind, name: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"log/{name}*"))
    out = X.stream_retention(read(kinds[0], "trash"), read(kinds[1], "back"))
    X.run_to_end(out, str(tmp_path / "checkpoint"), lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}")), "append")
    due = {r["node_id"]: r["purge_at"] for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out/*")).collect()}
    assert due == {"a": day(30), "c": day(31)}


def test_inventory_stream_upserts_like_one_scan(spark, tmp_path):
    """Three files in three batches: the entries are those of one upsert of all."""
    kind = "source_id string, source_path string, source_size long, source_modified_at timestamp_ntz"
    day = lambda n: dt.datetime(2024, 1, n)
    slices = [[("s", "a", 1, day(1)), ("s", "b", 2, day(1))], [("s", "b", 3, day(2)), ("s", "c", 4, day(2))], [("s", "a", 5, day(3))]]
    columns = "id string, source_id string, source_path string, source_size long, source_modified_at timestamp_ntz, source_checksum string, state string, resulting_node_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
    held = spark.createDataFrame([("1", "s", "b", 9, day(1), "x", "imported", "n", day(1), day(1)), ("2", "s", "d", 9, day(1), None, "failed", None, day(1), day(1))], columns)
    for rows in slices:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    sink = EntrySink(spark, str(tmp_path / "entries"), held, C.at("2024-02-01"))
    X.run_to_end(X.stream_inventory(spark, str(tmp_path / "log"), kind, 1), str(tmp_path / "checkpoint"), sink, "append")
    shown = lambda rows: sorted((r["source_path"], r["source_size"], r["state"], r["resulting_node_id"], r["source_modified_at"]) for r in rows.collect())
    assert shown(sink.entries()) == shown(M.upsert_import_entries(held, spark.createDataFrame(sum(slices, []), kind), C.at("2024-02-01")))
    assert snapshots.commits(spark, str(tmp_path / "entries")).count() == 3
