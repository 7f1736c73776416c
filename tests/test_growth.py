"""Work that grows no faster than the input: what is parsed, written and called for each row."""

import time

import pandas as pd
from pyspark.sql import functions as F

from filecat.llm.similar_texts import one_of_each
from filecat.plans import content_queries as Q
from filecat.plans.derived import Catalog
from filecat.plans.stream_queries import arriving
from filecat.sources.extractors import Registry
from filecat.streaming import streams as X
from tests.test_oracles import SF


def test_only_favorites_are_parsed(spark, monkeypatch):
    seen, whole = [], Q.N.normalize_ffprobe
    monkeypatch.setattr(Q.N, "normalize_ffprobe", lambda payloads: seen.append(payloads.count()) or whole(payloads))
    Q.QUERIES["media_streams"](spark, SF).collect()
    assert seen == [Catalog(spark, SF).favorites.count()]


def test_a_log_is_made_once(spark, tmp_path):
    """Its slices come from one pass over it, in the order of `arrives`, and hold every row once."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    log = spark.range(400, numPartitions=4).selectExpr("id", "id * 5 AS arrives").mapInPandas(counted, "id long, arrives long")
    sizes = [spark.read.parquet(str(tmp_path / "log")).count() for _ in arriving(log, str(tmp_path / "log"), 8)]
    assert sizes == [50 * k for k in range(1, 9)] and spark.read.parquet(str(tmp_path / "log")).distinct().count() == 400
    assert made.value == 800  # once for the ends, once for the slices


class Cell:
    """A value state and a handle in one, which count what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_bucket_of_jobs_costs_one_visit(spark):
    job, cell, n = X.JobState(1), Cell(), 500
    job.init(cell)
    frame = pd.DataFrame({"job_id": [f"j{i}" for i in range(n)], "seq": 0, "event": "claimed", "at_us": range(1, n + 1), "lease_us": [9000.0] * n, "max_attempts": 2})
    assert not list(job.handleInputRows((7,), iter([frame]), cell))  # all wait for the watermark
    assert cell.calls < 10 and cell.timers == [1]
    sessions = spark.range(300).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("c").alias("id"), F.lit(0).cast("long").alias("start_byte"), F.lit(9).cast("long").alias("end_byte"), F.lit(5).cast("long").alias("created_us"), F.lit(100).cast("long").alias("expires_us"))
    upload, cell = X.UploadProgress(), Cell()
    upload.init(cell)
    (out,) = upload.handleInputRows((7,), iter([sessions.toPandas()]), cell)
    assert len(out) == 300 and set(out["received"]) == {10} and set(out["state"]) == {"active"} and cell.calls < 10


def test_children_that_hang_do_not_wait_for_each_other(spark):
    """Sixteen files of one task on which the extractor hangs for a second each; the others have their records."""
    registry = Registry()

    def reads(frames):
        for frame in frames:
            if frame["content"][0] == b"hang":
                time.sleep(60)
            yield pd.DataFrame({"node_id": frame["node_id"], "raw_payload": [c.decode() for c in frame["content"]]})

    registry.register("exiftool", "v1", reads, seconds=1)
    files = spark.createDataFrame([(f"n{i}", "image/png", bytearray(b"hang" if i % 4 == 0 else b"%d" % i)) for i in range(64)], "node_id string, mime_type string, content binary").coalesce(1)
    began = time.time()
    got = {r["node_id"]: (r["status"], r["raw_payload"]) for r in registry.run(files).collect()}
    assert time.time() - began < 12
    assert got == {f"n{i}": ("failed", '{"error": "extractor took longer than 1 s"}') if i % 4 == 0 else ("completed", str(i)) for i in range(64)}


def test_texts_are_shuffled_once_for_those_that_stay(spark):
    """The join with the chosen rows and the removal of repeated rows take one exchange of the texts."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c d e f g h"), (3, None)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = one_of_each(docs)
        exchanges = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        got = sorted((r["doc_id"], r["text"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == [(1, "a b"), (2, "c d e f g h"), (3, None)]
    assert len(exchanges) == 2  # the texts' and the chosen rows'
