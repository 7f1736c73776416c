"""Small scenarios whose results are known."""

import os
import random

import pytest
from pyspark.sql import functions as F

from filecat import schemas
from filecat.functions import columns as C
from filecat.operators import listing as L
from filecat.operators import normalize as N
from filecat.operators import paths as P
from filecat.operators import rollups as R
from filecat.operators import tree as T
from filecat.plans import maintenance as M
from filecat.sources import inventory as S
from filecat.sources import snapshots

NODES = "id string, parent_id string, name string, kind string, lifecycle_state string, created_at timestamp_ntz, updated_at timestamp_ntz"


def nodes(spark, *rows):
    rows = [("root", None, "", "folder", "active"), *rows]
    return spark.createDataFrame([(*r, None, None) for r in rows], NODES)


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.collect())


def test_pages_and_cursor(spark):
    n = nodes(spark, *((x, "root", x, "folder", "active") for x in ("Charlie", "Alpha", "Bravo")), ("A file", "root", "A file", "file", "active"))
    base = L.listing_base(n, spark.createDataFrame([], "node_id string, byte_size long, mime_type string, upload_state string"), spark.createDataFrame([], "node_id string, media_kind string"))
    page = L.children_pages(base, limit=2).orderBy("rank").collect()
    assert [(r["name"], r["has_more"]) for r in page] == [("Alpha", True), ("Bravo", True)]
    cursor = spark.createDataFrame([("root", "Bravo")], "parent_id string, cursor_id string")
    assert ids(L.after_cursor(base, cursor), "name") == ["A file", "Charlie"]
    assert ids(L.after_cursor(base, cursor, reference_cursor=True), "name") == ["Charlie"]  # skips the file, whose name sorts before
    assert L.after_cursor(base, spark.createDataFrame([("root", "other")], "parent_id string, cursor_id string")).count() == 0
    with pytest.raises(ValueError):
        L.parse_kinds("image,song")


def test_sibling_and_cycle_rules(spark):
    n = nodes(spark, ("p", "root", "Photos", "folder", "active"), ("a", "root", "Archive", "folder", "trashed"), ("c", "p", "child", "folder", "active"), ("u", "root", "unrelated", "folder", "active"))
    reqs = spark.createDataFrame([("root", x) for x in ("Photos", "photos", "Archive")], "parent_id string, name string")
    assert {r["name"]: r["name_taken"] for r in L.child_name_exists(n, reqs).collect()} == {"Photos": True, "photos": False, "Archive": False}
    moves = spark.createDataFrame([("p", "p"), ("p", "c"), ("p", "u")], "id string, target_id string")
    assert {r["target_id"]: r["cycle"] for r in T.cycle_check(n, moves).collect()} == {"p": True, "c": True, "u": False}
    with pytest.raises(ValueError):
        T.descend(spark.createDataFrame([("x", "y", "", "folder", "active", None, None), ("y", "x", "", "folder", "active", None, None)], NODES), spark.createDataFrame([("x",)], "id string"), max_depth=5)


def test_tree_of_files_is_scanned(spark, tmp_path):
    for p in ("note.txt", "photos/2024/image.jpg", ".private/secret.txt", "_kept.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    os.symlink(tmp_path / "note.txt", tmp_path / "link.txt")
    listing = S.read_tree(spark, str(tmp_path))
    assert ids(S.file_inventory(listing, "s"), "source_path") == ["_kept.txt", "note.txt", "photos/2024/image.jpg"]
    report = S.inventory_report(listing).first()
    assert (report["files_discovered"], report["directories_discovered"], report["hidden_entries_skipped"], report["special_entries_skipped"]) == (3, 2, 1, 1)
    assert [r["source_path"] for r in S.inventory_folders(listing).collect()] == ["photos", "photos/2024"]
    small = S.content_facts(spark.read.format("binaryFile").load(str(tmp_path / "note.txt")))
    large = S.large_content_facts(small.select("path"), block=3)
    assert small.collect() == large.collect()
    with pytest.raises(Exception, match="no real directory"):
        S.read_tree(spark, str(tmp_path / "link.txt")).count()


def test_queue(spark):
    kind = "id string, job_type string, target_node_id string, state string, priority int, attempts int, max_attempts int, lease_expires_at timestamp_ntz, created_at timestamp_ntz"
    none = spark.createDataFrame([], kind)
    reqs = spark.createDataFrame([("1", "metadata_extraction", "n"), ("2", "metadata_extraction", "n")], "id string, job_type string, target_node_id string").withColumn("created_at", C.at("2024-01-01"))
    jobs = M.plan_work(none, reqs).withColumn("lease_expires_at", F.lit(None).cast("timestamp_ntz"))
    assert ids(jobs) == ["1"] and M.plan_work(jobs, reqs).count() == 0
    leased = M.backlog_plan(jobs, 1, C.at("2024-01-01"))
    assert [(r["state"], r["attempts"]) for r in leased.collect()] == [("leased", 1)]
    failed = M.fold_attempts(leased, spark.createDataFrame([("1", False, "broken")], "id string, ok boolean, error string"))
    assert [(r["state"], r["last_error"]) for r in failed.collect()] == [("pending", "broken")]
    assert [r["state"] for r in M.fold_attempts(leased, spark.createDataFrame([("1", True, None)], "id string, ok boolean, error string")).collect()] == ["completed"]
    assert M.stale_leases(leased, C.at("2024-01-01 00:05:00")).count() == 0  # strictly before
    assert M.stale_leases(leased, C.at("2024-01-01 00:05:01")).count() == 1


def test_scalar_functions(spark):
    rows = spark.createDataFrame([(x,) for x in ("bytes=2-5", "bytes=7-", "bytes=-3", "bytes=10-12", "bytes=0-1,3-4", "bytes=-", "bytes=5-2", None)], "h string")
    got = [tuple(r[0]) if r[0] else None for r in rows.select(C.parse_byte_range("h", F.lit(10))).collect()]
    assert got == [(2, 5, 4), (7, 9, 3), (7, 9, 3), None, None, None, None, None]
    one = spark.range(1)
    guard = one.select(*(C.projected_percent(F.lit(1000), F.lit(u), F.lit(i)) for u, i in ((850, 0), (850, 50), (910, 0)))).first()
    assert tuple(guard) == (85, 90, 91)
    sizes = [(999, "999 B"), (1000, "1.0 KB"), (9949, "9.9 KB"), (9950, "10.0 KB"), (9999, "10.0 KB"), (10_000, "10 KB"), (123456789, "123 MB"), (None, "—")]
    frame = spark.createDataFrame(sizes, "b long, want string")
    assert all(r["want"] == r["got"] for r in frame.select("want", C.format_size("b", F.lit("file")).alias("got")).collect())
    texts = one.select(C.format_duration(F.lit(59500)), C.safe_filename(F.lit('a"b\\c\r\n')), C.storage_key(F.lit("a-b")), C.is_hidden(F.lit("a/.b/c")), C.is_safe_relative(F.lit("a/../b")), C.fit_box(F.lit(1024), F.lit(512))).first()
    assert tuple(texts)[:5] == ("1:00", "a_b_c__", "ab", True, False) and tuple(texts[5]) == (256, 128)


@pytest.mark.parametrize("content, mime", [
    (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"%PDF-1.7", "application/pdf"), (b"\0\0\0\x18ftypmp42", "video/mp4"), (b"ID3\x03", "audio/mpeg"),
    (b"PK\x03\x04 [Content_Types].xml word/document.xml", "application/zip"), (b"PK\x03\x04", "application/zip"), (b"<!DOCTYPE html><p>", "text/html"), (b"plain", "text/plain"), (b"", "application/octet-stream"), (b"\xfe\xfe", "application/octet-stream"),
])
def test_mime_of_bytes(spark, content, mime):
    rows = spark.createDataFrame([(bytearray(content),)], "c binary")
    assert rows.select(S.detect_mime(F.col("c"))).first()[0] == mime


def test_first_key_wins_even_if_null(spark):
    raw = '[{"ImageWidth":null,"ExifImageWidth":5,"ImageHeight":"7","GPSLatitude":1.5,"Orientation":9,"Make":" "}]'
    row = N.normalize_exif(spark.createDataFrame([("n", raw)], "node_id string, raw string").select("node_id", F.try_parse_json("raw").alias("payload"))).first()
    assert (row["width"], row["height"], row["camera_make"], row["gps_latitude"]) == (None, 7, None, None)
    assert row["warnings"] == ["image dimensions are missing", "only one GPS coordinate is present", "orientation is outside the EXIF range 1 through 8"]
    bad = N.parsed_records(spark.createDataFrame([("n", "x", "{")], "node_id string, extractor_name string, raw string")).first()
    assert bad["status"] == "failed"


def test_restore_undoes_trash(spark):
    n = nodes(spark, ("a", "root", "a", "folder", "active"), ("b", "a", "b", "file", "active"))
    entries = spark.createDataFrame([], schemas.schema("trash_entries"))
    favorites = spark.createDataFrame([("b", None)], schemas.schema("favorites"))
    gone, more, left, result = M.trash_nodes(n, entries, favorites, spark.createDataFrame([("x", "a"), ("x", "b")], "batch string, id string"), C.at("2024-01-01"))
    assert ids(more, "node_id") == ["a"] and left.count() == 0 and result.first()["outcome"] == "ok"
    back, empty, results = M.restore_nodes(gone, more, spark.createDataFrame([("1", "a")], "request_id string, id string"), C.at("2024-01-02"))
    assert empty.count() == 0 and results.first()["outcome"] == "ok"
    assert {(r["id"], r["parent_id"], r["lifecycle_state"]) for r in back.collect()} == {(r["id"], r["parent_id"], r["lifecycle_state"]) for r in n.collect()}


def test_byte_ranges_beyond_64_bits(spark):
    """An end beyond the file is its end, up to 64 bits; larger numbers make the range invalid."""
    cases = [("bytes=0-18446744073709551615", (0, 99, 100)), ("bytes=0-18446744073709551616", None), ("bytes=0-" + "9" * 40, None), ("bytes=99999999999999999999-", None), ("bytes=-18446744073709551615", (0, 99, 100)), ("bytes=-" + "1" * 30, None), ("bytes=5-9223372036854775808", (5, 99, 95)), ("bytes=7-", (7, 99, 93)), ("bytes=-0", None)]
    rows = spark.createDataFrame([(h,) for h, _ in cases], "h string").select("h", C.parse_byte_range("h", F.lit(100)).alias("r")).collect()
    assert {r["h"]: None if r["r"] is None else tuple(r["r"]) for r in rows} == dict(cases)


def test_blank_texts_and_odd_numbers(spark):
    """Line ends and other white space alone are no text; numbers may begin or end with a point."""
    raw = [("a", '[{"Make": "\\n\\t", "Model": "\\u00a0\\u2003", "GPSLatitude": ".5", "GPSLongitude": "5."}]'), ("b", '[{"Make": " x ", "Model": 7, "GPSLatitude": ".", "GPSLongitude": "1e2"}]')]
    rows = spark.createDataFrame(raw, "node_id string, raw string").select("node_id", F.try_parse_json("raw").alias("payload"))
    got = {r["node_id"]: tuple(r[c] for c in ("camera_make", "camera_model", "gps_latitude", "gps_longitude")) for r in N.normalize_exif(rows).collect()}
    assert got == {"a": (None, None, 0.5, 5.0), "b": (" x ", "7", None, None)}


def test_gaps_and_ranges_make_the_whole(spark):
    sessions = spark.createDataFrame([("s", 100), ("t", 0)], "id string, expected_byte_size long")
    chunks = spark.createDataFrame([("1", "s", 10, 19), ("2", "s", 15, 30), ("3", "s", 90, 120)], "id string, session_id string, start_byte long, end_byte long")
    gaps = [(r["start_byte"], r["end_byte"]) for r in R.missing_ranges(sessions, chunks).orderBy("start_byte").collect()]
    assert gaps == [(0, 9), (31, 89)]


def test_constraints_are_counted(spark):
    n = nodes(spark, ("a", "root", "x", "folder", "active"), ("b", "root", "x", "folder", "active"), ("c", "c", "y", "pipe", "active"))
    assert {r["rule"]: r["n"] for r in schemas.violations("nodes", n).collect()} == {"not_own_parent": 1, "kind_value": 1, "sibling_name": 1}


def test_snapshot_round_trip(spark, tmp_path):
    """All tables come back; a later save is a new version; a write that broke off is invisible; a step of a walk leaves `nodes` where it is."""
    folder = str(tmp_path / "catalog")
    assert snapshots.load(spark, folder) == {}
    tables = {t: spark.createDataFrame([], schemas.schema(t)) for t in schemas.TABLES}
    n = nodes(spark, *((f"f{i}", "root" if i < 5 else f"f{i % 5}", f"n{i}", "folder", "active") for i in range(200)))
    first = snapshots.save(spark, tables | {"nodes": n}, folder, "first")
    found = snapshots.load(spark, folder)
    assert set(found) == set(schemas.TABLES) and sorted(map(tuple, found["nodes"].select(n.columns).collect()), key=str) == sorted(map(tuple, n.collect()), key=str)
    with pytest.raises(Exception):
        snapshots.save(spark, {"nodes": found["nodes"], "jobs": spark.range(3).select(F.assert_true(F.col("id") < 1).alias("x"))}, folder, "broken")
    assert snapshots.newest(spark, folder)["version"] == first and not snapshots.committed(spark, folder, "broken")
    snapshots.save(spark, {"nodes": found["nodes"].where("id <> 'f7'")}, folder, "second")
    assert snapshots.load(spark, folder)["nodes"].count() == 200 and snapshots.load(spark, folder, first)["nodes"].count() == 201
    held = snapshots.load(spark, folder)["nodes"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        level = spark.createDataFrame([("f1",), ("f2",)], "start string")
        step = level.join(held.select("id", "parent_id"), F.col("start") == F.col("parent_id"))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and step.count() == 77
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_path_index_follows_moves(spark):
    """The index after a batch of moves, some of them below each other, is the index of the moved tree; lookups equal the walks."""
    rng = random.Random(6)
    rows = [(f"f{i}", "root" if i < 6 else f"f{rng.randint(max(0, i - 30), i - 1)}", f"n{i}", "folder", "trashed" if i % 9 == 0 else "active") for i in range(300)]
    rows += [(f"d{i}", f"d{i - 1}" if i else "root", f"d{i}", "folder", "active") for i in range(70)] + [("lost", "nowhere", "x", "file", "active")]
    n = nodes(spark, *rows)
    index = P.path_index(n)
    walked = T.with_paths(n)
    shown = lambda found: {r["id"]: tuple(r["path_ids"]) for r in found.collect()}
    assert shown(index) == shown(walked)
    assert {tuple(r) for r in P.virtual_paths(index).collect()} == {tuple(r) for r in T.virtual_path(walked).collect()}
    selected = spark.createDataFrame([(f"f{i}",) for i in range(0, 300, 7)] + [("d3",), ("d60",), ("lost",)], "id string")
    assert ids(P.unnested(index, selected)) == ids(T.drop_nested_selection(n, selected))
    moves = spark.createDataFrame([("f10", "d30"), ("d40", "f11"), ("d2", "f3"), ("f12", "root"), ("f10", "f10"), ("d1", "d69")], "id string, target_id string")
    cycle = lambda found: sorted((r["id"], r["target_id"], r["cycle"]) for r in found.collect())
    assert cycle(P.cycles(index, moves)) == cycle(T.cycle_check(n, moves))
    good = spark.createDataFrame([("f10", "d30"), ("d2", "f3"), ("f12", "root"), ("d40", "f12")], "id string, target_id string")
    after = n.join(good, "id", "left").withColumn("parent_id", F.coalesce("target_id", "parent_id"))
    assert shown(P.moved(index, good)) == shown(P.path_index(after)) == shown(T.with_paths(after))
    reqs = spark.createDataFrame([("1", "d0/./d1/../d1", "/"), ("2", "/n1", "/x"), ("3", "no", "/")], "request_id string, path string, cwd string")
    assert {tuple(r) for r in P.resolve(index, reqs).collect()} == {tuple(r) for r in T.resolve_paths(n, reqs).collect()}
    with pytest.raises(ValueError):
        P.moved(index, spark.createDataFrame([("d0", "f3"), ("f3", "d5")], "id string, target_id string")).count()
    with pytest.raises(ValueError):
        P.path_index(nodes(spark, ("x", "y", "", "folder", "active"), ("y", "x", "", "folder", "active")), max_depth=16)


def test_ranges_of_a_large_session(spark):
    """J9 over 200,000 chunks and 2,000 requests of one session, and against the plain join on a small one."""
    large = spark.range(200_000).selectExpr("'s' AS session_id", "id * 10 AS start_byte", "id * 10 + id % 7 AS end_byte")
    reqs = spark.range(2000).selectExpr("concat('q', id) AS request_id", "'s' AS session_id", "id * 997 + 7 AS start", "id * 997 + 9 AS end")
    want = {f"q{i}": any(k * 10 <= i * 997 + 9 and k * 10 + k % 7 >= i * 997 + 7 for k in range((i * 997) // 10 - 1, (i * 997) // 10 + 3)) for i in range(2000)}
    assert {r["request_id"]: r["overlaps"] for r in R.range_overlaps(large, reqs).collect()} == want
    rng = random.Random(2)
    chunks = [(rng.choice("ab"), a := rng.randint(0, 500), a + rng.choice([0, 3, 200])) for _ in range(30)] + [(None, 0, 900)]
    asked = [(f"q{i}", rng.choice(["a", "b", "c", None]), a := rng.randint(0, 700), a + rng.randint(0, 20)) for i in range(200)]
    got = R.range_overlaps(spark.createDataFrame(chunks, "session_id string, start_byte long, end_byte long"), spark.createDataFrame(asked, "request_id string, session_id string, start long, end long"))
    assert {r["request_id"]: r["overlaps"] for r in got.collect()} == {q: any(s is not None and s == c[0] and c[1] <= e and c[2] >= b for c in chunks) for q, s, b, e in asked}
