"""Manifests, payload folders and extractors."""

import io
import os
import stat
import struct
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from filecat.operators import listing as L
from filecat.operators import rollups as R
from filecat.sources import inventory as S
from filecat.sources.extractors import Registry


def paths(rows):
    return sorted(r["source_path"] for r in rows.collect())


def test_pending_files(spark, tmp_path):
    (tmp_path / "manifest.txt").write_text("a\n\n b \n")
    manifest = S.read_manifest(spark, str(tmp_path / "manifest.txt"))
    listing = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", ".e/f", "g.icloud")], "source_path string")
    wanted, skipped = S.pending_files(listing, manifest, spark.createDataFrame([("d",)], "source_path string"))
    assert paths(wanted) == ["c"] and tuple(skipped.first()) == (1, 1)


def test_payloads_stay_whole(spark, tmp_path):
    raw = '{"a": [1, 2.5, "x"], "b": null}\n'
    (tmp_path / "n1.json").write_text(raw)
    (tmp_path / "n2.json").write_text("{broken")
    rows = {r["node_id"]: r for r in S.read_extractor_payloads(spark, str(tmp_path), "tika", "v1").select("node_id", "raw", F.col("payload").isNull().alias("bad")).collect()}
    assert rows["n1"]["raw"] == raw and not rows["n1"]["bad"] and rows["n2"]["bad"]


def test_extractor_failures_become_records(spark):
    def lengths(frames):
        """An extractor that hangs, dies or fails on some files."""
        for frame in frames:
            for content in frame["content"]:
                if len(content) == 0:
                    raise ValueError("empty")
                if content == b"hang":
                    time.sleep(60)
                if content == b"die":
                    os._exit(3)
            yield pd.DataFrame({"node_id": frame["node_id"], "raw_payload": frame["content"].map(lambda c: f'{{"n": {len(c)}}}')})

    files = [("1", "image/png", b"abc"), ("2", "image/png", b""), ("3", "image/png", b"x" * 50), ("4", "audio/mpeg", b"y"), ("5", "image/png", b"hang"), ("6", "image/png", b"die"), ("7", "image/png", b"after"), ("8", "image/png", None), ("9", "audio/mpeg", b"hang")]
    registry = Registry()
    registry.register("exiftool", "v1", lengths, seconds=1, limit=40)
    registry.register("ffprobe", "v2", lengths, seconds=1)
    with pytest.raises(ValueError):
        registry.register("exiftool", "v3", lengths)
    df = spark.createDataFrame([(n, m, None if c is None else bytearray(c)) for n, m, c in files], "node_id string, mime_type string, content binary").coalesce(1)
    began = time.time()
    rows = {r["node_id"]: r for r in registry.run(df).collect()}
    assert time.time() - began < 30
    assert {k: r["status"] for k, r in rows.items()} == {"1": "completed", "2": "failed", "3": "failed", "4": "completed", "5": "failed", "6": "failed", "7": "completed", "8": "failed", "9": "failed"}
    assert rows["1"]["raw_payload"] == '{"n": 3}' and rows["7"]["raw_payload"] == '{"n": 5}' and rows["4"]["extractor_version"] == "v2"
    assert {k: rows[k]["warnings"] for k in "23568"} == {"2": ["empty"], "3": ["file is too large"], "5": ["extractor took longer than 1 s"], "6": ["extractor ended before it had a result"], "8": ["empty"]}
    with pytest.raises(ValueError):
        Registry().run(df)


def test_a_tree_is_dealt_out(spark, tmp_path):
    """A deep chain, a wide folder, links, hidden folders and specials: the rows of a plain walk, and the wide folder in many tasks."""
    deep = tmp_path
    for k in range(30):
        deep = deep / f"d{k}"
        deep.mkdir()
        (deep / "f.txt").write_text("x" * k)
    (tmp_path / "wide").mkdir()
    for k in range(600):
        (tmp_path / "wide" / f"w{k}").write_text("")
    (tmp_path / ".hidden/in").mkdir(parents=True)
    os.symlink(tmp_path / "wide", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    got = S.list_tree(spark, str(tmp_path), tasks=6)
    want = []
    for folder, folders, files in os.walk(tmp_path):
        folders[:] = [f for f in folders if not os.path.islink(os.path.join(folder, f))] if folder != str(tmp_path) else folders
        for name in folders + files:
            path = os.path.join(folder, name)
            s = os.lstat(path)
            want.append((os.path.relpath(path, tmp_path), "hidden" if name.startswith(".") else "directory" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "special", s.st_size))
        folders[:] = [f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(folder, f))]
    assert sorted((r["source_path"], r["kind"], r["source_size"]) for r in got.collect()) == sorted(want)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.read_tree(spark, str(tmp_path)).collect()))
    tasks = got.where("source_path LIKE 'wide/%'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 6 and max(r["count"] for r in tasks) < 200
    with pytest.raises(ValueError, match="no real directory"):
        S.list_tree(spark, str(tmp_path / "link"))


def tiff(tags, little=True):
    """A TIFF file with one directory of (tag, text) entries."""
    order = "<" if little else ">"
    data, at, entries = b"", 8 + 2 + 12 * len(tags) + 4, b""
    for tag, text in tags:
        raw = text + b"\0"
        entries += struct.pack(order + "HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(data)))
        data += raw if len(raw) > 4 else b""
    return (b"II*\0" if little else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(tags)) + entries + bytes(4) + data


def zipped(names, comment=b"", inside=b"x"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, inside)
        z.comment = comment
    return out.getvalue()


def test_types_by_structure(spark):
    word = ["[Content_Types].xml", "word/document.xml"]
    box = lambda brand: b"\0\0\0\x18ftyp" + brand + b"\0\0\2\0isommp41"
    cases = [
        (box(b"M4A "), "audio/x-m4a"), (box(b"qt  "), "video/quicktime"), (box(b"isom"), "video/mp4"), (box(b"mp42"), "video/mp4"), (b"\0\0\0\x08wide\0\0", "video/quicktime"),
        (b"\x1aE\xdf\xa3\x93\x42\x86\x81\x01\x42\x82\x88matroska", "video/x-matroska"), (b"\x1aE\xdf\xa3\x9f\x42\x82\x84webm\x42\x87", "video/webm"), (b"\x1aE\xdf\xa3\x93\x42\x82\x83abc", "application/octet-stream"),
        (tiff([(0x0100, b"1"), (0x010F, b"NIKON CORPORATION")]), "image/x-nikon-nef"), (tiff([(0x010F, b"Nikon?"), (0xC612, b"\1\4\0")], False), "image/x-adobe-dng"), (tiff([(0x010F, b"Canon")]), "image/tiff"), (b"II*\0", "image/tiff"), (b"II*\0\xff\xff\xff\x7f", "image/tiff"),
        (zipped(word), S.DOCX), (zipped(["a", *word], b"a comment"), S.DOCX), (zipped(["a"], inside=" ".join(word).encode()), "application/zip"), (zipped(["xword/document.xml", word[0]]), "application/zip"), (zipped([], b"word/document.xml [Content_Types].xml"), "application/octet-stream"), (b"PK\3\4 no end", "application/zip"),
        (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"GIF89a", "image/gif"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"%PDF-1.7", "application/pdf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/msword"), (b"ID3\4", "audio/mpeg"), (b"\xff\xfb\x90", "audio/mpeg"), (b"", "application/octet-stream"), (b"words", "text/plain"), (b"a\0b", "application/octet-stream"),
    ]
    df = spark.createDataFrame([(i, bytearray(raw)) for i, (raw, _) in enumerate(cases)] + [(99, None)], "i int, content binary")
    got = {r["i"]: r["mime"] for r in df.select("i", S.detect_mime(F.col("content")).alias("mime")).collect()}
    assert got == {i: mime for i, (_, mime) in enumerate(cases)} | {99: None}


def test_empty_and_odd_inputs(spark):
    usage = R.storage_usage(*(spark.createDataFrame([], s) for s in ("id string, lifecycle_state string", "node_id string, byte_size long, upload_state string", "state string, byte_size long")), total=0, used=0).first()
    assert tuple(usage) == (0, 0, 0, 0.0)
    assert R.job_count(spark.createDataFrame([("pending",), (None,)], "state string"), "").first()["n"] == 0
    entries = spark.createDataFrame([("t", "gone", None, None, None)], "id string, node_id string, original_parent_id string, trashed_at timestamp_ntz, scheduled_purge_at timestamp_ntz")
    nodes = spark.createDataFrame([], "id string, parent_id string, name string, kind string, lifecycle_state string")
    assert L.restore_parent(entries, nodes).first()["restore_to"] == "root"
