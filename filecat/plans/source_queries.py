"""Registered queries of inventories, payload folders, snapshots, extractors and the path index, each beside the SQL that checks it.

Trees of files are written from the given tables into the shared folder first, by the executors."""

from __future__ import annotations

import io
import json
import os
import struct
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecat.functions import columns as C
from filecat.operators import paths as P
from filecat.plans.cuts import shared_dir
from filecat.plans.derived import Catalog, duck_sql
from filecat.plans.read_queries import MOVES, PATHS, SELECTED
from filecat.sources import inventory as S
from filecat.sources import snapshots
from filecat.sources.extractors import Registry

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str, more: str = "") -> Callable:
    def take(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        ORACLES[f.__name__] = duck_sql(sql, more)
        return f

    return take


def new_folder(cat: Catalog) -> str:
    """A path of a folder below the shared one, as the operating system of every executor names it."""
    return f"{shared_dir(cat._spark).rstrip('/').removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, content, link) below root; a repeated task writes the same again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, link in zip(batch["path"], batch["content"], batch["link"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if link:
                    if not os.path.islink(full):
                        os.symlink(root, full)
                else:
                    with open(full, "wb") as f:
                        f.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    os.makedirs(root, exist_ok=True)
    files.select("path", "content", "link").mapInPandas(run, "n long").agg(F.sum("n")).collect()


#: An uneven tree of the pages: a wide folder, chains, hidden folders and files, links.
TREE = """SELECT page_id, html, page_id % 17 = 4 AND page_id % 10 > 1 AS link, CASE WHEN page_id % 10 = 0 THEN concat('.h', page_id % 3, '/p', page_id) WHEN page_id % 50 = 3 THEN concat(repeat('deep/', CAST(page_id % 20 + 1 AS INTEGER)), 'p', page_id)
  WHEN page_id % 2 = 0 THEN concat('wide/p', page_id) ELSE concat('d', page_id % 13, '/e', page_id % 7, '/', CASE WHEN page_id % 10 = 1 THEN '.x' ELSE '' END, 'p', page_id, '.html') END AS path FROM pages"""
IN_TREE = f"t AS ({TREE}), seen AS (SELECT * FROM t WHERE concat('/', path) NOT LIKE '%/.%'), dirs AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS path FROM (SELECT string_split(path, '/') AS parts, path FROM t) x, range(1, CAST(len(parts) AS BIGINT)) AS r(k) WHERE parts[1] NOT LIKE '.%')"


def tree(cat: Catalog) -> DataFrame:
    root = new_folder(cat)
    write_tree(cat.sql(TREE).select("path", F.col("html").cast("binary").alias("content"), "link"), root)
    return S.list_tree(cat._spark, root)


@registered("SELECT 'inbox' AS source_id, path AS source_path, CAST(strlen(html) AS BIGINT) AS source_size FROM seen WHERE NOT link", IN_TREE)
def file_inventory(cat):
    return S.file_inventory(tree(cat), "inbox").select("source_id", "source_path", "source_size")


@registered("SELECT (SELECT count(*) FROM seen WHERE NOT link) AS files_discovered, (SELECT count(*) FROM dirs) AS directories_discovered, (SELECT count(DISTINCT CASE WHEN path LIKE '.%' THEN string_split(path, '/')[1] ELSE path END) FROM t WHERE concat('/', path) LIKE '%/.%') AS hidden_entries_skipped, (SELECT count(*) FROM seen WHERE link) AS special_entries_skipped", IN_TREE)
def inventory_report(cat):
    return S.inventory_report(tree(cat))


@registered("SELECT path AS source_path FROM dirs", IN_TREE)
def inventory_folders(cat):
    return S.inventory_folders(tree(cat))


@registered("SELECT concat('n', page_id) AS node_id, 'tika' AS extractor_name, 'adapter-v1' AS extractor_version, sha256(CASE WHEN page_id % 6 = 0 THEN html ELSE concat('{\"id\": ', page_id, ', \"length\": ', length(html), '}') END) AS raw_sha256, page_id % 6 > 0 AS readable FROM pages")
def extractor_payloads(cat):
    root = new_folder(cat)
    raw = cat.sql("SELECT concat('n', page_id, '.json') AS path, CASE WHEN page_id % 6 = 0 THEN html ELSE concat('{\"id\": ', page_id, ', \"length\": ', length(html), '}') END AS raw FROM pages")
    write_tree(raw.select("path", F.col("raw").cast("binary").alias("content"), F.lit(False).alias("link")), root)
    rows = S.read_extractor_payloads(cat._spark, f"file://{root}", "tika", "adapter-v1")
    return rows.select("node_id", "extractor_name", "extractor_version", F.sha2("raw", 256).alias("raw_sha256"), F.col("payload").isNotNull().alias("readable"))


@registered("SELECT id, parent_id, name, lifecycle_state FROM nodes WHERE lifecycle_state = 'active'")
def catalog_snapshot(cat):
    """Nodes as they come back: a first version, and a second one made from what was read of it."""
    folder = f"{shared_dir(cat._spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    snapshots.save(cat._spark, {"nodes": cat.nodes, "favorites": cat.favorites}, folder, "first")
    held = snapshots.load(cat._spark, folder)
    snapshots.save(cat._spark, held | {"nodes": held["nodes"].where("lifecycle_state = 'active'")}, folder, "second")
    return snapshots.load(cat._spark, folder)["nodes"].select("id", "parent_id", "name", "lifecycle_state")


def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An extractor that hangs on some files and dies on others."""
    for frame in frames:
        for node in frame["node_id"]:
            if int(node[1:]) % 97 == 5:
                time.sleep(60)
            if int(node[1:]) % 89 == 7:
                os._exit(1)
        yield pd.DataFrame({"node_id": frame["node_id"], "raw_payload": [json.dumps({"bytes": len(c)}) for c in frame["content"]]})


@registered(
    """SELECT concat('d', doc_id) AS node_id, CASE doc_id % 3 WHEN 0 THEN 'exiftool' ELSE 'ffprobe' END AS extractor_name, CASE doc_id % 3 WHEN 0 THEN 'v3' ELSE 'v1' END AS extractor_version, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN concat('{"bytes": ', strlen(coalesce(text, '')), '}') ELSE concat('{"error": "', error, '"}') END AS raw_payload
  FROM (SELECT *, CASE WHEN strlen(coalesce(text, '')) > 20000 THEN 'file is too large' WHEN doc_id % 97 = 5 THEN 'extractor took longer than 0.4 s' WHEN doc_id % 89 = 7 THEN 'extractor ended before it had a result' END AS error FROM documents WHERE doc_id % 3 < 2) x"""
)
def extractor_registry(cat):
    registry = Registry()
    registry.register("exiftool", "v3", sizes, seconds=0.4, limit=20_000)
    registry.register("ffprobe", "v1", sizes, seconds=0.4, limit=20_000)
    files = cat.sql("SELECT concat('d', doc_id) AS node_id, CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'audio/mpeg' ELSE 'application/pdf' END AS mime_type, CAST(text AS BINARY) AS content FROM documents")
    return registry.run(files).select("node_id", "extractor_name", "extractor_version", "status", "raw_payload")


def _tiff(little: bool, tags: list[tuple[int, bytes]]) -> bytes:
    order, at = ("<" if little else ">"), 8 + 2 + 12 * len(tags) + 4
    entries, data = b"", b""
    for tag, raw in tags:
        entries += struct.pack(order + "HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(data)))
        data += raw if len(raw) > 4 else b""
    return (b"II*\0" if little else b"MM\0*") + struct.pack(order + "IH", 8, len(tags)) + entries + bytes(4) + data


def _zip(names: list[str], inside: str = "x") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(zipfile.ZipInfo(name), inside)
    return out.getvalue()


def _box(brand: bytes) -> bytes:
    return b"\0\0\0\x18ftyp" + brand + b"\0\0\2\0isommp41"


#: Files of the acceptance matrix, and of some that resemble them: bytes that may go on with anything (or not), and the type.
MATRIX = [
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", True, "application/msword"), (_zip(["[Content_Types].xml", "word/document.xml"]), False, S.DOCX), (b"%PDF-1.7\n", True, "application/pdf"), (b"\xff\xd8\xff\xe0", True, "image/jpeg"), (b"GIF89a", True, "image/gif"), (b"\x89PNG\r\n\x1a\n", True, "image/png"),
    (_tiff(True, [(0x0100, b"12"), (0x010F, b"NIKON CORPORATION\0")]), True, "image/x-nikon-nef"), (_tiff(False, [(0x010F, b"NIKON\0"), (0x0110, b"D7\0")]), True, "image/x-nikon-nef"), (_tiff(False, [(0x010F, b"Leica\0"), (0xC612, b"\1\4\0\0")]), True, "image/x-adobe-dng"), (_tiff(True, [(0xC612, b"\1\4\0\0")]), True, "image/x-adobe-dng"),
    (_box(b"isom"), True, "video/mp4"), (b"\x1aE\xdf\xa3\x93B\x86\x81\1B\x82\x88matroska", True, "video/x-matroska"), (_box(b"qt  "), True, "video/quicktime"), (b"ID3\4\0\0", True, "audio/mpeg"), (_box(b"M4A "), True, "audio/x-m4a"),
    (_zip(["notes.txt"], "[Content_Types].xml word/document.xml"), False, "application/zip"), (b"\x1aE\xdf\xa3\x9fB\x82\x84webm", True, "video/webm"), (_tiff(True, [(0x010F, b"Other\0\0")]), True, "image/tiff"),
]


@registered("SELECT concat('o', o_orderkey) AS path, [" + ", ".join(f"'{m}'" for *_, m in MATRIX) + f"][CAST(o_orderkey % {len(MATRIX)} AS INTEGER) + 1] AS mime FROM orders")
def mime_matrix(cat):
    rows = cat.sql(f"SELECT concat('o', o_orderkey) AS path, CAST(o_orderkey % {len(MATRIX)} AS INT) AS k, CAST(o_comment AS BINARY) AS rest FROM orders") if "o_comment" in cat.sql("SELECT * FROM orders").columns else cat.sql(f"SELECT concat('o', o_orderkey) AS path, CAST(o_orderkey % {len(MATRIX)} AS INT) AS k, CAST(concat(o_orderkey, ' ', o_totalprice) AS BINARY) AS rest FROM orders")
    begin = F.element_at(F.array(*(F.lit(bytearray(raw)) for raw, *_ in MATRIX)), F.col("k") + 1)
    open_ended = F.col("k").isin([i for i, (_, more, _) in enumerate(MATRIX) if more])
    content = F.when(open_ended, F.concat(begin, F.lit(bytearray(8)), F.col("rest"))).otherwise(begin)
    return rows.select("path", S.detect_mime(content).alias("mime"))


# --- the path index


@registered("SELECT DISTINCT s.id FROM s JOIN paths p ON p.id = s.id WHERE NOT EXISTS (SELECT 1 FROM unnest(p.ids) AS u(aid) JOIN s x ON x.id = u.aid WHERE u.aid <> s.id)", PATHS + f", s AS ({SELECTED})")
def indexed_selection(cat):
    return P.unnested(P.path_index(cat.nodes), cat.sql(SELECTED))


@registered("SELECT m.id, m.target_id, list_contains(p.ids, m.id) AS cycle FROM m JOIN paths p ON p.id = m.target_id", PATHS + f", m AS ({MOVES})")
def indexed_cycles(cat):
    return P.cycles(P.path_index(cat.nodes), cat.sql(MOVES))


@registered("SELECT id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM paths", PATHS)
def indexed_paths(cat):
    return P.virtual_paths(P.path_index(cat.nodes))


#: Customers to other nations, nations to other regions, and a region below another region's nation.
BATCH = """SELECT concat('c', c_custkey) AS id, concat('n', (c_nationkey + 1) % 25) AS target_id FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT concat('n', n_nationkey), concat('r', (n_regionkey + 1) % 5) FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'r0', concat('n', min(n_nationkey)) FROM nation WHERE n_regionkey = 2 AND n_nationkey % 5 > 0"""


@registered(
    "SELECT id, array_to_string(ids, '/') AS path_ids, path FROM after",
    f"b AS ({BATCH}), placed AS (SELECT n.id, coalesce(b.target_id, n.parent_id) AS parent_id, n.name FROM nodes n LEFT JOIN b ON b.id = n.id), after(id, ids, path) AS (SELECT id, [id], '' FROM placed WHERE parent_id IS NULL UNION ALL SELECT n.id, list_append(p.ids, n.id), concat(p.path, '/', n.name) FROM after p JOIN placed n ON n.parent_id = p.id)",
)
def moved_paths(cat):
    """The index of all nodes after a batch of moves, some of which carry others' targets along."""
    after = P.moved(P.path_index(cat.nodes), cat.sql(BATCH))
    return after.select("id", F.array_join("path_ids", "/").alias("path_ids"), F.array_join(F.slice("path_names", F.lit(2), F.size("path_names")), "/").alias("tail")).select("id", "path_ids", F.when(F.col("tail") == "", "").otherwise(F.concat(F.lit("/"), F.col("tail"))).alias("path"))


SCAN = "SELECT CASE state WHEN 'discovered' THEN 'discovered' WHEN 'imported' THEN 'imported' WHEN 'failed' THEN 'failed' WHEN 'stable' THEN 'skipped' ELSE 'unstable' END AS outcome FROM import_entries"


@registered(
    "SELECT count(*) FILTER (WHERE state = 'discovered') AS discovered, count(*) FILTER (WHERE state = 'imported') AS imported, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'stable') AS skipped, (SELECT count(DISTINCT CASE WHEN path LIKE '.%' THEN string_split(path, '/')[1] ELSE path END) FROM t WHERE concat('/', path) LIKE '%/.%') AS skipped_hidden, (SELECT count(*) FROM seen WHERE link) AS skipped_special FROM import_entries",
    IN_TREE,
)
def scan_report(cat):
    from filecat.operators.rollups import scan_summary

    return scan_summary(cat.sql(SCAN), S.inventory_report(tree(cat)))


@registered("SELECT id, 'name_conflict' AS message FROM (SELECT id, row_number() OVER (PARTITION BY source_path ORDER BY id) AS nth FROM e WHERE state = 'importing') x WHERE nth > 1", "e AS (SELECT concat('e', o_orderkey) AS id, concat('in/', o_orderkey % 40, '/', CASE WHEN o_orderkey % 10 = 0 THEN 'same' ELSE concat('f', o_orderkey) END) AS source_path, CASE WHEN o_orderkey % 3 = 0 THEN 'importing' ELSE 'imported' END AS state FROM orders)")
def recovery_failures(cat):
    from filecat.plans.derived import NOW
    from filecat.plans.maintenance import recover_interrupted
    from filecat.plans.maintenance_queries import FILES

    return recover_interrupted(cat.nodes, cat.sql(FILES), "root", C.at(NOW))[3]
