"""Inventories of file trees, facts about their content, and manifests."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filecat.functions.columns import is_hidden
from filecat.plans.cuts import cut

LISTING = "source_path string, source_size long, modified_us long, kind string"


def _entry(path: str, root: str) -> tuple | None:
    """The listing's row of a path; none if it went meanwhile."""
    try:
        s = os.lstat(path)
    except FileNotFoundError:
        return None
    kind = "hidden" if os.path.basename(path).startswith(".") else "directory" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "special"
    return os.path.relpath(path, root), s.st_size, s.st_mtime_ns // 1000, kind


def _real_root(root: str) -> str:
    if not stat.S_ISDIR(os.lstat(root).st_mode):
        raise ValueError(f"{root} is no real directory")
    return root


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _TreeReader(DataSourceReader):
    """One partition: folders below `root`, each after those above it. list_tree deals a tree out instead."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        _real_root(self.root)
        return [_Part(0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        todo = [self.root]
        while todo:
            for e in os.scandir(todo.pop()):
                row = _entry(e.path, self.root)
                if row:
                    yield row
                    if row[3] == "directory":
                        todo.append(e.path)


class FileTree(DataSource):
    """spark.read.format("filetree").load(root): every entry, links not followed, hidden folders not entered. For small trees: one task walks it."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").load(root)


def list_tree(spark: SparkSession, root: str, tasks: int | None = None, max_depth: int = 1000) -> DataFrame:
    """The same rows, level by level: the folders of a level are dealt out to `tasks` tasks, and so are the entries they name.

    A task reads names of its folders, which is quick however many there are; looking each entry up, which is
    slow, is dealt out anew, so neither a deep nor a wide folder is one task. As many rounds as the tree is
    deep; each level is cut off by a checkpoint. Executors have to see the root under the same path."""
    _real_root(root)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                found: list[str] = []
                try:
                    for e in os.scandir(folder):
                        found.append(e.path)
                        if len(found) == 10_000:
                            yield pd.DataFrame({"path": found})
                            found = []
                except FileNotFoundError:  # a folder that went meanwhile is empty
                    pass
                yield pd.DataFrame({"path": found}, dtype=object)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row + (path,) for path in batch["path"] if (row := _entry(path, root))]
            yield pd.DataFrame(rows, columns=["source_path", "source_size", "modified_us", "kind", "path"])

    level, levels = spark.createDataFrame([(root,)], "path string"), []
    while len(levels) <= max_depth:
        found = level.repartition(tasks).mapInPandas(names, "path string").repartition(tasks).mapInPandas(look, LISTING + ", path string")
        held = cut(found)
        if held.isEmpty():
            break
        levels.append(held.drop("path"))
        level = held.where("kind = 'directory'").select("path")
    else:
        raise ValueError(f"the tree has more than {max_depth} levels")
    return reduce(DataFrame.unionByName, levels) if levels else held.drop("path")


def file_inventory(listing: DataFrame, source_id: str, include_hidden: bool = False) -> DataFrame:
    """source_id, source_path, source_size, source_modified_at of the regular files of a listing."""
    files = listing.where("kind = 'file'")
    if not include_hidden:
        files = files.where(~is_hidden("source_path"))
    return files.select(F.lit(source_id).alias("source_id"), "source_path", "source_size", F.timestamp_micros("modified_us").cast("timestamp_ntz").alias("source_modified_at"))


def inventory_report(listing: DataFrame) -> DataFrame:
    """One row of counts: files, folders, topmost hidden entries (what is below them is not seen) and specials."""
    parts = F.split("source_path", "/")
    first = F.array_position(F.transform(parts, lambda c: F.startswith(c, F.lit("."))), True).cast("int")
    hidden = F.when(is_hidden("source_path"), F.array_join(F.slice(parts, F.lit(1), F.greatest(first, F.lit(1))), "/"))
    seen = ~is_hidden("source_path")
    return listing.agg(
        F.count_if(seen & (F.col("kind") == "file")).alias("files_discovered"), F.count_if(seen & (F.col("kind") == "directory")).alias("directories_discovered"),
        F.count_distinct(hidden).alias("hidden_entries_skipped"), F.count_if(seen & (F.col("kind") == "special")).alias("special_entries_skipped"),
    )


def inventory_folders(listing: DataFrame) -> DataFrame:
    """source_path of each folder that was entered, a row for each, in order."""
    return listing.where((F.col("kind") == "directory") & ~is_hidden("source_path")).select("source_path").orderBy("source_path")


def content_facts(files: DataFrame) -> DataFrame:
    """path, byte_size, checksum_sha256 of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("checksum_sha256"))


def large_content_facts(paths: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The same of paths alone, read block by block, for files that should not be a cell of a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for path in batch["path"]:
                digest, size = hashlib.sha256(), 0
                with open(path.removeprefix("file:"), "rb") as f:
                    while part := f.read(block):
                        digest.update(part)
                        size += len(part)
                rows.append((path, size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "byte_size", "checksum_sha256"])

    return paths.select("path").mapInPandas(run, "path string, byte_size long, checksum_sha256 string")


#: First bytes (hex), where they stand (from 0), and the type they tell.
MAGIC = [
    ("FFD8FF", 0, "image/jpeg"), ("89504E470D0A1A0A", 0, "image/png"), ("474946383761", 0, "image/gif"), ("474946383961", 0, "image/gif"), ("57454250", 8, "image/webp"), ("25504446", 0, "application/pdf"),
    ("494433", 0, "audio/mpeg"), ("FFFB", 0, "audio/mpeg"), ("FFF3", 0, "audio/mpeg"), ("664C6143", 0, "audio/flac"), ("57415645", 8, "audio/x-wav"), ("D0CF11E0A1B11AE1", 0, "application/msword"),
]
#: The brand in a file-type box, and atoms that a QuickTime file without one begins with.
BRANDS = {"M4A ": "audio/x-m4a", "M4B ": "audio/x-m4a", "qt  ": "video/quicktime", "M4V ": "video/x-m4v", "heic": "image/heic", "avif": "image/avif"}
ATOMS = ["moov", "mdat", "wide", "free", "skip"]
DOCTYPES = {"matroska": "video/x-matroska", "webm": "video/webm"}
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Bytes in which the end record of a ZIP file lies: its own 22 and the longest comment.
ZIP_TAIL = 22 + 65535


def _hex(text: str) -> str:
    return text.encode().hex().upper()


def _place(at: Column) -> Column:
    """A place as `substring` takes it (from 1); what lies beyond any content stays beyond it."""
    return (F.least(at, F.lit((1 << 31) - 2)) + 1).cast("int")


def _whole(content: Column, at: Column, size: int, little: Column | bool) -> Column:
    """The unsigned number of `size` bytes at a place (from 0)."""
    byte = lambda k: F.conv(F.hex(F.substring(content, _place(at + k), F.lit(1))), 16, 10).cast("long")
    low_first = sum((byte(k) * (1 << 8 * k) for k in range(1, size)), byte(0))
    if little is True:
        return low_first
    high_first = sum((byte(k) * (1 << 8 * (size - 1 - k)) for k in range(1, size)), byte(0) * (1 << 8 * (size - 1)))
    return F.when(little, low_first).otherwise(high_first)


def _tiff(content: Column) -> Column:
    """What a TIFF file is by the tags of its first directory: DNG has a version tag, NEF a maker that begins with NIKON."""
    little = F.substring(F.hex(F.substring(content, 1, 2)), 1, 4) == "4949"
    begin = _whole(content, F.lit(4).cast("long"), 4, little)
    count = _whole(content, begin, 2, little)
    places = F.when(count.between(1, 4096), F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: begin + 2 + 12 * k)).otherwise(F.array().cast("array<bigint>"))
    version = F.exists(places, lambda at: _whole(content, at, 2, little) == 0xC612)
    maker = F.exists(places, lambda at: (_whole(content, at, 2, little) == 0x010F) & (F.hex(F.substring(content, _place(_whole(content, at + 8, 4, little)), F.lit(5))) == _hex("NIKON")))
    return F.when(F.coalesce(version, F.lit(False)), "image/x-adobe-dng").when(F.coalesce(maker, F.lit(False)), "image/x-nikon-nef").otherwise("image/tiff")


def _ebml(raw: Column) -> Column:
    """The document type of an EBML header."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, mime in DOCTYPES.items():
        out = out.when(raw.rlike(f"^1A45DFA3(?:..)*?4282{0x80 + len(name):02X}{_hex(name)}"), mime)
    return out.otherwise("application/octet-stream")


def _is_docx(content: Column) -> Column:
    """Whether the central directory of a ZIP file, which its end record leads to, has both entries. Names elsewhere do not count."""
    tail = F.hex(F.substring(content, F.greatest(F.octet_length(content) - (ZIP_TAIL - 1), F.lit(1)), F.lit(ZIP_TAIL)))
    record = F.substring_index(tail, "504B0506", -1)
    number = lambda at: F.conv(F.concat(*(F.substring(record, 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    size, begin = number(8), number(12)
    sound = F.contains(tail, F.lit("504B0506")) & (F.length(record) % 2 == 0) & (begin + size <= F.octet_length(content))
    listed = F.hex(F.substring(content, _place(begin), F.least(size, F.lit((1 << 31) - 1)).cast("int")))
    entry = lambda name: listed.rlike(f"504B0102.{{48}}{len(name):02X}00.{{32}}{_hex(name)}")
    return F.coalesce(sound & entry("[Content_Types].xml") & entry("word/document.xml"), F.lit(False))


def detect_mime(content: Column) -> Column:
    """The type that the bytes tell, not the name: by first bytes, and inside containers by their own structure.

    A word that tells a container only from its fifth byte on (free, wide, WAVE) may be prose, so it does not count in what is text throughout."""
    raw = F.hex(F.substring(content, 1, 64))
    out = F.when(content.isNull(), F.lit(None).cast("string"))
    text = F.try_validate_utf8(content.cast("string"))
    prose = text.isNotNull() & ~F.contains(content, F.lit(bytearray(b"\0")))
    for magic, at, mime in MAGIC:
        found = F.substring(raw, 2 * at + 1, len(magic)) == magic
        out = out.when(found & ~prose if at else found, mime)
    box, brand = F.substring(raw, 9, 8), F.substring(raw, 17, 8)
    named = F.coalesce(*(F.when(brand == _hex(b), m) for b, m in BRANDS.items()), F.lit("video/mp4"))
    out = out.when((box == _hex("ftyp")) & ~prose, named).when(box.isin([_hex(a) for a in ATOMS]) & ~prose, "video/quicktime")
    out = out.when(F.startswith(raw, F.lit("1A45DFA3")), _ebml(raw)).when(F.substring(raw, 1, 8).isin("49492A00", "4D4D002A"), _tiff(content))
    zip_ = F.startswith(raw, F.lit("504B0304"))
    out = out.when(zip_ & _is_docx(content), DOCX).when(zip_, "application/zip")
    html = F.startswith(F.lower(F.ltrim(F.substring(text, 1, 64))), F.lit("<!doctype html"))
    return out.when(html, "text/html").when((F.octet_length(content) > 0) & prose, "text/plain").otherwise("application/octet-stream")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("source_path")).where("source_path <> ''").distinct()


def pending_files(listing: DataFrame, manifest: DataFrame, imported: DataFrame, key: str = "source_path") -> tuple[DataFrame, DataFrame]:
    """Files that neither list has, and a row of how many stubs and hidden ones were left out. key: the column that tells files apart."""
    done = manifest.select(key).union(imported.select(key)).distinct()
    stub = F.endswith("source_path", F.lit(".icloud"))
    wanted = listing.where(~stub & ~is_hidden("source_path")).join(done, key, "left_anti")
    return wanted, listing.agg(F.count_if(stub).alias("stubs"), F.count_if(~stub & is_hidden("source_path")).alias("hidden"))


def read_extractor_payloads(spark: SparkSession, path: str, extractor: str, version: str) -> DataFrame:
    """node_id (the file's name), extractor, its version and the whole JSON of a folder of payload files."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.json)?$", 1).alias("node_id"), F.col("value").alias("raw"))
    return rows.select("node_id", F.lit(extractor).alias("extractor_name"), F.lit(version).alias("extractor_version"), "raw", F.try_parse_json("raw").alias("payload"))
