"""Lines that several documents share, found with two Bloom filters.

A first pass over the texts fills two filters with the hashes of each document's distinct lines: one of
what was seen once, one of what was seen a second time. Filters are filled where the texts are read and
merged slice by slice: what two of them have seen once each has been seen twice. A second pass meets the
second filter; only lines that it suspects (no repeat is missed) are shuffled, as digests, to be counted
exactly and to find the document that keeps them. A third pass drops the other lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import cut, set_out, slices, texts_of

#: Bytes of a slice of a filter, the unit that filters are merged in.
SLICE = 1 << 13
#: A filter has at most so many bits: what is sent to every task is an eighth of that in bytes. A fuller filter suspects more lines, which are then counted exactly.
MOST_BITS = 1 << 28
#: Bits that a hash sets.
HASHES = 3
#: Up to so many repeated lines are sent to every task (24 bytes each); beyond that documents are joined with what they lose.
FEW = 1 << 20


def key_of(line: bytes, least: int) -> bytes | None:
    """The line without white space at its ends and with A-Z in lower case, if it has `least` code points or more."""
    key = line.strip().lower()  # bytes: ASCII white space and letters alone
    return key if len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least) else None


def keys_of(text: bytes, least: int) -> set[bytes]:
    """The distinct keys of a text's lines."""
    return {key for line in set(text.split(b"\n")) if (key := key_of(line, least)) is not None}


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key (one row for each), by double hashing."""
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    return ((hashed[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in the filter."""
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at.ravel() >> 3, np.left_shift(np.uint8(1), (at.ravel() & 7).astype(np.uint8)))


class Filters:
    """What was seen once, and what was seen twice."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def see(self, keys: list[bytes]) -> None:
        """keys: each document's distinct keys, of any number of documents."""
        count: dict[bytes, int] = {}
        for key in keys:
            count[key] = count.get(key, 0) + 1
        at = places(list(count), self.bits)
        again = has(self.once, at) | (np.fromiter(count.values(), np.int64, len(count)) > 1)
        put(self.twice, at[again])
        put(self.once, at)

    def slices(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(0, len(self.once), SLICE):
            if self.once[k : k + SLICE].any():
                yield k // SLICE, self.once[k : k + SLICE].tobytes(), self.twice[k : k + SLICE].tobytes()


def merged(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two slices as one: what both have seen once was seen twice."""
    return own[0] | other[0], own[1] | other[1] | (own[0] & other[0])


def bits_for(lines: int) -> int:
    """About ten bits for each line, a power of two, within the bound."""
    return min(MOST_BITS, max(8 * SLICE, 1 << (10 * max(lines, 1) - 1).bit_length()))


def keyed(docs: DataFrame, carried: list[str] = ()) -> DataFrame:
    """doc_id, text, carried columns and a key without nulls; rows that are alike in doc_id and text have one key: they lose the same lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in carried))
    return rows.withColumn("k1", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("k2", F.xxhash64("text", F.col("doc_id").isNull()))


def repeated_filter(rows: DataFrame, least: int) -> np.ndarray:
    """The filter of what was seen twice or more, of at most MOST_BITS bits."""
    lines = rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) + 1)).first()[0] or 0  # one number
    bits = bits_for(lines)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in slices(batches):
            filters.see([key for text in texts_of(batch) for key in keys_of(text, least)])
        for k, once, twice in filters.slices():
            yield set_out({"slice": ([k], pa.int32()), "once": ([once], pa.binary()), "twice": ([twice], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            for k, once, twice in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice"))):
                new = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if k != at and now is not None:
                    yield set_out({"slice": ([at], pa.int32()), "twice": ([now[1].tobytes()], pa.binary())})
                at, now = k, (new if k != at else merged(now, new))
        if now is not None:
            yield set_out({"slice": ([at], pa.int32()), "twice": ([now[1].tobytes()], pa.binary())})

    own = rows.select("text").mapInArrow(fill, "slice int, once binary, twice binary")
    whole = own.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in whole.collect():  # at most MOST_BITS / 8 bytes in all
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["twice"], np.uint8)
    return out


def suspects(rows: DataFrame, twice: np.ndarray, least: int) -> DataFrame:
    """k1, k2, doc_id, line (a SHA-256) of the distinct keys of every text that the filter suspects."""
    shared = rows.sparkSession.sparkContext.broadcast(twice)  # at most MOST_BITS / 8 bytes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for batch in slices(batches):
            own, keys = [], []
            for k, text in enumerate(texts_of(batch)):
                found = keys_of(text, least)
                own += [k] * len(found)
                keys += found
            hit = np.flatnonzero(has(filter_, places(keys, 8 * len(filter_))))
            which = pa.array(np.asarray(own, np.int64)[hit])
            yield set_out({c: (batch.column(c).take(which), pa.int64()) for c in ("k1", "k2", "doc_id")} | {"line": ([hashlib.sha256(keys[i]).digest() for i in hit.tolist()], pa.binary())})

    return rows.mapInArrow(find, "k1 long, k2 long, doc_id long, line binary")


def shared_lines(docs: DataFrame, least: int, documents: int) -> tuple[DataFrame, DataFrame]:
    """The suspects, and line, keeper of the lines that so many different documents hold; keeper: the largest doc_id."""
    found = cut(suspects(docs, repeated_filter(docs, least), least))
    counted = found.groupBy("line").agg((F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"), F.max("doc_id").alias("keeper"))
    return found, cut(counted.where(F.col("n") >= documents).select("line", "keeper"))


def dedupe_lines(docs: DataFrame, least: int = 20, documents: int = 3, carried: list[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, kept_sha256 and the carried columns of every row of docs.

    A line goes if its key has `least` code points or more and is found in at least `documents` documents,
    unless this document is the one with the largest doc_id of them; lines that stay are joined by \\n. A null
    or empty text is one empty line. Rows with one doc_id are one document, and all of them keep what it
    keeps; rows without doc_id are one document before all others; an empty table gives an empty result;
    further columns are not read. Texts are read three times and shuffled only where more than FEW lines
    are shared; then each meets the digests that its document loses.
    """
    rows = keyed(docs, carried)
    found, known = shared_lines(rows, least, documents)
    few = known.count() <= FEW
    if few:
        table = sorted((r["line"][:16], -1 if r["keeper"] is None else r["keeper"], r["keeper"] is None) for r in known.collect())  # at most FEW; 128 bits name a line
        shared = rows.sparkSession.sparkContext.broadcast((np.array([x[0] for x in table], "S16"), np.array([x[1] for x in table], np.int64), np.array([x[2] for x in table], bool)))
    else:
        lost = found.join(known, "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("k1", "k2").agg(F.collect_set("line").alias("lost"))  # no more than a text has lines
        rows = rows.join(lost, ["k1", "k2"], "left")

    def known_to_all(doc_id: int | None, lines: list[bytes]) -> list[bool]:
        names, keeper, none = shared.value
        if not len(names):
            return [False] * len(lines)
        own = np.array(lines, "S16")
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        same = none[at] if doc_id is None else (keeper[at] == doc_id) & ~none[at]
        return ((names[at] == own) & ~same).tolist()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count, dropped, kept = [], [], []
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            gone = [None] * len(texts) if few else batch.column("lost").to_pylist()
            for text, doc_id, lost in zip(texts, ids, gone):
                lines = text.split(b"\n")
                stay = np.ones(len(lines), bool)
                at = [i for i, line in enumerate(lines) if key_of(line, least) is not None] if few or lost else []
                if at:
                    names = [hashlib.sha256(key_of(lines[i], least)).digest() for i in at]
                    gone_here = set(lost or ())
                    stay[at] = [not x for x in (known_to_all(doc_id, [n[:16] for n in names]) if few else [n in gone_here for n in names])]
                count.append(len(lines))
                dropped.append(int((~stay).sum()))
                kept.append(b"\n".join(line for line, x in zip(lines, stay.tolist()) if x) if dropped[-1] else text)
            yield set_out({
                "doc_id": (batch.column("doc_id"), pa.int64()), "n_lines": (count, pa.int64()), "n_dropped": (dropped, pa.int64()),
                "kept_text": (pa.array(kept, pa.binary()).cast(pa.string()), pa.string()), "kept_sha256": ([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            } | {c: (batch.column(c), batch.schema.field(c).type) for c in carried})

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(strip, "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string" + more)
