"""Near-duplicates by SimHash fingerprints, compared bit-sliced.

Two fingerprints of 64 bits that differ in at most two bits agree in at least six of eight bands.
For each choice of two bands that may differ, fingerprints that agree in the other six form a group.
Within it only 16 bits are free, so it has at most 65,536 distinct fingerprints, however many documents
there are. A group's bits lie vertically in words of 64 fingerprints; carry-save counters add up 64
distances at a time and a word is abandoned once all of them exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import cut, documents, set_out, slices, texts_of
from filecat.llm.components import components

#: Pairs of 8 bit bands in which linked fingerprints may differ.
FREE = list(combinations(range(8), 2))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64 bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 15):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in parts[at : at + (1 << 15)]]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp of every row of docs; a null text has fingerprint 0, like any text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "fp": ([fingerprint(t, shingle, seed) for t in texts_of(batch)], pa.int64())})

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def near(query: np.ndarray, word: np.ndarray, planes: np.ndarray, radius: int = 2) -> np.ndarray:
    """Bit masks of the fingerprints in planes[word] within the radius (at most 2) of each query.

    query: 16 bit values; word: for each the row of planes; planes: (words, 16), a word of 64 for each bit."""
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    for bit in range(16):
        differ = planes[word[live], bit] ^ (np.uint64(0) - (query[live] >> np.uint64(bit) & np.uint64(1)))
        carry = ones & differ
        ones = ones ^ differ
        over = over | (twos & carry)
        twos = twos ^ carry
        if bit % 4 == 3 and bit < 15:
            far = over | (ones & twos) if radius == 2 else over | twos if radius == 1 else over | twos | ones
            keep = far != FULL
            live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
    far = over | (ones & twos) if radius == 2 else over | twos if radius == 1 else over | twos | ones
    out[live] = ~far
    return out


def free_bits(fps: np.ndarray, combo: np.ndarray) -> np.ndarray:
    """The 16 bits of the two bands of each combo."""
    bands = np.array(FREE)[combo].astype(np.uint64) * np.uint64(8)
    raw = fps.view(np.uint64)
    return (raw >> bands[:, 0] & np.uint64(255)) << np.uint64(8) | (raw >> bands[:, 1] & np.uint64(255))


def links(combo: np.ndarray, groups: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of fingerprints: pairs that tie together all that are linked within a group."""
    size = np.array([len(g) for g in groups])
    fps = np.concatenate(groups)
    value = free_bits(fps, np.repeat(combo, size))
    words = -(-size // 64)
    first_word, first = np.cumsum(words) - words, np.cumsum(size) - size
    within = np.arange(len(fps)) - np.repeat(first, size)
    lane = np.repeat(first_word, size) + within // 64
    planes = np.zeros((int(words.sum()), 16), np.uint64)
    spot = np.uint64(1) << (within % 64).astype(np.uint64)
    for bit in range(16):
        np.bitwise_or.at(planes[:, bit], lane, np.where(value >> np.uint64(bit) & np.uint64(1), spot, np.uint64(0)))
    used = np.zeros(len(planes), np.uint64)
    np.bitwise_or.at(used, lane, spot)
    last_word = np.repeat(first_word + words, size)
    span = last_word - lane  # each fingerprint meets its own word and the later ones of its group
    starts = np.concatenate([[0], np.cumsum(span)])
    parent: dict[tuple[int, int], int] = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    group = np.repeat(np.arange(len(groups)), size)
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 17), side="right")) - 1)
        row = np.repeat(np.arange(at, to), span[at:to])
        word = np.arange(len(row)) - np.repeat(starts[at:to] - starts[at], span[at:to]) + lane[row]
        mask = near(value[row], word, planes, radius) & used[word]
        own = word == lane[row]
        mask[own] &= ~((spot[row[own]] - np.uint64(1)) | spot[row[own]])
        hit = np.flatnonzero(mask)
        bits = np.unpackbits(mask[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        left = row[hit[k]]
        right = first[group[left]] + (word[hit[k]] - first_word[group[left]]) * 64 + bit
        a, b = [], []
        for x, y in zip(left.tolist(), right.tolist()):  # positions are unlike in unlike groups
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
        if a:
            yield fps[a], fps[b]
        at = to


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: pairs of the distinct fingerprints in fps (fp) within the radius; enough pairs to tie together all linked ones."""
    bands = [sum(255 << 8 * k for k in range(8) if k not in pair) for pair in FREE]
    signed = [m - (1 << 64) if m >> 63 else m for m in bands]
    keys = F.array(*[F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for k, m in enumerate(signed)])
    wide = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps Spark from joining small partitions that are about to grow 28-fold
    keyed = fps.repartition(wide, "fp").select("fp", F.explode(keys).alias("key")).select("fp", "key.combo", "key.rest")
    grouped = keyed.groupBy("combo", "rest").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("combo", "fps")  # at most 65,536 in each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            combo = batch.column("combo").to_numpy()
            lists = batch.column("fps")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            at = 0
            while at < len(combo):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 16), side="right")) - 1)
                for a, b in links(combo[at:to], [flat[ends[k] : ends[k + 1]] for k in range(at, to)], radius):
                    yield set_out({"a": (a, pa.int64()), "b": (b, pa.int64())})
                at = to

    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    component_id is the smallest doc_id that links lead to. Equal fingerprints are always linked; texts
    without words, null ones too, have fingerprint zero. Rows with a null doc_id take part and get their
    group's id (null if no row of the group has one); repeated rows are kept; an empty table gives an
    empty result. Copies are one fingerprint before anything is compared, so a group of copies costs no
    more than one text; the largest group that meets in a task has 65,536 fingerprints.
    """
    rows = cut(fingerprints(docs, shingle, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    tied = components(cut(fingerprint_links(distinct.select("fp"), radius)))
    nodes = distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    roots = nodes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    found = nodes.join(roots, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
