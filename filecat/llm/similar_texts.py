"""Near-duplicates by the share of word shingles in common, found with wide SimHash fingerprints compared bit-sliced.

A pair is linked if its sets of five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints
have 512 bits; at that similarity two differ in 78 bits on average. Texts meet in blocks, one for each of
6 bands of four shingle minima (24 pairs of 25 of similarity 0.8 share one). In a block bits lie vertically, 64 fingerprints to a word, and
carry-save counters add up 64 distances at a time, until all of a word's exceed the radius. What is left
is decided by the shingle sets themselves.

Blocks are dealt into parts of bounded size; rows of one part lie next to each other in a sorted
partition and are read as a stream, with ids and fingerprints alone. Of each part only the nearest pairs
that tie together what may be similar are checked, so a large group of copies costs about as many checks
as it has texts and bands.

Blocks and radius miss some pairs, so a last pass misses none: a pair with the share in common has in
common some of the shingles that come first in each set, in an order of all shingles. Rare ones come
first; they are told by counts of a fixed number of buckets, which steer the work and not the result.
Texts of unlike components that meet in one of these where their sizes allow it are decided by their
sets, whatever their prints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.common import cut as checkpointed
from filecat.llm.common import release, set_out, slices, texts_of
from filecat.llm.components import components
from filecat.llm.words import BASE, cut, hashes, mixed, rolling

BITS, RADIUS, BANDS, ROWS = 512, 106, 6, 4
#: Rows of a part, on average.
PART = 512
#: So many digests of texts are sent to every task at most.
FEW = 1 << 18
#: Texts are made to shingles in slices of so many bytes.
SLICE = 2 << 20
#: Buckets of shingles whose counts tell which are rare.
BUCKETS = 1 << 16
#: Cells whose counts bound what two sets have in common.
CELLS = 256
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)
#: One for each word of a fingerprint, and an odd one for each minimum.
SALTS = BASE * np.arange(1, BITS // 64 + 1, dtype=np.uint64)
TURNS = mixed(BASE * np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles, A-Z lower-cased; a shorter text is one shingle, as is one without words."""
    words, bounds = cut([t.lower() for t in texts])
    hashed = hashes(words, int(bounds[-1]))
    grams = rolling(hashed, shingle)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        own = grams[a : b - shingle + 1] if b - a >= shingle else rolling(hashed[a:b], b - a) if b > a else np.zeros(1, np.uint64)
        out.append(np.unique(own))
    return out


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set: 64 bytes of fingerprint, and a key for each band."""
    size = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.cumsum(size) - size
    pieces = -(-size // 255)  # a byte counts up to 255
    piece_first = np.cumsum(pieces) - pieces
    starts = np.repeat(first, pieces) + (np.arange(int(pieces.sum())) - np.repeat(piece_first, pieces)) * 255
    bits = np.zeros((len(sets), BITS), bool)
    for word in range(BITS // 64):
        x = mixed(flat ^ SALTS[word])
        for k in range(8):
            lanes = np.add.reduceat(x >> np.uint64(k) & LANES, starts).view(np.uint8).reshape(-1, 8).astype(np.int32)
            bits[:, word * 64 + k * 8 : word * 64 + k * 8 + 8] = 2 * np.add.reduceat(lanes, piece_first) > size[:, None]
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            keys[:, band] = mixed(keys[:, band] * BASE + np.minimum.reduceat(flat * TURNS[band * ROWS + row], first))
    return np.packbits(bits, axis=1), keys


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in each lane."""
    half = a ^ b
    return half ^ c, a & b | half & c


def near(query: np.ndarray, word: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit masks of the fingerprints in planes[word] within the radius of each query.

    query: (n, bits) of 0 or all ones; word: for each the row of planes; planes: (words, bits)."""
    top = max(3, radius.bit_length())
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    # the counters begin so high that they run over just when a distance exceeds the radius
    begin = (1 << top) - 1 - radius
    counter = [np.full(len(query), FULL if begin >> k & 1 else 0, np.uint64) for k in range(top)]
    over = np.zeros(len(query), np.uint64)
    bits = planes.shape[1]
    for at in range(0, bits, 8):
        x = [planes[word[live], at + k] ^ query[live, at + k] for k in range(8)]
        ones, a = added(counter[0], x[0], x[1])
        ones, b = added(ones, x[2], x[3])
        twos, c = added(counter[1], a, b)
        ones, a = added(ones, x[4], x[5])
        counter[0], b = added(ones, x[6], x[7])
        counter[1], d = added(twos, a, b)
        counter[2], carry = added(counter[2], c, d)
        for k in range(3, top):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if at % 64 == 56 and at + 8 < bits:
            keep = over != FULL
            if not keep.all():
                live, over, counter = live[keep], over[keep], [c[keep] for c in counter]
    out[live] = ~over
    return out


def block_pairs(raw: np.ndarray, sizes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, in groups that lie one after another.

    raw: (rows, bytes) fingerprints; sizes: rows of each group; queries: how many rows, from a group's
    first on, meet the others of the group; if all do, each pair is met once."""
    start = np.cumsum(sizes) - sizes
    own = queries == sizes
    target = np.where(own, start, start + queries)
    count = start + sizes - target
    words = -(-count // 64)
    word_first = np.cumsum(words) - words
    bits = np.unpackbits(raw, axis=1)
    spread = np.zeros((int(words.sum()) * 64, bits.shape[1]), np.uint8)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    spread[np.repeat(word_first, count) * 64 + within] = bits[np.repeat(target, count) + within]
    planes = np.ascontiguousarray(np.packbits(spread.reshape(-1, 64, bits.shape[1]), axis=1, bitorder="little").transpose(0, 2, 1)).view("<u8")[:, :, 0]
    del spread
    masks = np.uint64(0) - bits.astype(np.uint64)
    group = np.repeat(np.arange(len(sizes)), queries)
    row = np.arange(len(group)) - np.repeat(np.cumsum(queries) - queries, queries) + start[group]
    begin = word_first[group] + np.where(own[group], (row - start[group]) // 64, 0)
    span = word_first[group] + words[group] - begin
    ends = np.concatenate([[0], np.cumsum(span)])
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 14), side="right")) - 1)
        k = np.repeat(np.arange(at, to), span[at:to])
        word = np.arange(len(k)) - np.repeat(ends[at:to] - ends[at], span[at:to]) + begin[k]
        mask = np.zeros(len(k), np.uint64)
        for part in range(0, len(k), 1 << 12):
            mask[part : part + (1 << 12)] = near(masks[row[k[part : part + (1 << 12)]]], word[part : part + (1 << 12)], planes, radius)
        hit = np.flatnonzero(mask)
        lane = np.unpackbits(mask[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, bit = np.nonzero(lane)
        g = group[k[hit[i]]]
        place = (word[hit[i]] - word_first[g]) * 64 + bit
        left, right = row[k[hit[i]]], target[g] + place
        good = (place < count[g]) & (~own[g] | (right > left))
        yield left[good], right[good]
        at = to


class Ties:
    """Rows that are tied together so far."""

    def __init__(self, rows: int):
        self.parent = list(range(rows))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def tie(self, x: int, y: int) -> bool:
        """Whether this ties what was not tied before."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def forest(left: np.ndarray, right: np.ndarray, distance: np.ndarray, rows: int) -> np.ndarray:
    """Which pairs, nearest first, tie together all rows that any pair ties."""
    ties, order = Ties(rows), np.argsort(distance, kind="stable")
    return np.array([k for k, x, y in zip(order.tolist(), left[order].tolist(), right[order].tolist()) if ties.tie(x, y)], np.int64)


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 12) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows, some at a time, and the rows of each; only the group that is being read is held over."""
    held: list[pa.RecordBatch] = []

    def ready(table: pa.Table, last: bool) -> tuple[list[tuple[pa.Table, np.ndarray]], pa.Table]:
        own = [table.column(k).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in own], axis=0)) + 1
        bounds, out, at = np.concatenate([[0], edge, [table.num_rows] if last else []]).astype(np.int64), [], 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + rows, side="right")) - 1)
            out.append((table.slice(bounds[at], bounds[to] - bounds[at]), np.diff(bounds[at : to + 1])))
            at = to
        return out, table.slice(bounds[-1])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            out, rest = ready(pa.Table.from_batches(held), False)
            yield from out
            held = rest.combine_chunks().to_batches()
    if held:
        yield from ready(pa.Table.from_batches(held), True)[0]


def nearest_pairs(parts: DataFrame, share: float) -> DataFrame:
    """a < b: pairs that may be similar by fingerprint and number of shingles, nearest first, as many as tie together what may be in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in in_groups(batches, ["band", "key", "part"]):
            n, cid = rows.column("n").to_numpy(), rows.column("cid").to_numpy()
            raw = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint8).reshape(len(n), -1)
            quads, found = raw.view(np.uint64), []
            for left, right in block_pairs(raw, sizes, sizes):
                good = np.minimum(n[left], n[right]) >= share * np.maximum(n[left], n[right])
                left, right = left[good], right[good]
                distance = np.bitwise_count(quads[left] ^ quads[right]).sum(axis=1)
                pick = forest(left, right, distance, len(n))
                found.append((left[pick], right[pick], distance[pick]))
            if found:
                left, right, distance = map(np.concatenate, zip(*found))
                pick = forest(left, right, distance, len(n))
                x, y = cid[left[pick]], cid[right[pick]]
                yield set_out({"a": (np.minimum(x, y), pa.string()), "b": (np.maximum(x, y), pa.string())})

    place = ["band", "key", "part"]
    return parts.select(*place, "cid", "n", "fp").repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a string, b string").distinct()


def asked_texts(asked: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """cid, text of the texts asked for; a text that several rows with one doc_id have comes as often."""
    asked = asked.join(nodes.select("cid", F.col("first_key").alias("doc_key")), "cid")
    few = asked.count() <= FEW  # then the texts themselves need no shuffle
    return texts.join(F.broadcast(asked) if few else asked, ["cid", "doc_key"]).select("cid", "text")


def cells_of(asked: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """cid, size (distinct shingles), cells (how many of them are in each cell) of the texts asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            found = [s.view(np.int64) for s in shingle_sets(texts_of(batch), shingle)]
            cells = [np.bincount(s % CELLS, minlength=CELLS).astype(np.int32) for s in found]
            yield set_out({"cid": (batch.column("cid"), pa.string()), "size": ([len(s) for s in found], pa.int64()), "cells": (cells, pa.list_(pa.int32()))})

    return checkpointed(asked_texts(asked, texts, nodes).mapInArrow(run, "cid string, size long, cells array<int>").dropDuplicates(["cid"]))


def sets_of(asked: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """cid, items (sorted hashes of the distinct shingles) of the texts asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            found = [np.sort(s.view(np.int64)) for s in shingle_sets(texts_of(batch), shingle)]
            yield set_out({"cid": (batch.column("cid"), pa.string()), "items": (found, pa.list_(pa.int64()))})

    return checkpointed(asked_texts(asked, texts, nodes).dropDuplicates(["cid"]).mapInArrow(run, "cid string, items array<long>"))


def similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, share: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least share.

    Two sets have no more in common than the lesser counts of their cells add up to: sets are made and
    sent only for pairs for which that suffices."""
    ends = lambda of: checkpointed(of.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    cells = cells_of(ends(pairs), texts, nodes, shingle)
    counted = pairs.join(cells.toDF("a", "n_p", "p"), "a").join(cells.toDF("b", "n_q", "q"), "b")
    most = F.aggregate(F.zip_with("p", "q", lambda x, y: F.least(x, y)), F.lit(0), lambda total, n: total + n)
    pairs = checkpointed(counted.where((1 + share) * most >= share * (F.col("n_p") + F.col("n_q")) - 1e-6).select("a", "b"))
    del cells, counted
    release(pairs.sparkSession)
    items = sets_of(ends(pairs), texts, nodes, shingle)
    both = pairs.join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") >= share * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def bucket_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of texts are in each bucket: a fixed number of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, limit=SLICE):
            own = np.concatenate(shingle_sets(texts_of(batch), shingle))
            count += np.bincount((own % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(count)
        yield set_out({"bucket": (some, pa.int64()), "n": (count[some], pa.int64())})

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def leading(own: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """The shingles of a set that come first, so many that any set with the share in common has one of them among its own."""
    least = math.ceil(share * len(own) - 1e-9)  # a similar set has so many of these at least
    order = np.lexsort((own, counts[(own % np.uint64(BUCKETS)).astype(np.int64)]))
    return own[order[: len(own) - least + 1]]


def missed_pairs(texts: DataFrame, nodes: DataFrame, tied: DataFrame, shingle: int, share: float) -> DataFrame:
    """a < b: all pairs of texts of unlike components that may be similar, by number of shingles and by where their leading ones meet.

    Sets of n and m shingles that have the share in common have o = share / (1 + share) * (n + m) of them
    in common at least. So the first that they share has o - 1 more behind it in both: it is among the
    first n - o + 1 of one and the first m - o + 1 of the other. In the smaller set that is less than the
    leading ones, since o is least if both are equally large: only those first are looked up.
    The meetings there and what lies behind the last of them must then suffice for o.
    """
    counts = bucket_counts(texts, shingle)
    release(texts.sparkSession)
    part = share / (1 + share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            found = [leading(x, counts, share).view(np.int64) for x in shingle_sets(texts_of(batch), shingle)]
            yield set_out({"cid": (batch.column("cid"), pa.string()), "leading": (found, pa.list_(pa.int64()))})

    first = texts.select("cid", "text").mapInArrow(run, "cid string, leading array<long>").groupBy("cid").agg(F.first("leading").alias("leading"))
    comps = nodes.select("cid", "n").join(tied, "cid", "left").select("cid", "n", F.xxhash64("cid").alias("node"), F.xxhash64(F.coalesce("root", "cid")).alias("comp"))
    rows = first.join(comps, "cid").select("node", "comp", "n", F.posexplode("leading").alias("at", "key"))
    sought = F.col("at") <= F.col("n") - F.ceil(2 * part * F.col("n") - 1e-6)  # as the smaller set of a pair
    here, own = Window.partitionBy("key"), F.when(sought, F.col("comp"))
    bounds = {"low": F.min("comp").over(here), "high": F.max("comp").over(here), "own_low": F.min(own).over(here), "own_high": F.max(own).over(here)}
    meets = F.when(sought, F.col("low") != F.col("high")).otherwise((F.col("own_low") != F.col("comp")) | (F.col("own_high") != F.col("comp")))
    met = checkpointed(rows.withColumns(bounds).where(meets).select("node", "comp", "n", "at", "key"))
    left, right = met.where(sought).toDF("a", "comp_a", "n_a", "at_a", "key"), met.toDF("b", "comp_b", "n_b", "at_b", "key")
    least = F.ceil(part * (F.col("n_a") + F.col("n_b")) - 1e-6)
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))
    alike = (F.col("comp_a") != F.col("comp_b")) & (F.col("n_a") >= share * F.col("n_b") - 1e-6)
    pairs = left.join(right, "key").where(smaller & alike & (F.col("at_a") <= F.col("n_a") - least) & (F.col("at_b") <= F.col("n_b") - least))
    both = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    behind = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    left_over = checkpointed(both.where(F.col("common") + behind >= least).select("a", "b"))
    names = comps.select("cid", "node")  # texts whose cids have one hash are all asked for
    named = left_over.join(names.toDF("x", "a"), "a").join(names.toDF("y", "b"), "b")
    return checkpointed(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def grouped_rows(docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """doc_id, cid (of the text), root (of the group) of every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"cid": F.md5("text"), "doc_key": F.coalesce("doc_id", F.lit(-1).cast("long"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            sets = shingle_sets(texts_of(batch), shingle)
            raw, keys = prints(sets)
            yield set_out({
                "doc_id": (batch.column("doc_id"), pa.int64()), "doc_key": (batch.column("doc_key"), pa.int64()), "cid": (batch.column("cid"), pa.string()),
                "n": ([len(s) for s in sets], pa.int64()), "fp": ([r.tobytes() for r in raw], pa.binary()), "keys": (list(keys.view(np.int64)), pa.list_(pa.int64())),
            })

    rows = checkpointed(texts.mapInArrow(run, "doc_id long, doc_key long, cid string, n long, fp binary, keys array<long>"))
    nodes = checkpointed(rows.groupBy("cid").agg(F.min("doc_key").alias("first_key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("cid", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = keyed.join(shared, ["band", "key"]).join(nodes.select("cid", "n", "fp"), "cid")
    parts = blocks.withColumn("part", F.pmod(F.xxhash64("cid", "band"), F.ceil(F.col("size") / F.lit(PART)).cast("long")))

    tried = checkpointed(nearest_pairs(parts, share))
    links = checkpointed(similar(tried, texts, nodes, shingle, share))
    tied = components(links).withColumnRenamed("node", "cid")
    missed = missed_pairs(texts, nodes, tied, shingle, share)
    release(docs.sparkSession)
    more = similar(missed, texts, nodes, shingle, share)
    # later links tie groups to one another
    ends = more.join(tied.toDF("a", "from"), "a", "left").join(tied.toDF("b", "to"), "b", "left")
    groups = components(checkpointed(ends.select(F.coalesce("from", "a").alias("a"), F.coalesce("to", "b").alias("b")))).toDF("first_root", "last_root")
    of = rows.select("doc_id", "cid").join(tied, "cid", "left").withColumn("first_root", F.coalesce("root", "cid"))
    return of.join(groups, "first_root", "left").select("doc_id", "cid", F.coalesce("last_root", "first_root").alias("root"))


def similar_groups(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that links lead to) of every row of docs.

    Equal texts are one text before anything is compared. Texts without words, null ones too, are alike;
    a text of fewer words than a shingle is one shingle. Rows with a null doc_id take part and get their
    group's id (null if no row of the group has one); repeated rows are kept; an empty table gives an
    empty result; further columns are not read.
    """
    rows = checkpointed(grouped_rows(docs, shingle, share))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """One row of docs of each group of near-duplicates, all columns: that with the smallest doc_id (nulls last), of these the one whose text's digest is least.

    Rows that share a doc_id but not their text are documents of their own. Of repeated rows one stays;
    an empty table gives an empty result."""
    rows = grouped_rows(docs, shingle, share)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cid")
    chosen = checkpointed(rows.groupBy("root").agg(F.min(order).alias("one")).select("one.doc_id", "one.cid"))
    del rows
    release(docs.sparkSession)
    # one key without nulls: then the join and the removal of repeated rows share one shuffle of the texts
    key = lambda doc_id, cid: F.concat(cid, F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))
    keyed = docs.withColumn("_key", key(F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    kept = keyed.join(chosen.select(key(F.col("doc_id"), F.col("cid")).alias("_key")), "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).drop("_key")
