"""Passages that occur elsewhere, found by counting windows around the anchors that texts share.

This stands in for a relative Lempel-Ziv parse (see the README): nothing is parsed against reference blocks.
An index entry is an anchor, the least hash of the 12-word shingles in some 35-word window. Equal windows
have equal anchors, so a window without a repeated anchor can't be copied; around repeated anchors windows
are counted by a 64 bit hash of their words, without a comparison of the words themselves. Windows that
occur twice or more are the duplicate spans. Copies of one entry within a slice are joined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.common import set_out, slices, texts_of
from filecat.llm.words import covered, cut, hashes, inside, rolling, sliding

WINDOW, SHINGLE = 35, 12
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def windows(texts: list[bytes], window: int, shingle: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their bounds, their hashes, the hash of each shingle, the least one in each window, and the windows that lie in one text."""
    words, bounds = cut(texts)
    hashed = hashes(words, int(bounds[-1]))
    grams = rolling(hashed, shingle)
    least = sliding(grams, window - shingle + 1, True)
    return words, bounds, hashed, grams, least, inside(bounds, window)


def anchors(texts: list[bytes], window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the shingles that are the least in some window."""
    _, bounds, _, grams, least, valid = windows(texts, window, shingle)
    if not valid.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    width = window - shingle + 1
    shown = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, 0), np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((sliding(shown, width, False) == grams) & (grams != 0))
    text = np.searchsorted(bounds, at, side="right") - 1
    return text, at - bounds[text], grams[at]


def repeated_windows(texts: list[bytes], marked: list[np.ndarray], window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of windows whose least shingle is at one of the text's marked positions."""
    _, bounds, hashed, grams, least, valid = windows(texts, window, shingle)
    again = np.full(len(grams), TOP)
    at = np.concatenate([m + b for m, b in zip(marked, bounds)]) if len(texts) else np.zeros(0, np.int64)
    again[at] = grams[at]
    starts = np.flatnonzero(valid & (sliding(again, window - shingle + 1, True) == least))
    text = np.searchsorted(bounds, starts, side="right") - 1
    return text, starts - bounds[text], rolling(hashed, window)[starts]


def joined(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a copy in this slice, and one entry to stand for each hash that has."""
    order = np.argsort(hashed, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])) if len(order) else order
    count = np.diff(np.concatenate([edge, [len(order)]]))
    copied = np.zeros(len(order), bool)
    copied[order] = np.repeat(count > 1, count)
    return copied, order[edge[count > 1]]


def entries(batch: pa.RecordBatch, text: np.ndarray, at: np.ndarray, hashed: np.ndarray) -> pa.RecordBatch:
    """Rows hash, k1, k2, at, copied. What a slice has twice goes on as copied, with one row without place to stand for it."""
    copied, one = joined(hashed)
    k1, k2 = (batch.column(c).to_numpy()[text] for c in ("k1", "k2"))
    n = len(one)
    place = pa.array(np.concatenate([at, np.zeros(n, np.int64)]).astype(np.int32), mask=np.concatenate([np.zeros(len(at), bool), np.ones(n, bool)]))
    return set_out({
        "hash": (np.concatenate([hashed, hashed[one]]).view(np.int64), pa.int64()), "k1": (np.concatenate([k1, np.zeros(n, np.int64)]), pa.int64()), "k2": (np.concatenate([k2, np.zeros(n, np.int64)]), pa.int64()),
        "at": (place, pa.int32()), "copied": (np.concatenate([copied, np.zeros(n, bool)]), pa.bool_()),
    })


def found_elsewhere(rows: DataFrame) -> DataFrame:
    """k1, k2 and the distinct places (array<int>) of entries that occur more than once.

    Entries that are known to be copied need no comparison and are dealt out by their text; others are
    counted by hash, where a copied one is at most a row for each slice that has it. Repeated rows have
    one key and each place once, so a list is no longer than its text."""
    apart = Window.partitionBy("hash", F.when(F.col("copied"), F.col("k2")))
    counted = rows.withColumn("n", F.count("*").over(apart)).where("(copied or n > 1) and at is not null")
    return counted.groupBy("k1", "k2").agg(F.collect_set("at").alias("places"))


def keyed(docs: DataFrame, carried: list[str] = ()) -> DataFrame:
    """doc_id, text, carried columns and a key without nulls. Rows that are alike in both have one key: their places are the same."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in carried))
    return rows.withColumn("k1", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("k2", F.xxhash64("text", F.col("doc_id").isNull()))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, carried: list[str] = ()) -> DataFrame:
    """doc_id, text, carried columns, k1, k2, places: where in the text (words from 0) windows begin that begin anywhere else too; null: nowhere."""
    rows = keyed(docs, carried)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield entries(batch, *anchors(texts_of(batch), window, shingle))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marked = [np.unique(np.asarray(x, np.int64)) for x in batch.column("places").to_pylist()]
            yield entries(batch, *repeated_windows(texts_of(batch), marked, window, shingle))

    kind = "hash long, k1 long, k2 long, at int, copied boolean"
    near = found_elsewhere(rows.mapInArrow(index, kind))
    whole = rows.join(near, ["k1", "k2"])  # the same columns as below, so that Spark shuffles the texts once for both joins
    exact = found_elsewhere(whole.mapInArrow(compare, kind))
    return rows.join(exact, ["k1", "k2"], "left")


def remove_duplicates(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, carried: list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 and the carried columns of every row of docs.

    Removed is each word in a window of `window` consecutive words that also begins anywhere else, in this
    text or another, judged on the input; kept words are joined by one space. Repeated rows are each
    other's copies; a null text has no words; rows with a null doc_id take part; an empty table gives an
    empty result; further columns are not read. Three shuffles: of anchors (about one for 12 words), of
    the windows around repeated ones, and of the texts by key.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, removed, kept = [], [], []
            for text, places in zip(texts_of(batch), batch.column("places")):
                own = text.split()
                words.append(len(own))
                if places.is_valid:
                    gone = covered(np.unique(places.values.to_numpy()).astype(np.int64), window, len(own))
                    own = [w for w, x in zip(own, gone.tolist()) if not x]
                removed.append(words[-1] - len(own))
                kept.append(b" ".join(own))
            yield set_out({
                "doc_id": (batch.column("doc_id"), pa.int64()), "n_words": (words, pa.int64()), "n_removed": (removed, pa.int64()),
                "kept_text": (pa.array(kept, pa.binary()).cast(pa.string()), pa.string()), "kept_sha256": ([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            } | {c: (batch.column(c), batch.schema.field(c).type) for c in carried})

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    found = duplicate_spans(docs, window, shingle, carried).select("doc_id", "text", "places", *carried)
    return found.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string" + more)
