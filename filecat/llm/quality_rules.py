"""Repetition rules: the share of a text's characters inside repeated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filecat.llm.common import documents, set_out, slices, texts_of
from filecat.llm.words import covered, cut, hashes, inside, mixed, rolling

#: Fixed values of published web-text filters: the greatest share of characters in the most frequent n-gram, ...
TOP_GRAM = {2: 0.20, 3: 0.18, 4: 0.16}
#: ... in n-grams that the text has had before (a line at the head that the foot of a short text repeats stays below), ...
REPEATED_GRAMS = dict.fromkeys(range(5, 11), 0.20)
#: ... and in repeated lines.
LINE_CHARS = 0.20
#: Texts of fewer words fail.
LEAST_WORDS = 50
#: Code points: every byte that does not continue one.
STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)])
SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
SYMBOL = np.array([b in b"#*$%&|<>" for b in range(256)])


def word_chars(raw: np.ndarray) -> np.ndarray:
    """Code points of each run of non-space bytes."""
    word = ~SPACE[raw]
    if not word.any():
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    return np.add.reduceat((STARTS[raw] & word).astype(np.int64), begins)


def by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values over each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(hashed: np.ndarray, bounds: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of n-word windows inside one text, how often the text has each of them, and whether it had it before."""
    starts = np.flatnonzero(inside(bounds, n))
    if not len(starts):
        return starts, starts, starts > 0
    keys = rolling(hashed, n)[starts] ^ mixed(owner[starts].astype(np.uint64) + np.uint64(n << 40))
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]]))
    count = np.empty(len(starts), np.int64)
    count[order] = np.repeat(np.diff(edge), np.diff(edge))
    again = np.ones(len(starts), bool)
    again[order[edge[:-1]]] = False
    return starts, count, again


def lines_of(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, and bytes of both."""
    if b"\n" not in text:
        return (1, 0, len(text), 0) if text.strip() else (0, 0, 0, 0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    once = set(lines)
    size, kept = sum(map(len, lines)), sum(map(len, once))
    return len(lines), len(lines) - len(once), size, size - kept


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    Words are runs without ASCII white space. base_failed: fewer than 50 words, or more than half of the
    words in 3-word windows found twice or more. kept: not base_failed, and no share of characters in the
    most frequent n-gram, in repeats of n-grams or in repeats of lines above its bound. A null text counts as empty and fails; rows with a null
    doc_id and repeated rows are kept; an empty table gives an empty result; further columns are not
    read. One pass without a shuffle; rolling hashes of whole texts in slices of a few MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            words, bounds = cut(texts)
            total, n_words = int(bounds[-1]), np.diff(bounds)
            hashed = hashes(words, total)
            raw = np.frombuffer(b" ".join(texts), np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts])
            chars = word_chars(raw)
            symbols = by_text(np.concatenate([SYMBOL[raw], [False]]).astype(np.int64), np.concatenate([[0], ends]))
            all_chars = by_text(chars, bounds)
            owner = np.repeat(np.arange(len(texts)), n_words)
            lines = np.array([lines_of(t) for t in texts]).reshape(-1, 4)
            bad = lines[:, 3] > LINE_CHARS * lines[:, 2]
            repeats = np.zeros(len(texts), np.int64)
            total_chars = np.concatenate([[0], np.cumsum(chars)])
            for n in (*TOP_GRAM, *REPEATED_GRAMS):
                starts, count, again = repeated(hashed, bounds, owner, n)
                twice = starts[count > 1]
                if n == 3:
                    repeats = by_text(covered(twice, n, total).astype(np.int64), bounds)
                if n in TOP_GRAM and len(twice):
                    share = (total_chars[twice + n] - total_chars[twice]) * count[count > 1]
                    top = np.zeros(len(texts), np.int64)
                    np.maximum.at(top, owner[twice], share)
                    bad |= top > TOP_GRAM[n] * all_chars
                elif n in REPEATED_GRAMS and len(twice):
                    bad |= by_text(chars * covered(starts[again], n, total), bounds) > REPEATED_GRAMS[n] * all_chars
            failed = (n_words < LEAST_WORDS) | (100 * repeats > 50 * n_words)
            yield set_out({
                "doc_id": (batch.column("doc_id"), pa.int64()), "n_words": (n_words, pa.int64()), "word_chars": (all_chars, pa.int64()), "n_symbols": (symbols, pa.int64()),
                "n_dup_lines": (lines[:, 1], pa.int64()), "n_repeat_words": (repeats, pa.int64()), "base_failed": (failed, pa.bool_()), "kept": (~failed & ~bad, pa.bool_()),
            })

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
