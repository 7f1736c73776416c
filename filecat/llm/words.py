"""Words of texts as arrays: runs of bytes that are not ASCII white space."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: An odd multiplier, so that its powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def cut(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each text, and where each text's words begin in all of them (one more entry at the end)."""
    words = [t.split() for t in texts]
    return words, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def hashes(words: list[list[bytes]], total: int) -> np.ndarray:
    """A 64 bit hash of each word, one after another."""
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, total)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all bits; no two inputs meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; entry i is that of words i to i + n - 1."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, block, width = None, 0, 1, hashed, 1
    while n:  # blocks of 1, 2, 4, ... words are joined where n has a bit
        if n & 1:
            part = block[at : at + count]
            out = part.copy() if out is None else out * np.uint64(pow(int(BASE), width, 1 << 64)) + part
            at += width
        n >>= 1
        if n:
            block = block[: len(block) - width] * np.uint64(pow(int(BASE), width, 1 << 64)) + block[width:]
            width *= 2
    return mixed(out)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each `width` consecutive entries."""
    pick, have = (np.minimum if least else np.maximum), 1
    count = len(x) - width + 1
    if count <= 0:
        return x[:0]
    while 2 * have <= width:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    return pick(x[:count], x[width - have : width - have + count]) if have < width else x


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each word but the last n - 1 of all: whether n words from it on lie in one text."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total - n + 1) + n <= end[: total - n + 1]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each word whether one of the n-word windows that begin at starts covers it."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1) if len(starts) < 1000 else np.add(edge[:-1], np.bincount(starts, minlength=total), out=edge[:-1])
    close = np.bincount(starts + n, minlength=total + 1)[: total + 1]
    return np.cumsum(edge - close)[:total] > 0
