"""Texts above the slices' four megabytes, through every operator on texts; and the two merges of the codec."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from filecat.llm.bpe_codec import bpe_round_trip, encoder
from filecat.llm.common import SLICE_BYTES, ship
from filecat.llm.private_data import private_spans
from filecat.llm.quality_rules import repetition_rules
from filecat.llm.simhash import near_duplicates
from filecat.llm.substring_dedup import remove_duplicates
from filecat.llm.token_count import token_counts

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.fixture(scope="module")
def long(spark):
    ship(spark)
    rng = random.Random(1)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}é{k % 7}" for k in range(4000)]
    text = lambda seed, n: " ".join(random.Random(seed).choices(words, k=n))
    passage = text(5, 60)
    first = f"{text(1, 450_000)} {passage} mail a@b.example\n{text(2, 450_000)}"
    second = f"{text(3, 20_000)} {passage} 10.0.0.1 " + rng.choice(words) * 300_000
    assert len(first.encode()) > SLICE_BYTES
    rows = [(1, first), (2, second), (3, "short"), (4, first)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def by_id(rows):
    return sorted(map(tuple, rows), key=str)


def test_tokens(long):
    rows, df = long
    tok = Tokenizer.from_file(str(BYTES))
    tok.no_truncation()
    want = [(d, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for d, t in rows]
    assert by_id(token_counts(df, BYTES).select("doc_id", "n_bytes", "n_tokens").collect()) == by_id(want)


def test_round_trip(long):
    rows, df = long
    tok = Tokenizer.from_file(str(WORDS))
    tok.no_truncation()
    want = []
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_id(bpe_round_trip(df, WORDS).collect()) == by_id(want)


def test_fingerprints(long):
    rows, df = long
    want = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        hashed = np.array([xxhash.xxh64_intdigest(p.encode(), 42) for p in parts], np.uint64)
        bits = sum(1 << b for b in range(64) if 2 * int(((hashed >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashed))
        want.append((d, format(bits, "016x")))
    got = near_duplicates(df, shingle=3, seed=42, radius=2).collect()
    assert by_id((r["doc_id"], r["fingerprint"]) for r in got) == by_id(want)
    assert {r["doc_id"]: r["component_id"] for r in got}[4] == 1


def test_substrings(long):
    rows, df = long
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_duplicates(df).select("doc_id", "n_words", "n_removed").collect()}
    n = {d: len(t.split()) for d, t in rows}
    assert got == {1: (n[1], n[1]), 2: (n[2], 60), 3: (1, 0), 4: (n[4], n[4])}


def test_repetition(long):
    rows, df = long
    got = {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in repetition_rules(df).collect()}
    assert got == {d: (len(w := t.split()), sum(map(len, w))) for d, t in rows}


def test_spans(long):
    rows, df = long
    got = {r["doc_id"]: r for r in private_spans(df).collect()}
    for d, t in rows:
        mail = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
        ip = [m.span() for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t)]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join([f"email:{a}:{b}" for a, b in mail] + [f"ip:{a}:{b}" for a, b in ip]).encode()).hexdigest()


@pytest.mark.parametrize("count", [3, 15, 16, 17, 60])
def test_both_merges_emit_the_same(count):
    """Windows below and above the number at which many are merged at once."""
    rng = random.Random(count)
    codec = encoder(WORDS)
    bpe = next(x for x in vars(codec).values() if hasattr(x, "emitted")) if not hasattr(codec, "emitted") else codec
    letters = "abcdefghijklmnopqrstuvwxyzé0".encode()
    windows = [bytes(rng.choices(letters, k=rng.choice([1, 2, 9, 30, 70]))) for _ in range(count)]
    ended = [rng.random() < 0.5 for _ in windows]
    bpe.windows.clear()
    one = [bpe._one(w, e) for w, e in zip(windows, ended)]
    bpe.windows.clear()
    assert bpe.emitted(windows, ended) == one
