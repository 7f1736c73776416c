"""Groups of similar texts against plain set comparison; bit slices against plain counts."""

import random
from collections import defaultdict

import numpy as np
import pytest

from filecat.llm import similar_texts as st

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if len(w) < 5 else zip(*(w[k:] for k in range(5))))


def plain(data, share=0.8):
    """(doc_id, component_id) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= share * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(data):
        least[find(i)].append(d)
    return [(d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(data)]


def families(seed):
    """Texts of 5 to 400 words with copies of which 0 to 12 words are changed, so that similarities lie on both sides of 0.8."""
    rng, out = random.Random(seed), []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 9, 30, 80, 200, 400]))]
        for _ in range(rng.randrange(1, 30)):
            words = list(base)
            for _ in range(rng.randrange(13) * len(base) // 400 + rng.randrange(2)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, "one"), (None, "alone here"), (7, "x y z " * 900), (7, "x y z " * 900), (8, "a" * 5000), (9, "tie tie tie " * 40), (10, "tie tie tie " * 41)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("part", [st.PART, 3])
def test_groups(spark, monkeypatch, part):
    monkeypatch.setattr(st, "PART", part)
    data = families(1) + [(d and d + 10**6, t) for d, t in ODD]
    assert ordered(st.similar_groups(spark.createDataFrame(data, SCHEMA)).collect()) == ordered(plain(data))


def test_odd_rows(spark):
    rows = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *(f"'x' as {c}" for c in ("cid", "n", "fp", "comp", "part", "size", "key", "band", "items")))
    assert ordered(st.similar_groups(rows).collect()) == ordered(plain(ODD))
    kept = [r["doc_id"] for r in st.one_of_each(rows).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 7, 8, 9] and kept.count(None) == 1
    assert st.similar_groups(rows.limit(0)).count() == st.one_of_each(rows.limit(0)).count() == 0


def test_one_of_each_loses_no_text(spark):
    """Unlike texts of one doc_id both stay; copies without doc_id and repeated rows are one; near copies count as copies."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "text a is here and stays"), (1, "another text b that stays"), (None, "no id and a copy"), (None, "no id and a copy"), (2, long), (2, long), (3, long + " more"), (None, long + " other")]
    kept = st.one_of_each(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as cid", "'y' as root")).select("doc_id", "text").collect()
    assert ordered(kept) == ordered([(1, "text a is here and stays"), (1, "another text b that stays"), (None, "no id and a copy"), (2, long)])


def test_sorted_groups_are_read_whole():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 60, 5000))
    rows = [pa.record_batch({"k": keys[at : at + 37], "v": np.arange(at, min(at + 37, 5000))}) for at in range(0, 5000, 37)]
    seen = []
    for table, sizes in st.in_groups(iter(rows), ["k"], 100):
        k, at = table.column("k").to_numpy(), 0
        for n in sizes.tolist():
            assert len(set(k[at : at + n].tolist())) == 1
            seen.append((int(k[at]), n))
            at += n
        assert at == len(k)
    assert seen == [(int(k), int((keys == k).sum())) for k in np.unique(keys)]


def test_short_texts_with_a_word_appended(spark):
    """4 of 5 shingles in common is 0.8 exactly: the prints of such pairs differ by more than the radius in one case of nine."""
    base = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(150)]
    data = [(i, t) for i, t in enumerate(base)] + [(1000 + i, t + " more") for i, t in enumerate(base)] + [(2000 + i, f"other {t[:-1]}") for i, t in enumerate(base[:20])]
    assert ordered(st.similar_groups(spark.createDataFrame(data, SCHEMA)).collect()) == ordered(plain(data))


def test_bit_slices():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (4, st.BITS))
    bits = np.concatenate([base[k % 4] ^ (rng.random(st.BITS) < rng.random() * 0.4) for k in range(300)]).reshape(300, -1).astype(np.uint8)
    raw = np.packbits(bits, axis=1)
    distance = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    sizes, queries = np.array([130, 1, 100, 69]), np.array([130, 1, 40, 69])
    for radius in (0, 63, 64, 106):
        want, start = set(), 0
        for size, q in zip(sizes, queries):
            for x in range(start, start + q):
                want |= {(x, y) for y in range(x + 1 if q == size else start + q, start + size) if distance[x, y] <= radius}
            start += size
        got = [(x, y) for left, right in st.block_pairs(raw, sizes, queries, radius) for x, y in zip(left.tolist(), right.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
