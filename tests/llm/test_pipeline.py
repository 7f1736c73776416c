"""The pipeline's stages, each on what the one before it kept, against plain versions of them."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from filecat.llm.quality_model import KINDS, LAGS, PASSAGE, Model, passages, train

sys.path.insert(0, str(Path(__file__).parent))
from test_similar_texts import shingles  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(model, text):
    """One text's score with loops over its passages, from the statistics of each passage alone."""
    p, raw = model.p, (text or "").encode()
    x = (passages([raw])[0] - model.mean) / model.scale
    hidden, weights = [], []
    for row in x:
        h = np.tanh(np.array([sum(row[i] * p["W"][i, j] for i in range(len(row))) + p["b"][j] for j in range(len(p["b"]))]))
        t = np.tanh(np.array([sum(h[i] * p["V"][i, j] for i in range(len(h))) for j in range(len(h))]))
        g = np.array([1 / (1 + np.exp(-sum(h[i] * p["U"][i, j] for i in range(len(h))))) for j in range(len(h))])
        hidden.append(h)
        weights.append(np.exp(sum(t * g * p["v"])))
    z = sum(w / sum(weights) * h for w, h in zip(weights, hidden))
    return 1 / (1 + np.exp(-(sum(z * p["c"]) + p["d"][0])))


def plain_kept(rows, share=0.8):
    """doc_ids of which one stands for each group of similar texts, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= share * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def plain_cut(rows, window=35):
    """Texts without the words of windows that begin anywhere else too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15

    return [(m.start(), m.end(), kind, m.group()) for kind, p in PLAIN.items() for m in re.finditer(p, text) if holds(kind, m.group())]


def plain_sanitised(rows, threshold=0.9, support=2):
    word = r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])"
    mask = lambda t: re.sub(PLAIN["email"], lambda m: re.sub("[A-Za-z]", "0", m.group()), t)
    own, both, term, texts, pairs = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for _, t in rows:
        entities, terms = {f"{k}:{v.lower()}" for *_, k, v in plain_spans(t)}, {w.lower() for w in re.findall(word, mask(t))}
        term.update(terms)
        own.update(entities)
        for e in entities:
            texts[e].add(t)
            for w in terms:
                both[e, w] += 1
                pairs[e, w].add(t)
    n = len(rows)
    hit = {w for (e, w), c in both.items() if len(pairs[e, w]) >= support and own[e] < n and np.log2(n * c / (own[e] * term[w])) >= threshold * np.log2(n / own[e])}
    out = []
    for d, t in rows:
        spans = sorted([(a, b, f"[{k.upper()}]") for a, b, k, _ in plain_spans(t)] + [(m.start(), m.end(), "[TERM]") for m in re.finditer(word, mask(t)) if m.group().lower() in hit])
        text, at = "", 0
        for a, b, put in spans:
            if a >= at:
                text += t[at:a] + put
            at = max(at, b)
        out.append((d, text + t[at:]))
    return sorted(out)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "private", "packing"]
    corpus_pipeline.ship(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            got = sorted((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
        if name == "quality":
            model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"), 4000)
            assert [d for d, _ in got] == [d for d, t in before if plain_score(model, t) >= 0.5] and dict(got).items() <= dict(before).items()
        if name == "near_duplicates":
            assert [d for d, _ in got] == plain_kept(before) and dict(got).items() <= dict(before).items()
        if name == "substrings":
            assert got == plain_cut(before)
        if name == "private":
            assert got == plain_sanitised(before)
        docs = out
    tok, found, ends = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), {}, Counter()
    tok.no_truncation()
    tok.no_padding()
    for r in sorted(docs.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
        found[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    want, free = {}, []
    for d, t in got:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k): (a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert found == want and max(ends.values()) <= 2048
    for n in sorted((n for _, n, _ in want.values()), reverse=True):  # first fit, largest first
        k = next((k for k, x in enumerate(free) if x >= n), None)
        if k is None:
            free.append(2048)
            k = len(free) - 1
        free[k] -= n
    assert len(ends) <= len(free)


def test_gradient_is_the_slope_of_the_loss():
    """The model's gradient against differences of its loss, on bags of one to five passages."""
    rng = np.random.default_rng(2)
    model = Model(width=5)
    bounds = np.array([0, 1, 4, 9, 11])
    x, label = rng.normal(size=(11, len(KINDS) + 9)), np.array([1.0, 0, 1, 0])
    loss = lambda: -np.sum(label * np.log(model.forward(x, bounds)[0]) + (1 - label) * np.log(1 - model.forward(x, bounds)[0]))
    score, state = model.forward(x, bounds)
    grad = model.gradient(bounds, score - label, state)
    for name, g in grad.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in model.p[name].shape)
            old = model.p[name][at]
            model.p[name][at] = old + 1e-5
            up = loss()
            model.p[name][at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            model.p[name][at] = old
            assert abs(slope - g[at]) < 1e-5 * max(1, abs(slope)), name
    assert PASSAGE == 512 and len(LAGS) == 12


def test_training_does_not_depend_on_the_order_of_rows(spark):
    """Several texts of one doc_id: the same one teaches, however rows lie."""
    rows = [(i % 40, f"text {i} of {i % 3} " * (1 + i % 4)) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    models = [train(spark.createDataFrame(own, "doc_id long, text string").repartition(n), labels, 100) for own, n in ((rows, 2), (rows[::-1], 5))]
    assert all(np.allclose(models[0].p[k], models[1].p[k]) for k in models[0].p)


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing columns and empty tables, in every stage."""
    rows = [(1, None, "en", "s", 0), (None, "", None, None, None), (2, "word " * 80, "en", "s", 400), (2, "word " * 80, "en", "s", 400), (3, "Mail me: a@b.example. " * 3, "en", "s", 60)]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = docs.selectExpr("*", "1 AS k1", "'x' AS places", "2 AS part", "'y' AS email", "3 AS score", "4 AS component_id")
    kept = {"near_duplicates": {(1, None), (2, "word " * 80), (3, "Mail me: a@b.example. " * 3)}, "substrings": {(1, ""), (None, ""), (2, ""), (3, "Mail me: a@b.example. Mail me: a@b.example. Mail me: a@b.example.")}, "private": {(1, ""), (None, ""), (2, "word " * 80), (3, "Mail me: [EMAIL]. " * 3)}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, SF).collect()
        if name in kept:
            assert {(r["doc_id"], r["text"]) for r in out} == kept[name], name
            assert len(out) == len(rows) if name != "near_duplicates" else len(out) == 3
        elif name == "quality":
            assert {(r["doc_id"], r["text"]) for r in out} <= {r[:2] for r in rows}
        else:
            assert sum(r["length"] for r in out) > 0 and Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
