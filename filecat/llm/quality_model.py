"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded (surface statistics, then a learned layer), gated
attention weights are learned from the labels of whole documents alone, and the weighted sum of the
passages is scored. The model is fitted in numpy on a bounded sample and applied on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import documents, set_out, slices, texts_of

#: Bytes of a passage.
PASSAGE = 512
#: Kinds of bytes that are counted in each passage.
KINDS = [
    b" \t\x0b\x0c\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"#*$%&", b"|<>", b"-_/\\+=~^@", b"\"'`()[]{}", b"aeiou", b"AEIOU", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)), bytes([*range(9), *range(14, 32), 127]),
]
TABLE = np.array([[b in kind for b in range(256)] for kind in KINDS], dtype=np.uint8)
#: Pairs of neighbours that are counted: equal bytes, letter after letter, case change inside a word, sign after letter, sign after sign.
#: Last comes the greatest share of bytes equal to the byte one of LAGS before: words or phrases said again at once.
FEATURES = len(KINDS) + 9
LAGS = range(3, 15)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of each passage, and where each text's passages begin (one more entry at the end).

    Whole texts are read; a text without bytes is one passage of zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    raw = np.frombuffer(b"".join(texts) + b" ", np.uint8)
    begin = np.concatenate([np.arange(n) * PASSAGE + at for n, at in zip(counts, np.cumsum(sizes) - sizes)]) if len(texts) else np.zeros(0, np.int64)
    end = np.minimum(begin + PASSAGE, np.repeat(np.cumsum(sizes), counts))
    length = (end - begin).astype(float)
    out = np.zeros((len(begin), FEATURES), np.float32)
    scale = 1 / np.maximum(length, 1)

    def share(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return (total[end] - total[begin]) * scale

    for k in range(len(KINDS)):
        out[:, k] = share(TABLE[k][raw])
    space, letter, upper = TABLE[0][raw] | TABLE[1][raw], TABLE[2][raw] | TABLE[3][raw] | (raw >= 0x80), TABLE[3][raw]
    sign = 1 - (space | letter | TABLE[4][raw])
    before = lambda x: np.concatenate([[0], x[:-1]])
    k = len(KINDS)
    out[:, k] = share(raw == before(raw))
    out[:, k + 1] = share(letter & before(space))
    out[:, k + 2] = share(upper & before(TABLE[2][raw]))
    out[:, k + 3] = share(sign & before(letter))
    out[:, k + 4] = share(sign & before(sign))
    out[:, k + 5] = share(sign & before(space))
    for lag in LAGS:
        same = np.zeros(len(raw), np.uint8)
        same[lag:] = raw[lag:] == raw[:-lag]
        np.maximum(out[:, k + 8], share(same), out=out[:, k + 8])
    out[:, k + 6] = np.log1p(length) / 8
    out[:, k + 7] = np.repeat(np.log1p(sizes) / 12, counts)
    return out, bounds


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product without BLAS, whose threads may hang in a driver that has started a JVM."""
    return np.einsum("ij,jk->ik" if b.ndim == 2 else "ij,j->i", a, b)


class Model:
    """h = tanh(x W + b); attention ~ exp(v · (tanh(h V) * sigmoid(h U))); score = sigmoid(c · Σ attention h + d)."""

    def __init__(self, width: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"W": (FEATURES, width), "b": (width,), "V": (width, width), "U": (width, width), "v": (width,), "c": (width,), "d": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else rng.normal(0, 0.1, s) * (k in "vc") for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(product(x, p["W"]) + p["b"])
        t, g = np.tanh(product(h, p["V"])), 1 / (1 + np.exp(-product(h, p["U"])))
        raw = product(t * g, p["v"])
        e = np.exp(np.clip(raw, -30, 30))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        a = e / np.add.reduceat(e, bounds[:-1])[owner]
        z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(product(z, p["c"]) + p["d"], -30, 30)))
        return score, {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner}

    def gradient(self, bounds: np.ndarray, delta: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        """delta: the loss's derivative by each document's logit."""
        p, o = self.p, s["owner"]
        dz = delta[:, None] * p["c"]
        da = (dz[o] * s["h"]).sum(1)
        draw = s["a"] * (da - np.add.reduceat(s["a"] * da, bounds[:-1])[o])
        dtg = draw[:, None] * p["v"]
        dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
        dh = s["a"][:, None] * dz[o] + product(dt, p["V"].T) + product(dg, p["U"].T)
        dx = dh * (1 - s["h"] ** 2)
        return {"W": product(s["x"].T, dx), "b": dx.sum(0), "V": product(s["h"].T, dt), "U": product(s["h"].T, dg), "v": product((s["t"] * s["g"]).T, draw), "c": product(s["z"].T, delta), "d": delta.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
        """Both labels weigh alike in all."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
        first, second, step, rng = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), batch):
                docs = order[at : at + batch]
                n = bounds[docs + 1] - bounds[docs]
                own = np.concatenate([[0], np.cumsum(n)])
                rows = np.arange(own[-1]) - np.repeat(own[:-1], n) + np.repeat(bounds[docs], n)
                score, state = self.forward(x[rows], own)
                grad = self.gradient(own, weight[docs] * (score - label[docs]) / len(docs), state)
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, seed: int = 7) -> Model | None:
    """Fits the model on at most `sample` labelled rows, those first by a hash of doc_id, that are not held out.

    Rows with a null doc_id, a null quality or labels that contradict each other teach nothing. Without two
    different labels there is no model, and every score is the share of label 1 (or 0.5)."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    chosen = own.where(~is_held_out()).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bounds = passages(texts_of(batch))
            parts = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "quality": (batch.column("quality"), pa.int32()), "x": (parts, pa.binary())})

    # a doc_id may come more than once; of its texts the least teaches
    found = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").cast("int").alias("quality")).mapInArrow(encode, "doc_id long, quality int, x binary").orderBy("doc_id").collect()
    label = np.array([r["quality"] for r in found], float)
    if len(set(label.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float) for r in found]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model(seed=seed).fit(np.concatenate(bags), bounds, label)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 4000, seed: int = 7, carried: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the carried columns of every row of docs.

    Only texts enter a score; labels are used to fit the model alone, on at most `sample` rows that are not
    held out. A null text counts as empty and has a score like any other; rows with a null doc_id and
    repeated rows are kept; an empty table gives an empty result. Scoring is one pass without a shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, sample, seed))  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = texts_of(batch)
            score = model.forward(*passages(texts))[0] if model else np.full(len(texts), 0.5)
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "held_out": (batch.column("held_out"), pa.bool_()), "score": (score, pa.float64())} | {c: (batch.column(c), batch.schema.field(c).type) for c in carried})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in carried if c != "text")).withColumn("held_out", is_held_out())
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double" + more).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
