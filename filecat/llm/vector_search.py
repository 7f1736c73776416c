"""Maximum inner product search with score-aware quantisation.

Vectors are coded by 16 centres for each pair of dimensions. Centres and codes minimise an anisotropic
error: the part of the residual along the vector, which moves its large inner products, weighs more
than the part across it. Queries scan blocks of four-bit codes with small tables, two codes at a time,
and the best of each block are scored again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.common import cut, set_out

#: Rows of an index block and of a query block; what a task holds at once.
BLOCK, QUERY_BLOCK, CHUNK = 8192, 2048, 64


class Codebook:
    """16 centres for each pair of dimensions (an odd dimension is padded by a zero)."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7):
        self.dim = sample.shape[1]
        self.parts = -(-self.dim // 2)
        self.parts += self.parts % 2
        d = max(2, self.dim)
        self.weight = (d - 1) * threshold**2 / (1 - threshold**2)  # of the parallel error against the orthogonal one
        x = self._split(sample)
        rng = np.random.default_rng(seed)
        self.centres = np.stack([x[rng.choice(len(x), 16, replace=len(x) < 16), s] for s in range(self.parts)])
        for _ in range(rounds):
            codes, unit = self._codes(x), self._unit(x)
            self._fit(x, unit, codes)

    def _split(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), 2 * self.parts))
        out[:, : self.dim] = v
        return out.reshape(len(v), self.parts, 2)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-300)

    def _codes(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Nearest centres, then better ones part by part under the anisotropic error."""
        unit = self._unit(x)
        n = np.arange(len(x))
        codes = np.empty((len(x), self.parts), np.uint8)
        along = np.empty((len(x), self.parts))
        for s in range(self.parts):
            codes[:, s] = ((x[:, s, None] - self.centres[s]) ** 2).sum(2).argmin(1)
            along[:, s] = ((x[:, s] - self.centres[s][codes[:, s]]) * unit[:, s]).sum(1)
        total = along.sum(1)
        extra = self.weight - 1
        for _ in range(passes):
            for s in range(self.parts):
                rest = x[:, s, None] - self.centres[s]
                own = (rest * unit[:, s, None]).sum(2)
                cost = (rest**2).sum(2) + extra * (total[:, None] - along[:, s, None] + own) ** 2
                codes[:, s] = cost.argmin(1)
                total += own[n, codes[:, s]] - along[:, s]
                along[:, s] = own[n, codes[:, s]]
        return codes

    def _fit(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        along = np.stack([((x[:, s] - self.centres[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(self.parts)], 1)
        extra = self.weight - 1
        for s in range(self.parts):
            others = along.sum(1) - along[:, s]
            for c in range(16):
                if (m := codes[:, s] == c).any():
                    u, v = unit[m, s], x[m, s]
                    left = m.sum() * np.eye(2) + extra * u.T @ u
                    right = v.sum(0) + extra * (u * (others[m] + (v * u).sum(1))[:, None]).sum(0)
                    self.centres[s, c] = np.linalg.solve(left + 1e-9 * np.eye(2), right)
            along[:, s] = ((x[:, s] - self.centres[s][codes[:, s]]) * unit[:, s]).sum(1)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Two codes in each byte."""
        codes = self._codes(self._split(v))
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte the inner product of every value of the byte."""
        each = np.einsum("qsd,scd->qsc", self._split(q), self.centres)
        return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(q), self.parts // 2, 256).astype(np.float32)


def rows_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scan(book: Codebook, codes: np.ndarray, vectors: np.ndarray, queries: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, the `depth` vectors that the codes rank highest, and their exact scores."""
    depth = min(depth, len(vectors))
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    for at in range(0, len(queries), CHUNK):
        q = queries[at : at + CHUNK]
        tables = book.tables(q)
        score = np.zeros((len(q), len(vectors)), np.float32)
        part = np.empty_like(score)
        for j in range(len(columns)):
            np.take(tables[:, j], columns[j], axis=1, out=part, mode="clip")
            score += part
        best = np.argpartition(-score, depth - 1, axis=1)[:, :depth] if depth < len(vectors) else np.broadcast_to(np.arange(depth), (len(q), depth))
        exact = np.einsum("qrd,qd->qr", vectors[best], q)
        yield from ((at + i, best[i], exact[i]) for i in range(len(q)))


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, sample: int = 4096, depth: int = 200) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with vec_id divisible by `every` its k rows of largest inner product.

    Nearest first, ties to the smaller vec_id; scores in double precision on the original vectors. Rows
    that are null or zero, hold a null or non-finite component, have no vec_id or another length than most
    take no part; a row that comes twice counts once; a query's own vec_id is no candidate of it; an empty
    table gives an empty result; further columns are not read.

    The codebook is fitted on at most `sample` distinct vectors; every vector is indexed. Equal vectors are one
    entry with its k + 1 smallest ids, of which no more can be in a result. Index blocks meet query blocks,
    each of bounded size, so that a task holds one of both.
    """
    spark = embeddings.sparkSession
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kind = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], kind)
    dim = common["n"]
    rows = rows.where(F.size("embedding") == dim)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    chosen = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toPandas()  # distinct, so that no common vector fills the sample
    book = spark.sparkContext.broadcast(Codebook(np.stack(chosen["embedding"].to_numpy()).astype(np.float64).reshape(-1, dim)))  # 16 centres for each two dimensions

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = book.value.encode(rows_of(batch.column("embedding"), dim))
            yield set_out({"embedding": (batch.column("embedding"), batch.schema.field("embedding").type), "ids": (batch.column("ids"), pa.list_(pa.int64())), "codes": ([c.tobytes() for c in codes], pa.binary())})

    element = rows.schema["embedding"].dataType.elementType.simpleString()
    indexed = cut(entries.mapInArrow(index, f"embedding array<{element}>, ids array<bigint>, codes binary"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").distinct()
    blocks, query_blocks = -(-indexed.count() // BLOCK), max(1, -(-queries.count() // QUERY_BLOCK))
    left = indexed.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(blocks)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(base: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if base.num_rows and asked.num_rows:
            vectors, q = rows_of(base.column("embedding"), dim), rows_of(asked.column("embedding"), dim)
            codes = np.frombuffer(b"".join(base.column("codes").to_pylist()), np.uint8).reshape(len(vectors), -1)
            ids, own = base.column("ids").to_pylist(), asked.column("vec_id").to_pylist()
            for i, best, exact in scan(book.value, codes, vectors, q, depth):
                top = sorted(zip((-exact).tolist(), best.tolist()))
                bound = top[min(k, len(top) - 1)][0]
                found = sorted((s, x) for s, b in top if s <= bound for x in ids[b] if x != own[i])[:k]
                out += [(own[i], i, x, -s) for s, x in found]
        query, number, vec, score = zip(*out) if out else ((), (), (), ())
        hashed = asked.column("q").to_numpy()[list(number)] if out else ()
        return pa.table({"query_id": pa.array(query, pa.int64()), "q": pa.array(hashed, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    right = right.withColumn("q", F.xxhash64("embedding"))
    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(search, "query_id long, q long, vec_id long, score double")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
