"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import cut

#: Edges of a task: few edges in many tasks would be many tiny files in every shuffle of every round.
EDGES = 1 << 18


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge between two different nodes.

    Alternates two steps of joins and sums until nothing changes, which takes about the logarithm of the
    longest path: each node's larger neighbours, then its smaller ones, are tied to the least of them.
    Each round is cut off by a checkpoint in the shared folder; no list of neighbours is ever gathered.
    Tasks are as many as the edges ask for; a round never has more edges than the one before.
    Nulls are ignored; an empty table gives an empty result.
    """
    kind = edges.schema[a].dataType
    now = edges.select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).where("u <> v").distinct()
    before, tasks = None, -(-edges.count() // EDGES) or 1
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        near = now.join(least, "u")
        now = cut(near.select("u", F.col("m").alias("v")).union(near.where("v <> m").select("v", "m")).distinct().coalesce(tasks))
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
        before = state
    raise RuntimeError(f"the components were not stable after {rounds} rounds")
