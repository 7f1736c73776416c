"""Checkpoints of op4 are as many files as their rows need, not as many as shuffles have partitions."""

import os
from collections import Counter

from filecat.llm.sharding import shards


def written(spark) -> set[str]:
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return {os.path.join(d, x) for d, _, names in os.walk(top) for x in names if x.startswith("part-")}


def test_checkpoints_are_few_files(spark):
    """A copy in 400 of 1,000 rows, 100 pairs, a hub of no text at all, and texts of their own."""
    data = [(i, "copy") for i in range(400)] + [(400 + i, f"pair {i // 2}") for i in range(200)] + [(600 + i, None if i % 2 else "") for i in range(40)] + [(None, f"own {i}") for i in range(360)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(50)
    plain = Counter(shards(docs).collect())
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in conf}
    before = written(spark)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = shards(docs)
        assert Counter(out.collect()) == plain
        assert out.rdd.getNumPartitions() == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    made = Counter(os.path.dirname(x) for x in written(spark) - before)
    assert made and max(made.values()) == 1 and len(made) <= 13
