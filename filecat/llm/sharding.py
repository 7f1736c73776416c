"""Shards of documents by balanced label propagation.

Documents are linked by what they share (a hub; here: equal texts), never by pairs. Every document
starts on a shard by hash. In each round every hub's documents want the shard where most of their
neighbours are, among those with room; wishes are granted, largest hubs first, up to each shard's
quota. Documents that no shard takes whole, and those without links, fill what is left exactly.

All documents of a hub on one shard act alike, so the state is a table (hub, shard, documents).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.common import cut

HUB = ["h1", "h2", "size"]
#: Ranks are dealt out in so many parts; their counts are the only thing summed in one place.
PARTS = 2048
#: A checkpoint is a file for so many rows, however many partitions a shuffle has: on a local disk every file's
#: rights are set by processes of their own (chmod), and while a process starts the executor's memory counts twice.
FILE_ROWS = 1 << 14


def files(rows: int) -> int:
    return rows // FILE_ROWS + 1


def label_propagation(state: DataFrame, free: list[int], rounds: int = 8) -> tuple[DataFrame, list[int]]:
    """Hubs of several documents with n and the shard that takes them all (null: a hub that fits nowhere), and the room that remains.

    state: hub columns, shard, n (documents of the hub on that shard)."""
    vote = F.struct(F.col("n"), F.xxhash64(*HUB, "shard"), F.col("shard"))
    hubs = state.groupBy(*HUB).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(vote), asc=False).alias("votes")).where("total > 1")
    todo = cut(hubs.coalesce(files(sum(free))))
    parts = files(todo.count())
    home: list[DataFrame] = []
    for _ in range(rounds):
        room = F.array(*(F.lit(x).cast("long") for x in free))
        widest = max(range(len(free)), key=lambda s: free[s])
        voted = F.get(F.filter("votes", lambda v: F.get(room, v["shard"]) >= F.col("total")), F.lit(0))["shard"]
        wish = todo.withColumn("shard", F.coalesce(voted, F.when(F.col("total") <= free[widest], F.lit(widest))))
        home.append(wish.where("shard is null"))  # room only shrinks
        # largest first: by powers of two, then by hash; sums over few parts, then within each part
        part = (F.lit(64) - F.floor(F.log2("total")).cast("int")) * 64 + F.pmod(F.xxhash64(*HUB), F.lit(64)).cast("int")
        wish = wish.where("shard is not null").withColumn("part", part)
        sums = wish.groupBy("shard", "part").agg(F.sum("total").alias("docs"))
        before = sums.select("shard", "part", (F.sum("docs").over(Window.partitionBy("shard").orderBy("part")) - F.col("docs")).alias("before"))
        inner = Window.partitionBy("shard", "part").orderBy(F.desc("total"), *HUB).rowsBetween(Window.unboundedPreceding, 0)
        asked = wish.withColumn("within", F.sum("total").over(inner)).join(before, ["shard", "part"])
        asked = cut(asked.select(*HUB, "total", "votes", "shard", (F.col("before") + F.col("within") <= F.get(room, F.col("shard"))).alias("granted")).coalesce(parts))
        used = {r["shard"]: r["docs"] for r in asked.where("granted").groupBy("shard").agg(F.sum("total").alias("docs")).collect()}  # one row for each shard
        todo = asked.where("not granted").drop("shard", "granted")
        if not used:
            break
        free = [x - used.get(s, 0) for s, x in enumerate(free)]
        home.append(asked.where("granted"))
    home.append(todo.withColumn("shard", F.lit(None).cast("int")))
    return reduce(DataFrame.union, (h.select(*HUB, F.col("total").alias("n"), "shard") for h in home)), free


def ranked(rows: DataFrame, by: list[str], part: Column, order: list[str], to: str) -> DataFrame:
    """Gapless ranks from 0 within `by`: counts of bounded many parts are summed, then rows are numbered within a part."""
    rows = rows.withColumn("part", part)
    counts = rows.groupBy(*by, "part").count()
    before = counts.select(*by, "part", (F.sum("count").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("part")) - F.col("count")).alias("before"))
    own = Window.partitionBy(*by, "part").orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(own)).join(before, [*by, "part"]).withColumn(to, (F.col("before") + F.col("nth") - 1).cast("long")).drop("part", "nth", "before")


def with_hubs(rows: DataFrame, hubs: DataFrame, total: int) -> DataFrame:
    """rows with their hub's columns. The rows of a hub that holds more than a PARTS-th of all meet it where they are: there are fewer than PARTS such hubs."""
    hubs = cut(hubs.coalesce(files(total)))
    large = hubs.where(F.col("n") > max(total // PARTS, 1))
    rest = rows.join(F.broadcast(large.select(*HUB)), HUB, "left_anti").join(hubs.join(F.broadcast(large.select(*HUB)), HUB, "left_anti"), HUB, "left")
    return rows.join(F.broadcast(large), HUB).unionByName(rest)


def shards(docs: DataFrame, count: int = 16, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs, under the law `rows`.

    Shards' counts are at most one apart. Documents of equal text share a shard unless they are too many
    for one; then they fill shards in a row. A null text counts as empty, with size 1; rows with a null
    doc_id and repeated rows are documents like any other; an empty table gives an empty result; further
    columns are not read. The driver holds one number for each shard. The rows of docs are counted first, then read.
    """
    parts = files(docs.count())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h1"))
    rows = rows.withColumn("h2", F.col("text_crc32")).withColumn("first", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(count)).cast("int"))
    rows = cut(rows.repartition(parts))
    total = rows.count()
    quota = [total // count + (s < total % count) for s in range(count)]
    state = rows.groupBy(*HUB, F.col("first").alias("shard")).agg(F.count("*").alias("n"))
    home, free = label_propagation(state, quota, rounds)
    placed = cut(with_hubs(rows, home, total).coalesce(parts))
    # what is left: large hubs in a row, then documents without links
    mixed = F.pmod(F.xxhash64("doc_id", "h1"), F.lit(PARTS)).cast("int")
    part = F.when(F.col("n") > 1, F.pmod(F.xxhash64(*HUB), F.lit(PARTS // 16)).cast("int") * 16 + mixed % 16).otherwise(mixed + PARTS)
    rest = ranked(placed.where("shard is null").drop("shard"), [], part, [*HUB, "doc_id"], "rank")
    ends = [sum(free[: s + 1]) for s in range(count)]
    shard = F.coalesce(*(F.when(F.col("rank") < end, F.lit(s)) for s, end in enumerate(ends)))
    columns = ["doc_id", "size", "text_crc32", "h1", "shard"]
    all_ = cut(placed.where("shard is not null").select(columns).union(rest.withColumn("shard", shard).select(columns)).coalesce(parts))
    out = ranked(all_, ["shard"], F.pmod(F.xxhash64("doc_id", "h1"), F.lit(PARTS // 8)).cast("int"), ["doc_id", "h1", "size"], "slot")
    return out.coalesce(parts).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
