"""A Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf; leaves are ordered within their source and cut into blocks of `fanout` ** `height`
leaves, each a whole subtree. Then, round by round, aligned groups of `fanout` subtrees swap their roots:
the block in lane l of one subtree meets the blocks in lane l of its siblings, each of them hashes the
common ancestor for itself and keeps the siblings' roots as the next level of its proof. After as many
rounds as the tree has levels above the blocks every block holds its whole upper proof, and no pass goes
down again. A shorter last subtree has fewer blocks than lanes; its blocks serve several lanes each.
The roots of sources are exchanged in the same way, one participant for each source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.common import cut, set_out
from filecat.llm.ranks import join_safe, numbered

PATH = "array<struct<before:string,after:string>>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """`-`, or the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in FIELDS if c != "text"), field(text)), 256)


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of each level, from the leaves up: `height` levels of them, or (None) until one node is left."""
    out = [leaves]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def climbed(nodes: DataFrame, key: str | None, fanout: int) -> DataFrame:
    """nodes (key, place, n, node, path) after all rounds: node is their tree's root, path has every level's siblings.

    place: of the participant within its tree of n; places are gapless from 0."""
    by = [key] if key else []
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    width, rounds = 1, 0
    while width < most:
        over = F.col("n") > width
        own, lane = F.floor(F.col("place") / width).cast("long"), F.col("place") % width
        last = F.floor((F.col("n") - 1) / width).cast("long")
        short = (own == last) & (own % fanout > 0) & over  # the last subtree, where it has siblings: they are all whole
        lanes = F.when(short, F.sequence(lane, F.lit(width - 1).cast("long"), F.col("n") - last * width)).otherwise(F.array(lane))
        sent = nodes.withColumns({"_own": own, "_lane": F.explode(lanes)})
        meet = Window.partitionBy(*by, F.when(over, F.floor(F.col("_own") / fanout)).otherwise(F.lit(-1)), F.when(over, F.col("_lane")).otherwise(F.col("place")))
        met = F.sort_array(F.collect_list(F.struct(F.col("_own").alias("at"), "node")).over(meet))  # at most fanout of them
        sent = sent.withColumn("_met", met).where(F.col("_lane") == lane)
        side = lambda keep: F.array_join(F.transform(F.filter("_met", keep), lambda m: m["node"]), "")
        level = F.struct(side(lambda m: m["at"] < F.col("_own")).alias("before"), side(lambda m: m["at"] > F.col("_own")).alias("after"))
        nodes = sent.select(
            *by, "place", "n", F.when(over, F.sha2(F.array_join(F.transform("_met", lambda m: m["node"]), ""), 256)).otherwise(F.col("node")).alias("node"),
            F.when(over, F.concat("path", F.array(level))).otherwise(F.col("path")).alias("path"),
        )
        width, rounds = width * fanout, rounds + 1
        if rounds % 4 == 0:
            nodes = cut(nodes)
    return nodes


def manifest(docs: DataFrame, fanout: int = 3, height: int = 6, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs; proof: the siblings' digests by level.

    tampered: a text to fold up from instead of the row's own; null or none: the row's own. A null in any
    column is a field of its own kind (`-`); rows with a null source are the first source, rows with a null
    doc_id come first in theirs; rows with one doc_id are ordered by their leaves, and equal rows are leaves
    of their own, in any order; an empty table gives an empty result; further columns are not read. Texts
    are hashed where they are read; what moves are digests. A block has fanout ** height leaves at most,
    a round sends at most two rows for each block, and the driver sees the largest number of blocks alone.
    """
    size = fanout**height
    text = F.col("text").cast("string")
    own = docs.select(*FIELDS, (text if tampered is None else F.coalesce(tampered, text)).alias("_other"))
    rows = own.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("leaf"), F.when(~F.col("_other").eqNullSafe(text), leaf(F.col("_other"))).alias("other"))
    placed = numbered(rows, ["source"], ["doc_id", "leaf"], "at").withColumn("place", F.floor(F.col("at") / size).cast("long"))
    blocks = cut(placed.groupBy("source", "place").agg(F.sort_array(F.collect_list(F.struct("at", "leaf", "doc_id", "other"))).alias("rows")))
    held = blocks.groupBy("source").agg(F.sum(F.size("rows")).alias("leaves"), F.count("*").alias("n"))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [levels(own, fanout, height if n > 1 else None)[-1][0] for own, n in zip(batch.column("leaves").to_pylist(), batch.column("n").to_pylist())]
            yield set_out({c: (batch.column(c), batch.schema.field(c).type) for c in ("source", "place", "n")} | {"node": (tops, pa.string())})

    narrow = join_safe(blocks, held.select("source", "n"), ["source"]).select("source", "place", "n", F.transform("rows", lambda r: r["leaf"]).alias("leaves"))
    lowest = cut(narrow.mapInArrow(roots, "source string, place long, n long, node string")).withColumn("path", F.array().cast(PATH))
    upper = cut(climbed(lowest, "source", fanout))
    subroots = numbered(upper.where("place = 0").select("source", F.col("node").alias("subroot")), [], ["source"], "place")
    total = subroots.agg(F.count("*").alias("n"))
    top = climbed(subroots.crossJoin(F.broadcast(total)).select("place", "n", F.col("subroot").alias("node"), F.array().cast(PATH).alias("path")), None, fanout)  # total is one row
    top = subroots.join(top.select("place", F.col("node").alias("root"), F.col("path").alias("top")), "place").drop("place")
    proofs = join_safe(upper, top, ["source"]).select("source", "place", "n", "subroot", "root", F.concat("path", "top").alias("path"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                yield folded(one)

    def folded(one: dict) -> pa.RecordBatch:
        rows, above = one["rows"], [(p["before"], p["after"]) for p in one["path"]]
        tree = levels([r["leaf"] for r in rows], fanout, height if one["n"] > 1 else None)
        out: list[list] = [[], []]
        for i, row in enumerate(rows):
            proof, now = [], row["other"] or row["leaf"]
            for nodes in tree[:-1]:
                run = i - i % fanout
                before, after = "".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])
                proof += [before, after]
                now = digest([before, now, after])
                i //= fanout
            for before, after in above:
                proof += [before, after]
                now = digest([before, now, after])
            out[0].append(digest(proof))
            out[1].append(now)
        n = len(rows)
        return set_out({
            "doc_id": ([r["doc_id"] for r in rows], pa.int64()), "leaf": ([r["leaf"] for r in rows], pa.string()), "subroot": ([one["subroot"]] * n, pa.string()), "root": ([one["root"]] * n, pa.string()),
            "proof_sha256": (out[0], pa.string()), "folded_root": (out[1], pa.string()), "verified": ([x == one["root"] for x in out[1]], pa.bool_()),
        })

    whole = join_safe(blocks, proofs, ["source", "place"]).select("rows", "n", "subroot", "root", "path")
    return whole.mapInArrow(fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def without_line_ends(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text without its line ends where 2 divides the CRC-32 of the decimal doc_id (null: no digits), else null."""
    checksum = F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8"))
    return F.when(checksum % 2 == 0, F.replace(F.col(text).cast("string"), F.lit("\n"), F.lit("")))
