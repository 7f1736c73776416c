"""Repairs the turns of conversations: Wagner-Fischer alignment with the strings of an alternating grammar.

A conversation's roles should read `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn.
Turns are aligned with each feasible length of that string: keep, rerole, delete and insert have costs, a
cell of the table is worked out only where the difference of lengths does not already cost more than the
incumbent (Ukkonen's band), and of the cheapest alignments the least audit (the edits' initials) wins.

The grammar's strings have the same tail whatever their length, so one table by (turn, letters left) serves
all lengths. A conversation of any length is cut into parts of PART turns. A part is aligned for every phase
of the grammar that it may begin and end in; the parts' costs, sixteen numbers each, are summed from the last
to the first; then each part finds its least audit on its own. Inserts belong to the turn they stand
before, so that audits of parts just follow one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import cut, set_out
from filecat.llm.ranks import join_safe, numbered

#: Turns of a part.
PART = 256
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: A turn's code is a hexadecimal digit: its role's initial by ROLES (3: another), plus four times its fault by FAULTS.
ROLES, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
#: Phases: nothing yet, after the system turn, after a user turn, after an assistant turn. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
ENDS = (0, FAR, FAR, 0)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the CRC-32 of `conv_id:turn`; a null there, and as role or text, is one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", shown("conv_id"), shown("turn")), "UTF-8")) % 20
    own = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the latter two, and same: a digest of both."""
    own = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return own.withColumn("same", F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, at, code of every turn: its place in its conversation and its digit. Texts stay where they are read."""
    bare = F.rtrim("text", F.lit(BLANKS))
    role = F.coalesce(*(F.when(F.substring("role", 1, 1) == r, F.lit(i)) for i, r in enumerate(ROLES)), F.lit(3))
    narrow = rows.select("conv_id", "turn", "same", role.alias("role"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    placed = cut(numbered(narrow, ["conv_id"], ["turn", "same"], "at"))
    first = placed.groupBy("conv_id", "same").agg(F.min("at").alias("first"))  # one row for each distinct turn, summed before it is shuffled
    both = join_safe(placed, first, ["conv_id", "same"])
    fault = F.when(F.col("blank"), 2).when(F.col("at") > F.col("first"), 3).when(F.col("open"), 1).otherwise(0)
    return both.select("conv_id", "turn", "at", F.lower(F.hex(F.col("role") + 4 * fault)).alias("code"))


def parts_of(turns: DataFrame) -> DataFrame:
    """conv_id, part, codes, and the least, greatest and number of distinct turns in each part."""
    own = turns.groupBy("conv_id", F.floor(F.col("at") / PART).cast("long").alias("part"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")  # PART of them at most
    return own.agg(listed.alias("codes"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))


class Table:
    """left[i][r]: the least cost of turns i, i + 1, ... aligned with the last r letters of the target, which ends in `end`.

    Without `trailing` the last edit has to take up a turn."""

    def __init__(self, codes: str, end: int, trailing: bool, bound: int):
        self.codes, self.end, self.trailing = [int(c, 16) for c in codes], end, trailing
        n = len(self.codes)
        width = 2 * n + 4
        live = [c < 8 for c in self.codes]
        self.left = np.full((n + 1, width), FAR, np.int64)
        self.left[n, 0] = 0
        if trailing:
            self.left[n] = INSERT * np.arange(width)
        odd = np.arange(width) % 2 == 1
        letter = np.where(odd, end, USER + ASSISTANT - end)  # by letters left, the first of them
        rise = INSERT * np.arange(width)
        rest = 0
        for i in range(n - 1, -1, -1):
            code, below = self.codes[i], self.left[i + 1]
            rest += live[i]
            low, high = max(0, rest - bound // DELETE), min(width, rest + bound // INSERT + 1)  # Ukkonen's band
            row = below[low:high] + DELETE
            if live[i]:
                change = np.where(letter[low:high] == (code & 3) + 1, 0, REROLE) + (CUT_OFF if code >> 2 == 1 else 0)
                taken = np.concatenate([[FAR], below])[low:high] + change
                row = np.minimum(row, taken)
            self.left[i, low:high] = np.minimum.accumulate(row - rise[low:high]) + rise[low:high]
        self.letter = letter

    def audit(self, i: int, r: int) -> str:
        """The least audit of the cheapest alignments of turns i, ... with the last r letters."""
        out, n = [], len(self.codes)
        while i < n or r:
            cost = self.left[i, r]
            if i < n and self.left[i + 1, r] + DELETE == cost:
                out.append("D")
                i += 1
            elif r and (i < n or self.trailing) and self.left[i, r - 1] + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if (self.codes[i] & 3) + 1 == self.letter[r] else "R")
                i, r = i + 1, r - 1
        return "".join(out)


@lru_cache(maxsize=8)
def tables(codes: str, trailing: bool) -> tuple[Table, Table]:
    """The tables of targets that end with a user and an assistant turn.

    The incumbent takes every turn that can stay, reroled where the letters differ, in the worse of both phases, and
    inserts up to three turns to mend the ends; turns that must go are left out of it and of the band."""
    live = [c for c in (int(x, 16) for x in codes) if c < 8]
    differ = [sum((c & 3) + 1 != (USER, ASSISTANT)[(k + at) % 2] for k, c in enumerate(live)) for at in (0, 1)]
    bound = REROLE * max(differ) + CUT_OFF * sum(c >> 2 == 1 for c in live) + 3 * INSERT + 2 * REROLE
    return Table(codes, USER, trailing, bound), Table(codes, ASSISTANT, trailing, bound)


def lengths(table: Table, entry: int) -> range:
    """The letters that a target can have which goes on from the entry phase and ends as the table does."""
    first = ASSISTANT if entry == USER else USER
    least = 1 if table.end == first else 2
    if entry in (USER, ASSISTANT) and entry == table.end:
        least = 0
    return range(least, table.left.shape[1], 2)


def ways(codes: str, entry: int, trailing: bool) -> Iterator[tuple[int, int, int, Table | None, int]]:
    """(exit phase, least cost, turns deleted before a kept system turn or -1, table, letters) of each target from the entry phase on.

    A table of None: the empty target."""
    own = [int(c, 16) for c in codes]
    found = tables(codes, trailing)
    if entry in (START, SYSTEM):
        yield entry, DELETE * len(own), -1, None, 0
    for table in found:
        for r in lengths(table, entry):
            yield table.end, int(table.left[0, r]), -1, table, r
    if entry != START:
        return
    system = [i for i, c in enumerate(own) if c < 8 and c & 3 == 0]
    for i in system:
        kept = DELETE * i + (CUT_OFF if own[i] >> 2 == 1 else 0)
        yield SYSTEM, kept + DELETE * (len(own) - i - 1), i, None, 0
        for table in found:
            at = np.arange(table.left.shape[1])[lengths(table, SYSTEM).start :: 2]
            best = int(at[table.left[i + 1, at].argmin()])
            least = int(table.left[i + 1, best])
            for r in at[table.left[i + 1, at] == least].tolist():
                yield table.end, kept + least, i, table, r


@lru_cache(maxsize=1 << 15)
def costs(codes: str, trailing: bool, first: bool) -> tuple[int, ...]:
    """The least cost from each entry phase (row) to each exit phase."""
    out = [FAR] * 16
    for entry in (START,) if first else range(4):
        for exit_, cost, *_ in ways(codes, entry, trailing):
            out[4 * entry + exit_] = min(out[4 * entry + exit_], cost)
    return tuple(min(x, FAR) for x in out)


@lru_cache(maxsize=1 << 15)
def best_audit(codes: str, entry: int, after: tuple[int, ...], trailing: bool) -> tuple[str, int]:
    """The least audit of the cheapest alignments, and its exit phase; after: what the rest costs by exit phase."""
    found = [(cost + after[exit_], exit_, system, table, r) for exit_, cost, system, table, r in ways(codes, entry, trailing)]
    least = min(x[0] for x in found)
    if least >= FAR:
        return "", entry
    found = [x for x in found if x[0] == least]
    latest = max(x[2] for x in found)  # deletes come before a kept turn, so of kept system turns the latest makes the least audit
    audits = []
    for _, exit_, system, table, r in (x for x in found if x[2] in (-1, latest)):
        head = "D" * system + "K" if system >= 0 else ""
        audits.append((head + (table.audit(system + 1, r) if table else "D" * (len(codes) - system - 1)), exit_))
    return min(audits)


def audits(parts: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit of every conversation in parts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("codes").to_pylist(), batch.column("part").to_pylist(), batch.column("last").to_pylist())
            yield set_out({c: (batch.column(c), batch.schema.field(c).type) for c in batch.schema.names} | {"costs": ([costs(codes, part == last, part == 0) for codes, part, last in own], pa.list_(pa.int64()))})

    last = parts.groupBy("conv_id").agg(F.max("part").alias("last"))
    key = parts.schema["conv_id"].dataType.simpleString()
    kinds = f"conv_id {key}, part long, codes string, last long"
    measured = cut(join_safe(parts, last, ["conv_id"]).select("conv_id", "part", "codes", "last").mapInArrow(measure, f"{kinds}, costs array<long>"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What comes after each part, by the phase it ends in."""
        for batch in batches:
            row, part, after = [], [], []
            for k, own in enumerate(batch.column("own").to_pylist()):
                now = ENDS
                for one in reversed(own):
                    row.append(k)
                    part.append(one["part"])
                    after.append(list(now))
                    now = tuple(min(min(one["costs"][4 * a + b] + now[b] for b in range(4)), FAR) for a in range(4))
            yield set_out({"conv_id": (batch.column("conv_id").take(pa.array(row, pa.int64())), batch.schema.field("conv_id").type), "part": (part, pa.int64()), "after": (after, pa.list_(pa.int64()))})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, exits = [], []
            for codes, part, end, after in zip(*(batch.column(c).to_pylist() for c in ("codes", "part", "last", "after"))):
                found = [best_audit(codes, entry, tuple(after), part == end) for entry in ((START,) if part == 0 else range(4))]
                text.append([x[0] for x in found])
                exits.append([x[1] for x in found])
            yield set_out({c: (batch.column(c), batch.schema.field(c).type) for c in ("conv_id", "part", "codes")} | {"audits": (text, pa.list_(pa.string())), "exits": (exits, pa.list_(pa.int32()))})

    # sixteen numbers and at most 4 x 4 PART letters for each part: less than the audit of the whole conversation is long
    sums = measured.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("own")).mapInArrow(compose, f"conv_id {key}, part long, after array<long>")
    traced = join_safe(measured.drop("costs"), sums, ["conv_id", "part"]).select("conv_id", "part", "codes", "last", "after").mapInArrow(trace, f"conv_id {key}, part long, codes string, audits array<string>, exits array<int>")
    whole = join_safe(traced, parts.drop("codes"), ["conv_id", "part"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "codes", "audits", "exits", "low", "high", "turns"))).alias("own"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [summary(own) for own in batch.column("own").to_pylist()]
            names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            yield set_out({"conv_id": (batch.column("conv_id"), batch.schema.field("conv_id").type)} | {c: ([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)} | {"audit": ([r[-1] for r in rows], pa.string())})

    return whole.mapInArrow(chain, f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


#: Neighbours that may follow each other, by their codes' roles.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def summary(parts: list[dict]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit of a conversation from its parts in order."""
    codes, phase, audit = "".join(p["codes"] for p in parts), START, []
    for p in parts:
        at = phase if len(p["audits"]) > 1 else 0
        audit.append(p["audits"][at])
        phase = p["exits"][at]
    fault = [int(c, 16) >> 2 for c in codes]
    role = [int(c, 16) & 3 for c in codes]
    known = [p for p in parts if p["low"] is not None]
    shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - (sum(p["turns"] for p in known) - shared) if known else 0
    audit = "".join(audit)
    taken = [x for x in audit if x != "I"]
    cost = REROLE * audit.count("R") + DELETE * audit.count("D") + INSERT * audit.count("I") + CUT_OFF * sum(f == 1 and x != "D" for f, x in zip(fault, taken))
    return gaps, fault.count(2), fault.count(3), fault.count(1), sum(pair not in LEGAL for pair in zip(role, role[1:])), cost, audit


def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, object, bytes, bytes]]:
    """(number of the conversation in this task, conv_id, role, text) of every repaired turn in order; first (number, conv_id, None, None).

    Rows come sorted by conversation, its audit first; none is held."""
    number, audit, at, sent, phase, now = -1, "", 0, 0, START, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, phase
        while at < len(audit) and audit[at] == "I":
            phase = ASSISTANT if phase == USER else USER
            at += 1
            yield number, now, b"user" if phase == USER else b"assistant", b""

    for batch in batches:
        ids = batch.column("conv_id")
        first, role, text = batch.column("audit"), batch.column("role"), batch.column("text")
        for k in range(batch.num_rows):
            if first[k].is_valid:
                yield from inserted()
                number, now, audit, at, phase = number + 1, ids[k].as_py(), first[k].as_py(), 0, START
                yield number, now, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            own = role[k].as_py().encode()
            if edit == "R":
                phase = ASSISTANT if phase == USER else USER
                own = b"user" if phase == USER else b"assistant"
            else:
                phase = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}[own[:1]]
            yield number, now, own, text[k].as_py().encode()
    yield from inserted()


def _streamed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns by conversation and place, each conversation's audit before them. A digest of a whole conversation reads it in one task, as a sorted stream."""
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("same"), "audit")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "same", F.lit(None).cast("string").alias("audit"))
    both = heads.union(rows).withColumn("_row", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "same").select("conv_id", "audit", "role", "text")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations; turns: turns_of(), found: audits()."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            target, held, place, size = first.schema.field("conv_id").type, [], 0, 0
            for _, conv, role, text in mended(_again(first, batches)):
                if role is None:
                    place = 0
                    continue
                held.append((conv, place, role, text))
                place, size = place + 1, size + len(text)
                if size > 1 << 20 or len(held) > 10_000:
                    yield out(held, target)
                    held, size = [], 0
            if held:
                yield out(held, target)

    def out(held: list[tuple], target: pa.DataType) -> pa.RecordBatch:
        ids, places, roles, texts = zip(*held)
        return set_out({"conv_id": (ids, target), "place": (places, pa.int64()), "role": (pa.array(roles, pa.binary()).cast(pa.string()), pa.string()), "text": (pa.array(texts, pa.binary()).cast(pa.string()), pa.string())})

    return _streamed(turns, found).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired `role:text`, joined by line ends."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            target = first.schema.field("conv_id").type
            ids, sums, hashed, begun = [], [], None, False
            for _, conv, role, text in mended(_again(first, batches)):
                if role is None:
                    if hashed:
                        sums.append(hashed.hexdigest())
                    if len(sums) >= 10_000:
                        yield set_out({"conv_id": (pa.array(ids, target), target), "repaired_sha256": (sums, pa.string())})
                        ids, sums = [], []
                    ids.append(conv)
                    hashed, begun = hashlib.sha256(), False
                    continue
                hashed.update((b"\n" if begun else b"") + role + b":")
                hashed.update(text)
                begun = True
            sums.append(hashed.hexdigest())
            yield set_out({"conv_id": (pa.array(ids, target), target), "repaired_sha256": (sums, pa.string())})

    return _streamed(turns, found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text. conversations: conv_ids to return besides those of rows, with zeros, an
    empty audit and the digest of nothing. Turns are ordered by turn, nulls first, equal ones by role and text;
    a null role or text is one space; a null conv_id is a conversation like any other; repeated rows are turns
    of their own (and duplicates); an empty table gives an empty result; further columns are not read. What a
    conversation's alignment gathers is a digit for each turn, cut into parts; texts are hashed as a stream.
    """
    turns = turns_of(rows)
    found = cut(audits(cut(parts_of(coded(turns)))))
    out = join_safe(found, digests(turns, found), ["conv_id"])
    if conversations is None:
        return out
    every = conversations.select("conv_id").distinct()
    whole = join_safe(every.withColumn("_every", F.lit(True)), out, ["conv_id"], "left")
    counts: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
