"""Packs tokenised documents into sequences of fixed length by linear grouping.

Lengths are whole numbers up to the sequence length, so the corpus enters the plan as a histogram of
that bounded size. Large lengths are rounded up within groups of equal cardinality; the few sizes
that come out are packed by configurations (a linear programme solved by column generation, rounded
down); actual documents take the places of the rounded ones; all others go in by best fit, largest
first; sequences that stay emptier than others are taken apart and filled once more. Spark then ranks the pieces of each length and deals them out to the planned places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filecat.llm.bpe_codec import encoder
from filecat.llm.common import cut, documents, set_out, slices, texts_of
from filecat.llm.word_bpe import REMEMBERED

#: Pieces of one length are ranked in so many parts, dealt by a hash.
PARTS = 64


def grouped(histogram: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(size, [(length, count)]) of groups of equal cardinality, largest first; size: the largest length in the group."""
    total = sum(histogram.values())
    out: list[tuple[int, list[tuple[int, int]]]] = []
    left = 0
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not left:
                left = -(-total // groups)
                out.append((length, []))
            take = min(left, count)
            out[-1][1].append((length, take))
            left, count = left - take, count - take
    return out


class Configurations:
    """Finds the multiset of sizes within room that is worth most. All sizes are large, so that a multiset has few of them."""

    def __init__(self, sizes: np.ndarray, room: int):
        self.sizes, self.room = sizes, room
        left = np.arange(room + 1)[:, None] - sizes
        self.left, self.fits = np.maximum(left, 0), left >= 0

    def best(self, worth: np.ndarray) -> np.ndarray:
        most = self.room // int(self.sizes.min())
        value, taken = np.zeros(self.room + 1), []
        for k in range(most):  # value: of at most k sizes, by room
            rows = slice(self.room, None) if k == most - 1 else slice(None)
            with_each = np.where(self.fits[rows], value[self.left[rows]] + worth, -1.0)
            pick = with_each.argmax(axis=1)
            now = np.maximum(with_each[np.arange(len(pick)), pick], 0.0)
            taken.append(np.where(now > 0, pick, -1))
            value = now
        out, at = np.zeros(len(self.sizes)), self.room
        for k in range(most - 1, -1, -1):
            i = int(taken[k][0 if k == most - 1 else at])
            if i >= 0:
                out[i] += 1
                at -= int(self.sizes[i])
        return out


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row operations alone.

    LAPACK and BLAS keep threads of their own; in a process that has started a JVM by forking these may wait for
    each other without end, so the driver calls neither. The basis has at most as many rows as there are groups."""
    n = len(basis)
    rows = np.concatenate([basis.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        top = k + int(np.abs(rows[k:, k]).argmax())
        if top != k:
            rows[[k, top]] = rows[[top, k]]
        rows[k] /= rows[k, k]
        by = rows[:, k].copy()
        by[k] = 0
        rows -= np.multiply.outer(by, rows[k])
    return rows[:, n:]


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 300) -> list[tuple[int, np.ndarray]]:
    """(times, how many of each size): the linear programme's solution by column generation, rounded down."""
    basis, inverse = np.diag((room // sizes).astype(float)), np.diag(1 / (room // sizes))
    search = Configurations(sizes, room)
    for k in range(rounds):
        if k % 100 == 99:
            inverse = inverted(basis)  # against rounding errors
        amount, worth = (inverse * demand).sum(axis=1), inverse.sum(axis=0)
        new = search.best(np.maximum(worth, 0))
        if (worth * new).sum() <= 1 + 1e-7:
            break
        step = (inverse * new).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(amount, 0) / step, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = new
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= np.multiply.outer(step, inverse[out])
    amount = (inverted(basis) * demand).sum(axis=1)
    return [(n, basis[:, k]) for k in range(len(sizes)) if (n := int(amount[k] + 1e-9)) > 0]


def substituted(groups: list[tuple[int, list[tuple[int, int]]]], chosen: list[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, list[int]]], Counter]:
    """Runs of equal sequences (times, lengths) with actual lengths in the places of rounded ones, and what is left over."""
    queues = [list(reversed(runs)) for _, runs in groups]
    runs: list[tuple[int, list[int]]] = []
    for times, config in chosen:
        slots = [g for g, n in enumerate(config) for _ in range(int(round(n)))]
        pulled: list[list[tuple[int, int]]] = []
        for g in slots:
            need, own = times, []
            while need and queues[g]:
                length, count = queues[g].pop()
                take = min(need, count)
                own.append((length, take))
                need -= take
                if count > take:
                    queues[g].append((length, count - take))
            pulled.append(own)
        at = 0
        ends = sorted({e for own in pulled for e in np.cumsum([c for _, c in own]).tolist()} | {times})
        for end in ends:
            here = [x for own in pulled for x in _at(own, at)]
            if here:
                runs.append((end - at, here))
            at = end
    left: Counter = Counter()
    for queue in queues:
        for length, count in queue:
            left[length] += count
    return runs, left


def _at(own: list[tuple[int, int]], place: int) -> list[int]:
    for length, count in own:
        if place < count:
            return [length]
        place -= count
    return []


def best_plan(histogram: dict[int, int], room: int) -> np.ndarray:
    """The plan with the fewest sequences, of those that call lengths above a quarter, a third or half of a sequence large."""
    return min((plan(histogram, room, 128, room // part) for part in (4, 3, 2)), key=lambda p: p[0])[1]


def used(open_: dict[int, list[tuple[int, Counter]]]) -> int:
    """How many sequences are not empty."""
    return sum(times for own in open_.values() for times, held in own if held)


def best_fit(open_: dict[int, list[tuple[int, Counter]]], rest: Counter, room: int) -> None:
    """Puts lengths, largest first, where they leave least free; open_: runs of equal sequences (times, lengths) by free space."""
    free = sorted(space for space in open_ if open_[space])

    def put(space: int, times: int, held: Counter) -> None:
        if times and not open_[space]:
            insort(free, space)
        if times:
            open_[space].append((times, held))

    for length in sorted(rest, reverse=True):
        count = rest[length]
        while count:
            k = bisect_left(free, length)
            if k == len(free):
                put(room, -(-count // (room // length)), Counter())
                continue
            space = free[k]
            times, held = open_[space].pop()
            if not open_[space]:
                free.pop(k)
            each = min(space // length, count)
            full = min(times, count // each)
            put(space, times - full, held)
            put(space - each * length, full, held + Counter({length: each}))
            count -= full * each


def plan(histogram: dict[int, int], room: int, groups: int, large: int, share: float = 0.3) -> tuple[int, np.ndarray]:
    """The number of sequences, and rows (length, from rank, first sequence, pieces of that length in each sequence, offset of the first), sorted.

    Lengths above `large` are grouped and packed by configurations. These leave free what the small lengths
    need (the given share of their sum, dealt over all sequences), so that they fill what is left. A length
    that does not fit beside that stands alone.
    The pieces of one length with ranks from `from rank` up to the next row's fill one run of equal
    sequences after another. There are at most a few rows for each length and run, however many pieces."""
    runs: list[tuple[int, list[int]]] = [(histogram[room], [room])] if histogram.get(room) else []
    rest: Counter = Counter({n: c for n, c in histogram.items() if n <= large and n < room})
    open_sequences = max(1, -(-sum(n * c for n, c in histogram.items() if n < room) // room))
    tight = room - int(share * sum(n * c for n, c in rest.items()) / open_sequences)
    big = {n: c for n, c in histogram.items() if large < n <= tight and n < room}
    runs += [(c, [n]) for n, c in histogram.items() if max(tight, large) < n < room]
    if big:
        parts = grouped(big, groups)
        sizes, at = np.unique([s for s, _ in parts], return_inverse=True)
        merged = [(int(s), [r for (_, rs), k in zip(parts, at) if k == i for r in rs]) for i, s in enumerate(sizes)]
        demand = np.array([sum(c for _, c in rs) for _, rs in merged], float)
        more, left = substituted(merged, configurations(sizes, demand, tight))
        runs += more
        rest += left
    open_: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
    for times, lengths in runs:
        open_[room - sum(lengths)].append((times, Counter(lengths)))
    best_fit(open_, rest, room)
    for least in (room // 8, room // 32, room // 128, room // 512, 1):  # sequences that stayed emptier than that are taken apart and filled anew
        apart = {space: open_[space] for space in open_ if space >= least}
        again: Counter = Counter()
        for times, held in (x for own in apart.values() for x in own):
            again.update({n: times * each for n, each in held.items()})
        tried = defaultdict(list, {space: list(own) for space, own in open_.items() if space < least})
        best_fit(tried, again, room)
        if used(tried) < used(open_):
            open_ = tried
    rows, sequence, rank = [], 0, Counter()
    for space in sorted(open_):
        for times, held in open_[space]:
            offset = 0
            for length, each in sorted(held.items(), reverse=True):
                rows.append((length, rank[length], sequence, each, offset))
                rank[length] += times * each
                offset += each * length
            sequence += times if held else 0
    return sequence, np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, path: str, room: int, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and its closing id 0, cut after each `room` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = 4 * room
        for batch in slices(batches):
            row, number, length, crc = [], [], [], []
            held = [bytearray() for _ in range(batch.num_rows)]
            pieces = [0] * batch.num_rows

            def put(k: int) -> None:
                row.append(k)
                number.append(pieces[k])
                length.append(min(full, len(held[k])) // 4)
                crc.append(zlib.crc32(held[k][:full]))
                del held[k][:full]
                pieces[k] += 1

            for k, part in encoder(path, remembered).parts(texts_of(batch)):
                held[k] += part
                while len(held[k]) > full:
                    put(k)
            for k, rest in enumerate(held):
                rest += bytes(4)
                while rest:
                    put(k)
            number = np.array(number, np.int64)
            yield set_out({"doc_id": (batch.column("doc_id").take(pa.array(row, pa.int64())), pa.int64()), "piece": (number, pa.int32()), "start": (number * room, pa.int64()), "length": (length, pa.int64()), "ids_crc32": (crc, pa.int64())})

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, room: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Documents end with id 0; only those longer than `room` are cut. A null or empty text is the one
    id 0. Repeated rows and null doc_ids are pieces like any other; an empty table gives no piece.
    A worker remembers the ids of `remembered` words at most. Sequences hold at most `room` ids, without gaps. The driver sees counts for each length and part
    (at most room x PARTS numbers) and makes the plan; pieces are ranked within (length, part) on the
    executors, so that a length which many share is spread over PARTS tasks.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, path, room, remembered).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    pieces = cut(pieces)
    counts = pieces.groupBy("length", "part").count().collect()  # at most room x PARTS rows
    table = np.zeros((room + 1, PARTS), np.int64)
    for r in counts:
        table[r["length"], r["part"]] = r["count"]
    before = table.cumsum(axis=1) - table
    total = table.sum(axis=1)
    rows = best_plan({int(n): int(total[n]) for n in np.flatnonzero(total)}, room)
    shared = spark.sparkContext.broadcast((before, rows))  # bounded by the numbers of lengths and parts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1] if len(rows) else np.zeros(0, np.int64)
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "part", "rank"))
            rank = rank - 1 + before[length, part]
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            _, first, sequence, each, offset = rows[at].T if len(at) else np.zeros((5, 0), np.int64)
            nth, k = (rank - first) // np.maximum(each, 1), (rank - first) % np.maximum(each, 1)
            yield set_out({c: (batch.column(c), batch.schema.field(c).type) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": (sequence + nth, pa.int64()), "offset": (offset + k * length, pa.int64())})

    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
