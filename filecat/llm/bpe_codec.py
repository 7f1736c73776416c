"""Encodes and decodes documents with word-level BPE."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from filecat.llm.common import documents, set_out, slices, texts_of
from filecat.llm.word_bpe import BLANK, PART, REMEMBERED, Decoder, WordBPE

#: Bytes of text whose pieces are told apart at once.
LOT = 2 << 20

_ENCODERS: dict[str, TextEncoder] = {}


class TextEncoder:
    """Ids of texts, part by part. What the transducer made of a white-space bounded piece is remembered, of so many pieces at most."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.bpe, self.known, self.met, self.remembered = WordBPE(path), {}, Counter(), remembered

    def parts(self, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, some of its ids as unsigned little-endian 32 bit), in order; no part is of more than a few PART bytes of text."""
        lot, held = [], 0
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                to = len(text)
                if to - at > PART:  # cut behind white space; a piece without any goes through the transducer alone
                    found = BLANK.search(text, at + PART)
                    to = found.end() if found else to
                    if to - at > 2 * PART:
                        yield from self._lot(lot)
                        lot, held = [], 0
                        begin = max(text.rfind(b, at, at + PART) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
                        if begin > at:
                            to = begin
                        else:
                            yield from ((k, ids) for ids in self.bpe.stream(text[at:to].strip()))
                            at = to
                            continue
                lot.append((k, text[at:to]))
                held += to - at
                at = to
                if held > LOT:
                    yield from self._lot(lot)
                    lot, held = [], 0
        yield from self._lot(lot)

    def _lot(self, lot: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        if not lot:
            return []
        if len(self.known) > self.remembered:
            self._forget()
        known = self.known
        # pieces are told apart in Arrow; Python sees each of a lot's once
        pieces = pc.ascii_split_whitespace(pa.array([part for _, part in lot], pa.string()))
        coded = pieces.values.dictionary_encode()
        spelt = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, spelt))
        found = [piece for piece, x in zip(spelt, ids) if x is None]
        self.met.update([piece for piece, x in zip(spelt, ids) if x is not None])
        if found:
            fresh = self.bpe.learn(found)
            # long ones are not remembered
            known.update((piece, x) for piece, x in zip(found, fresh) if len(piece) <= 64)
            rest = iter(fresh)
            ids = [next(rest) if x is None else x for x in ids]
        flat = pa.array(ids, pa.binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1][pieces.offsets.to_numpy()].tolist()
        data = memoryview(flat.buffers()[2] or b"")
        return [(k, bytes(data[at:to])) for (k, _), at, to in zip(lot, ends, ends[1:])]

    def _forget(self) -> None:
        """Keeps the pieces that were met again in most lots, half of the memory at most."""
        often, least, kept = Counter(self.met.values()), 1, 0
        for n in sorted(often, reverse=True):
            kept += often[n]
            if 2 * kept > self.remembered:
                least = n + 1
                break
        self.known = {piece: self.known[piece] for piece, n in self.met.items() if n >= least}
        self.met = Counter({piece: self.met[piece] // 2 for piece in self.known})


def encoder(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    """The worker's encoder of that vocabulary."""
    found = _ENCODERS.get(path) or _ENCODERS.setdefault(path, TextEncoder(path))
    found.remembered = remembered
    return found


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row: the tokenizers library's, without special tokens added.

    A null or blank text has no ids; rows with a null doc_id and repeated rows are kept; an empty table
    gives an empty result; further columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [bytearray() for _ in range(batch.num_rows)]
            for k, part in encoder(path).parts(texts_of(batch)):
                ids[k] += part
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "ids": ([np.frombuffer(x, np.int32) for x in ids], pa.list_(pa.int32()))})

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids (array<int>; null: empty), as the library's decode keeps every token.

    Rows with a null doc_id and repeated rows are kept; an empty table gives an empty result; further
    columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(path).bpe.spelt
        for batch in batches:
            texts = [Decoder(token).feed(ids or ()).decode() for ids in batch.column("ids").to_pylist()]
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "text": (texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every row of docs.

    A null or blank text has no ids and decodes to the empty text; rows with a null doc_id and
    repeated rows are kept; an empty table gives an empty result; further columns are not read.
    Ids go from the transducer to the digest and to the decoder's state machine, and its text to the
    other digest, a part at a time: besides the text itself no more than a part of it is held. One
    pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        spelt = own.bpe.spelt
        number = [b"%d" % i for i in range(len(spelt))]
        for batch in slices(batches):
            counts, coded, decoded = ([make() for _ in range(batch.num_rows)] for make in (int, hashlib.sha256, hashlib.sha256))
            decoders = [Decoder(spelt) for _ in range(batch.num_rows)]
            for k, part in own.parts(texts_of(batch)):
                if ids := memoryview(part).cast("I").tolist():
                    if counts[k]:
                        coded[k].update(b" ")
                    counts[k] += len(ids)
                    coded[k].update(b" ".join(map(number.__getitem__, ids)))
                    decoded[k].update(decoders[k].feed(ids))
            columns = {"ids_sha256": coded, "decoded_sha256": decoded}
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "n_tokens": (counts, pa.int64())} | {c: ([x.hexdigest() for x in v], pa.string()) for c, v in columns.items()})

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
