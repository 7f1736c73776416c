"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one token and are one
pre-token form the proven set. A pre-token of that set counts one without merging; only the rest
is merged, each distinct one once while the worker's bounded memory of them lasts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import documents, set_out, slices

#: Fixed value: the byte-level pre-token pattern of the tokenizers library.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: characters whose Unicode class differs between versions; the library itself cuts texts that hold one.
RARE = r"[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c89\u208f\u209d-\u209f\ua7cb\ua7cc\ua7ce\ua7cf\ua7d2\ua7d4\ua7da\ua7dc\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U00010000-\U0001f2ff\U0001fb00-\U0010ffff]"
#: A worker remembers at most so many distinct pieces, then starts afresh.
REMEMBERED = 400_000

_COUNTERS: dict[str, "PieceCounter"] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def proven_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer gives back as exactly one token when they stand alone."""
    import regex

    tok = load(path)
    if '"use_regex":true' not in (said := tok.to_str()) or '"add_prefix_space":true,"trim_offsets":true,"use_regex":true},"post' in said or '"normalizer":null' not in said:
        raise ValueError("this operator needs a byte-level tokenizer without normalizer or added prefix space")
    pattern = regex.compile(PRE_TOKEN)
    texts = [s for i in range(tok.get_vocab_size(with_added_tokens=False)) if "�" not in (s := tok.decode([i], skip_special_tokens=False))]
    alone = tok.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(s for s, e in zip(texts, alone) if len(e.ids) == 1 and pattern.findall(s) == [s])


class PieceCounter:
    """Counts tokens of texts. A text is cut at single spaces, where the pattern always starts anew;
    a text in which a space touches other white space goes through the pattern as a whole."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        self.tok, self.whole = load(path), whole
        self.pattern, self.rare = regex.compile(PRE_TOKEN).findall, regex.compile(RARE).search
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else lambda s: [s]
        self.pieces: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def find(self, text: str) -> list[str]:
        if text.isascii() or not self.rare(text):
            return self.pattern(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _merge(self, tokens: set[str]) -> None:
        rest = list((tokens - self.whole).difference(self.merged))
        if rest:
            self.merged.update((t, len(e.ids)) for t, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)))

    def _count(self, tokens: list[str]) -> int:
        whole, merged = self.whole, self.merged
        return sum(1 if t in whole else merged[t] for t in tokens)

    def _learn(self, pieces: set[str]) -> None:
        """pieces: without the space that stands before them. -1 marks those that need the whole text."""
        odd = {p for p in pieces if not p or p[0].isspace() or p[-1].isspace()}
        found = {p: self.find(" " + p) for p in pieces - odd}
        self._merge({t for ts in found.values() for t in ts})
        self.pieces.update((p, self._count(ts)) for p, ts in found.items())
        self.pieces.update((p, -1) for p in odd)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.pieces) > REMEMBERED or len(self.merged) > REMEMBERED:
            self.pieces, self.merged = {}, {}
        totals, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            own = self.split(text) if any(s in text for s in self.special) else [text]
            totals[i] += len(own) - 1
            parts += [(i, part.split(" ")) for part in own if part]
        unknown: set[str] = set()
        for _, pieces in parts:
            unknown.update(pieces[1:])
        if unknown := unknown.difference(self.pieces):
            self._learn(unknown)
        slow = []
        for i, pieces in parts:
            counts = list(map(self.pieces.__getitem__, pieces[1:]))
            first = pieces[0]
            if (counts and min(counts) < 0) or not first or first[0].isspace() or first[-1].isspace():
                slow.append((i, self.find(" ".join(pieces))))
            else:
                totals[i] += sum(counts)
                slow.append((i, self.find(first)))
        self._merge({t for _, ts in slow for t in ts})
        for i, ts in slow:
            totals[i] += self._count(ts)
        return totals


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    The count is that of the tokenizers library for the byte-level file at path, without begin, end
    or padding; a special string inside a text counts as its one token. A null text counts as empty
    (0 bytes, 0 tokens); rows with a null doc_id and repeated rows are kept as they are; an empty
    table gives an empty result; further columns of docs are not read. Work is one pass over the
    texts without a shuffle; what a worker remembers is bounded by REMEMBERED.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(proven_whole(path))  # at most one string for each vocabulary entry

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, PieceCounter(path, whole.value))
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield set_out({"doc_id": (batch.column("doc_id"), pa.int64()), "n_bytes": (batch.column("n_bytes"), pa.int64()), "n_tokens": (counter.count(texts), pa.int64())})

    rows = documents(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
