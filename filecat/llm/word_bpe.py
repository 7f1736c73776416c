"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by a state machine.

The merge list alone decides how far to the right of a token the text can still change its end. That
reach is computed once for every token. Words are read through windows: a window's letters are merged,
and all tokens up to the last end that has its token's reach of known letters behind it are stable; they
are emitted and forgotten, and the window moves on. A window in which nothing is stable grows, at most
to twice the whole list's lookahead. So a word of any length is encoded in constant memory. A worker
remembers the transducer's results for a bounded number of words and windows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from filecat.llm.token_count import RARE, load

#: Stands for the rank of a pair that never merges.
NO_RANK = 1 << 30
#: A worker remembers at most so many distinct words, or windows of longer ones, then starts afresh.
REMEMBERED = 200_000
#: Letters of a word's first window.
WINDOW = 32
#: Bytes of text that are held as words at once.
PART = 1 << 20
#: Where text without white space may be cut: inside a run of ASCII letters, behind enough of them that no special string ends there.
INNER = re.compile(rb"[A-Za-z]{17}(?=[A-Za-z])")
BLANK = re.compile(rb"[ \t-\r]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def lowered(s: str) -> str:
    """Each character in lower case by itself; only a capital sigma would look at its neighbours."""
    return "".join(map(str.lower, s)) if "\u03a3" in s else s.lower()


def sufficient_lookahead(merges: list[tuple[int, int, int]], width: list[int]) -> np.ndarray:
    """For each id: bytes behind a token's end that decide whether a merge crosses that end.

    merges: (left, right, result) in order of priority; width: bytes of each id. A merge (a, b) is
    undone from the right only by an earlier merge that takes b, or a right part of b, as its left
    side; that one by a still earlier merge, and so on: the widest such chain is the reach of a. A
    token's end may be crossed by a merge that takes the token or a right part of it.
    """
    right_parts: dict[int, set[int]] = {}
    taken: dict[int, int] = {}

    def widest(edge: int) -> int:
        return max([taken.get(edge, 0), *map(widest, right_parts.get(edge, ()))])

    for a, b, c in merges:
        taken[a] = max(taken.get(a, 0), widest(b) + width[b])
        right_parts.setdefault(c, set()).add(b)
    return np.array([widest(t) for t in range(len(width))])


class Ranks:
    """Looks up the rank of many pairs at once; what collides in one table is in the next."""

    def __init__(self, pairs: np.ndarray):
        self.levels, rest, rank = [], pairs, np.arange(len(pairs))
        for k in range(12):
            wide = max(10, (4 * len(rest)).bit_length())  # the few that are left need a small table
            keys, values, odd = np.full(1 << wide, -1), np.full(1 << wide, NO_RANK, np.int32), 0x9E3779B97F4A7C15 + 2 * k
            slot = self.slot(rest, odd, wide)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], values[slot[first]] = rest[first], rank[first]
            self.levels.append((odd, wide, keys, values))
            left = np.ones(len(rest), bool)
            left[first] = False
            rest, rank = rest[left], rank[left]
            if not len(rest):
                break

    @staticmethod
    def slot(pairs: np.ndarray, odd: int, wide: int) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(odd) >> np.uint64(64 - wide)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 20 | right  # negative if one of them is, and so in no table
        out = np.full(pair.shape, NO_RANK, np.int32)
        for odd, wide, keys, values in self.levels:
            slot = self.slot(pair, odd, wide)
            np.copyto(out, values[slot], where=keys[slot] == pair)
        return out


class WordBPE:
    """The tokenizer of a word-level BPE file: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError("this operator needs a lower-casing BPE tokenizer with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.path, self.library, self.rare = path, None, regex.compile(RARE).search
        marks = sorted(self.special, key=len, reverse=True)
        self.marked = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")")
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = s
        self.spelt = [t.encode() for t in self.token]
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        self.width = [len(s.removesuffix(end)) for s in self.token]
        order = [(vocab[a], vocab[b], vocab[a + b]) for a, b in map(tuple, model["merges"])]
        self.ranks = {a << 20 | b: (k, c) for k, (a, b, c) in reversed(list(enumerate(order)))}
        self.widths, self.reach = np.array(self.width), sufficient_lookahead(order, self.width)
        self.most = 2 * int(self.reach.max()) + max(self.width)  # in so many letters some end is stable
        self.inner_of, self.last_of = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.results = np.array([c for _, _, c in order], np.int32)
        self.table = Ranks(np.array([a << 20 | b for a, b, _ in order]))
        self.marks = {i: i for i in self.special.values()}
        self.marked_ids: dict[str | int, bytes] = {x: i.to_bytes(4, "little") for x, i in self.marks.items()}
        self.words, self.windows = dict(self.marked_ids), {}

    def _merged(self, windows: list[bytes], ended: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many windows of about one size, and how many each has: in every round each row merges its first pair of least rank."""
        size = np.array([len(w) for w in windows])
        n, wide = len(windows), int(size.max())
        raw = np.frombuffer(b"".join(windows), np.uint8)
        ids = np.full((n, wide + 1), -1, np.int32)
        ids[np.arange(wide + 1) < size[:, None]] = self.inner_of[raw]
        end = np.flatnonzero(ended)
        ids[end, size[end] - 1] = self.last_of[raw[np.cumsum(size)[end] - 1]]
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        row, done, done_size = np.arange(n), np.zeros((n, wide + 1), np.uint32), np.zeros(n, np.int64)
        span = np.arange(wide + 1)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            if (end := best == NO_RANK).any():
                done[row[end]], done_size[row[end]] = np.maximum(ids[end], 0), size[end]
                row, ids, rank, size, at, best = (x[~end] for x in (row, ids, rank, size, at, best))
                if not len(row):
                    break
            here = np.arange(len(row))
            ids[here, at] = self.results[best]
            shift = np.minimum(span + (span > at[:, None]), wide)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], wide - 1), 1)
            rank[here, at] = self.table.ranks(ids[here, at], ids[here, np.minimum(at + 1, wide)])
            before = np.maximum(at - 1, 0)
            rank[here, before] = self.table.ranks(ids[here, before], ids[here, before + 1])
            size = size - 1
        return done, done_size

    def _one(self, window: bytes, ended: bool) -> tuple[bytes, int]:
        """What emitted() gives of one window; it is remembered, since long words say the same again and again."""
        if (found := self.windows.get((window, ended))) is not None:
            return found
        get, ids = self.ranks.get, [self.inner[b] for b in window]
        if ended:
            ids[-1] = self.last[window[-1]]
        while found := [x for x in map(get, map(lambda a, b: a << 20 | b, ids, ids[1:])) if x]:
            (best, new), out, i = min(found), [], 0
            while i < len(ids):
                both = i + 1 < len(ids) and (x := get(ids[i] << 20 | ids[i + 1])) and x[0] == best
                out.append(new if both else ids[i])
                i += 2 if both else 1
            ids = out
        ends = np.cumsum(self.widths[ids])
        stable = np.flatnonzero(ends + (0 if ended else self.reach[ids]) <= len(window))
        n = int(stable[-1]) + 1 if len(stable) else 0
        if len(self.windows) > REMEMBERED:
            self.windows.clear()
        found = self.windows[window, ended] = (np.array(ids[:n], np.uint32).tobytes(), int(ends[n - 1]) if n else 0)
        return found

    def emitted(self, windows: list[bytes], ended: list[bool]) -> list[tuple[bytes, int]]:
        """For each window its stable ids (unsigned little-endian 32 bit) and how many letters they are; of a word's last window all."""
        if len(windows) < 16:
            return list(map(self._one, windows, ended))
        sizes = [len(w) for w in windows]
        out: list = [None] * len(windows)
        low = 0
        while low < max(sizes, default=0):
            high = max(8, 2 * low)
            if at := [i for i, n in enumerate(sizes) if low < n <= high]:
                last = np.array([ended[i] for i in at])
                ids, size = self._merged([windows[i] for i in at], last)
                here = np.arange(ids.shape[1]) < size[:, None]
                ends = np.where(here, self.widths[ids], 0).cumsum(axis=1)
                # everything up to the last stable end; at a word's end all is stable
                stable = here & (last[:, None] | (ends + self.reach[ids] <= ends[:, -1:]))
                count = np.where(stable.any(axis=1), ids.shape[1] - stable[:, ::-1].argmax(axis=1), 0)
                used = np.where(count > 0, ends[np.arange(len(at)), count - 1], 0)
                flat, bounds = ids[np.arange(ids.shape[1]) < count[:, None]].tobytes(), (4 * np.cumsum(count)).tolist()
                for i, x, to, n in zip(at, [0, *bounds], bounds, used.tolist()):
                    out[i] = (flat[x:to], n)
            low = high
        return out

    def transduce(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (unsigned little-endian 32 bit): words of one window, of which all is stable, by size; windows of the others."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out, low = [b""] * len(words), 0
        for high in (*range(4, WINDOW, 4), WINDOW):
            at = np.flatnonzero((sizes > low) & (sizes <= high)).tolist()
            if len(at) < 16:
                for k in at:
                    out[k] = self._one(words[k], True)[0]
            else:
                ids, size = self._merged([words[k] for k in at], np.ones(len(at), bool))
                flat, bounds = ids[np.arange(ids.shape[1]) < size[:, None]].tobytes(), (4 * np.cumsum(size)).tolist()
                for k, x, to in zip(at, [0, *bounds], bounds):
                    out[k] = flat[x:to]
            low = high
        if at := np.flatnonzero(sizes > WINDOW).tolist():
            for k, ids in zip(at, self._windowed([words[k] for k in at])):
                out[k] = ids
        return out

    def _windowed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: a window of each at once, until all have ended."""
        out, todo = [[] for _ in words], [(k, 0, WINDOW) for k in range(len(words))]
        while todo:
            ended, rest = [at + wide >= len(words[k]) for k, at, wide in todo], []
            for (k, at, wide), end, (ids, used) in zip(todo, ended, self.emitted([words[k][at : at + wide] for k, at, wide in todo], ended)):
                out[k].append(ids)
                if not end:
                    rest.append((k, at + used, WINDOW if used else min(2 * wide, self.most)))
            todo = rest
        return [b"".join(parts) for parts in out]

    def cut(self, s: str) -> list[str]:
        """Normalised words of s, in which no special string is."""
        if s.isascii():
            return self.find(s.lower())
        if not self.rare(s):
            return self.find(lowered(unicodedata.normalize("NFC", s)))
        self.library = self.library or load(self.path)
        byte = {c: b for b, c in enumerate(byte_letters())}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(s))
        return [bytes(byte[c] for c in w).decode() for w, _ in cut]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that white space bounds, each as unsigned 32 bit; special strings count as their token."""
        text = b" ".join(pieces).decode()
        if "<|" in text or (not text.isascii() and self.rare(text)):
            cut = [self._marked(p.decode()) for p in pieces]
        else:
            text = text.lower() if text.isascii() else lowered(unicodedata.normalize("NFC", text))
            cut = [s if s.isalpha() else self.find(s) for s in text.split(" ")]
        if len(self.words) > REMEMBERED:
            self.words = dict(self.marked_ids)
        fresh: set[str | int] = {ws for ws in cut if type(ws) is str}
        fresh.update(chain.from_iterable([ws for ws in cut if type(ws) is not str]))
        fresh = list(fresh.difference(self.words))
        known = self.words
        if fresh:
            known |= zip(fresh, self.transduce([w.encode() for w in fresh]))
        out = [known[ws] if type(ws) is str else b"".join([known[w] for w in ws]) for ws in cut]
        for w in fresh:
            if len(w) > 64:  # long words are used, not remembered
                del known[w]
        return out

    def _marked(self, s: str) -> list[str | int]:
        return [y for x in self.marked.split(s) for y in ([self.special[x]] if x in self.special else self.cut(x))]

    def stream(self, piece: bytes) -> Iterator[bytes]:
        """Ids, part by part, of one piece of any length without white space; a word may go on through many parts."""
        at, word = 0, None
        while at < len(piece):
            found = INNER.search(piece, at + PART) if len(piece) - at > 2 * PART else None
            to = found.end() if found else len(piece)
            words = self._marked(piece[at:to].decode())
            if word and words:
                yield from word.feed(words.pop(0).encode())
                if words or not found:
                    yield from word.close()
                    word = None
            if found and words:
                word = OpenWord(self)
                last = words.pop().encode()
                yield from self._each(words)
                yield from word.feed(last)
            else:
                yield from self._each(words)
            at = to

    def _each(self, words: list[str | int]) -> Iterator[bytes]:
        for at in range(0, len(words), 1 << 14):
            some = [w for w in dict.fromkeys(words[at : at + (1 << 14)]) if w not in self.marks]
            known = self.marked_ids | dict(zip(some, self.transduce([w.encode() for w in some])))
            yield b"".join([known[w] for w in words[at : at + (1 << 14)]])


class OpenWord:
    """A word whose letters come in parts; at most a few windows of them are held, besides what is fed at once."""

    def __init__(self, bpe: WordBPE, letters: bytes = b""):
        self.bpe, self.held, self.wide = bpe, bytearray(letters), WINDOW

    def feed(self, letters: bytes) -> Iterator[bytes]:
        self.held += letters
        return self._moved(False)

    def close(self) -> Iterator[bytes]:
        return self._moved(True)

    def _moved(self, last: bool) -> Iterator[bytes]:
        at, bpe, held = 0, self.bpe, self.held
        while at < len(held) and (last or len(held) - at > self.wide):
            window, ended = bytes(held[at : at + self.wide]), last and at + self.wide >= len(held)
            ids, used = bpe._one(window, ended)
            if used:
                yield ids
                at += used
                self.wide = WINDOW
            else:
                self.wide = min(2 * self.wide, bpe.most)
        del held[:at]


class Decoder:
    """State machine from ids to UTF-8 text, fed with any number of ids at a time: the first token stands
    alone, each later one after a space, as the library joins tokens where the file names no decoder."""

    def __init__(self, token: list[bytes]):
        self.token, self.begun = token, False

    def feed(self, ids: Iterable[int]) -> bytes:
        text = b" ".join(map(self.token.__getitem__, ids))
        if text and self.begun:
            text = b" " + text
        self.begun = self.begun or bool(text)
        return text


class ByteDecoder:
    """State machine from byte-level tokens to readable text: bytes of a character may lie in several tokens."""

    def __init__(self, token: list[str], end: str = "</w>"):
        import codecs

        byte = {c: b for b, c in enumerate(byte_letters())}
        self.raw = [bytes(byte[c] for c in t.removesuffix(end) if c in byte) + b" " * t.endswith(end) for t in token]
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(self.raw[i] for i in ids), final)
