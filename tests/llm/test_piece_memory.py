"""What the encoder of op5 and op10 remembers, and what it gives of odd texts."""

import random

import public_tokenizers
import pyarrow as pa

from filecat.llm.bpe_codec import LOT, TextEncoder
from filecat.llm.common import texts_of
from filecat.llm.token_count import load

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(own: TextEncoder, texts: list[bytes]) -> list[bytes]:
    out = [b""] * len(texts)
    for k, part in own.parts(texts):
        out[k] += part
    return out


def test_pieces_that_come_every_other_time_outlive_a_full_memory():
    own, asked = TextEncoder(PATH, remembered=3000), []
    learn = own.bpe.learn
    own.bpe.learn = lambda pieces: asked.extend(pieces) or learn(pieces)
    common = [b"kept%d" % i for i in range(500)]
    for turn in range(40):
        rare = [b"once%dx%d" % (turn, i) for i in range(500)]
        list(own.parts([b" ".join(rare + common if turn % 2 == 0 else rare)]))
        assert len(own.known) <= 3000 + 1000
    assert len([p for p in asked if p.startswith(b"kept")]) == 500  # each was learnt once, though memory was full many times


def test_ids_of_odd_texts_are_the_librarys():
    rng, library = random.Random(5), load(PATH)
    parts = ["word", "Word,", "ΣΑΣ", "ὈΔΥΣΣΕΎΣ", "İstanbul", "ﬁ", "é", "a\x1cb", "\x85", " ", " ", "<|endoftext|>", "x<|startoftext|>y", "it's", "12,5", "***", "ǅ", "word" * 20, "ß", "한국어", "\U0001f600"]
    glue = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", ""]
    texts = ["", " ", "\n\n", "\x0b word", "word \t"]
    texts += ["".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    got = ids_of(TextEncoder(PATH, remembered=50), texts_of(pa.record_batch({"text": [*texts, None]})))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in got] == want


def test_texts_about_a_lot_in_size():
    own = TextEncoder(PATH)
    for size in (LOT - 1, LOT, LOT + 1, 3 * LOT):
        text = (b"some words, and more " * (size // 20 + 1))[:size]
        first, empty, last = ids_of(own, [text, b"", b"end"])
        assert empty == b"" and last == ids_of(TextEncoder(PATH), [b"end"])[0]
        alone = {part: ids_of(own, [part])[0] for part in set(text.split())}
        assert first == b"".join(alone[part] for part in text.split())
