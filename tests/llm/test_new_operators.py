"""Turn repair, line deduplication and the manifest against plain versions, odd rows and long inputs."""

import hashlib
import itertools
import random
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filecat.llm import line_dedup, turn_repair
from filecat.llm.line_dedup import Filters, dedupe_lines, has, merged, places
from filecat.llm.manifest import manifest, without_line_ends
from filecat.llm.ranks import numbered
from filecat.llm.turn_repair import audits, best_audit, coded, damaged, parts_of, repair, repaired_turns, turns_of

H = lambda x: hashlib.sha256(x.encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from filecat.llm.common import ship

    ship(spark)


# --- turns


def plain_repair(turns):
    """turns: (role, text) in order. Cost, audit and repaired turns by dynamic programming over (turn, phase)."""
    seen, fault = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault.append(2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    n = len(turns)
    best = {(n, 0): (0, ""), (n, 3): (0, ""), (n, 2): (2, "I"), (n, 1): (4, "II")}
    for i in range(n - 1, -1, -1):
        role, free = turns[i][0][:1], {}
        for p in range(4):
            ways = [(best[i + 1, p][0] + 3, "D" + best[i + 1, p][1])]
            for (a, letter), to in step.items():
                if a == p and fault[i] < 2 and (letter == role or letter != "s"):
                    c, x = best[i + 1, to]
                    ways.append((c + fault[i] + 2 * (letter != role), ("K" if letter == role else "R") + x))
            free[p] = min(ways)
        then = {0: (2, 3), 1: (2, 3), 2: (3, 2), 3: (2, 3)}
        for p in range(4):
            ways = [free[p], *((free[q][0] + 2 * (k + 1), "I" * (k + 1) + free[q][1]) for k, q in enumerate(then[p]))]
            best[i, p] = min(ways)
    cost, audit = best[0, 0]
    out, i, p = [], 0, 0
    for e in audit:
        role = "assistant" if p == 2 else "user"
        if e == "I":
            out.append((role, ""))
        else:
            if e != "D":
                out.append((turns[i][0] if e == "K" else role, turns[i][1]))
            i += 1
        if e != "D":
            p = step[p, out[-1][0][:1]]
    return fault, cost, audit, out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_summary(rows):
    same = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).hexdigest()
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((conv, turn, *(" " if x is None else x for x in (role, text))))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, same(r)))
        fault, cost, audit, fixed = plain_repair([(r[2], r[3]) for r in own])
        known = {r[1] for r in own if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, fault.count(2), fault.count(3), fault.count(1), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, H("\n".join(f"{r}:{t}" for r, t in fixed)), fixed)
    return out


def test_every_short_conversation():
    """All sequences of up to four turns of every role and fault, and random ones of up to nine, against the plain version."""
    rng = random.Random(3)
    some = [tuple(rng.choice("0124567d") for _ in range(rng.randint(5, 9))) for _ in range(1500)]
    texts = {0: "Yes.", 1: "yes", 2: " ", 3: "x."}
    for codes in itertools.chain.from_iterable([itertools.product("0123456789ac", repeat=n) for n in range(1, 4)] + [some]):
        turns, wanted = [], []
        for k, c in enumerate(codes):
            role, fault = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}["suao"[int(c, 16) & 3]], int(c, 16) >> 2
            turns.append((role, "" if fault >= 2 else f"{k} {texts[fault]}"))
            wanted.append(c if fault < 2 else format((int(c, 16) & 3) + 8, "x"))
        _, cost, audit, _ = plain_repair(turns)
        got = best_audit("".join(wanted), 0, turn_repair.ENDS, True)[0]
        assert got == audit, (codes, got, audit, cost)


ODD_TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 7, "user", "so"), (2, None, None, None), (2, 1, "tool", "A!"), (2, None, "assistant", "ok \n"),
    (None, 1, "user", "Who?"), (None, 3, "assistant", "Me."), (None, None, "user", "Who?"), (3, 5, "system", "x."), (4, 1, "user", ""), (5, 1, "assistant", "é."), (5, 1, "user", "é?"), (5, 1, "system", "long " * 90_000 + "."),
]


def as_rows(found):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found.collect()}


def test_turns(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = ODD_TURNS + [(100 + i // 9, i % 9, ("system", "user", "assistant")[(i * 7 // 3) % 3], f"Text {i % 11}{'.!?x '[i % 5]}") for i in range(400)]
    df = spark.createDataFrame(rows, kind).repartition(5)
    want = plain_summary(rows)
    assert as_rows(repair(df)) == {k: v[:-1] for k, v in want.items()}
    hurt = plain_summary(plain_damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", H(""))
    clashing = df.withColumns({"audit": F.lit("x"), "at": F.lit(1), "same": F.lit("y"), "part": F.lit(2)})
    assert as_rows(repair(damaged(clashing), clashing)) == {c: hurt[c][:-1] if c in hurt else none for c in {r[0] for r in rows}}
    turns = turns_of(df)
    fixed = defaultdict(list)
    for r in repaired_turns(turns, audits(parts_of(coded(turns)))).orderBy("place").collect():
        fixed[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(fixed) == {k: v[-1] for k, v in want.items() if v[-1]}
    empty = spark.createDataFrame([], kind)
    assert repair(damaged(empty), empty).count() == 0


def test_a_conversation_of_many_parts(spark, monkeypatch):
    """Parts of four turns: the same audits as without parts; and 20,000 turns, most of them alike, in one conversation."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choice(["A.", "b", "", f"{t}.", f"{t}"])) for c in range(12) for t in range(rng.randint(1, 40))]
    want = {k: v[:-1] for k, v in plain_summary(rows).items()}
    kind = "conv_id long, turn long, role string, text string"
    with monkeypatch.context() as m:
        m.setattr(turn_repair, "PART", 4)
        assert as_rows(repair(spark.createDataFrame(rows, kind))) == want
    long = [(7, t, "user" if t % 3 else "assistant", "Again." if t % 2 else f"Turn {t}.") for t in range(20_000)]
    assert as_rows(repair(spark.createDataFrame(long, kind))) == {k: v[:-1] for k, v in plain_summary(long).items()}


# --- lines


def plain_lines(rows, least=20, documents=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    rank = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < documents or max(holders[key(x)], key=rank) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), H("\n".join(kept))))
    return sorted(out, key=str)


LINE, SHORT = "  Licensed under the Terms of Ünits\t", "nineteen characters"
ODD_LINES = [
    (1, f"{LINE}\nown\n{LINE.upper()}"), (2, LINE.lower() + "\r\n" + SHORT), (3, f"a\n{LINE}\n\n"), (3, f"a\n{LINE}\n\n"), (4, None), (5, ""), (6, SHORT), (7, SHORT), (8, SHORT), (None, f"{LINE}\nx"), (None, "Only among documents without id"), (None, "only among documents without id "), (9, "twice in two documents only, so it stays\n" * 3), (10, "twice in two documents only, so it stays"), (11, ("é" * 20 + "\n") * 2), (12, "É" * 20 + "\n" + "é" * 20), (13, "é" * 20 + " "),
]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_lines(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(1)
    rows = ODD_LINES + [(100 + i, "\n".join(rng.choice([f"common line number {rng.randint(0, 40)} of many", f"a line of its own {i} {rng.random()}", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(500, "\n".join(f"line {i} of a very long text, all unlike" for i in range(120_000)) + "\n" + LINE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"line": F.lit("x"), "lost": F.lit(1), "n": F.lit(2), "k1": F.lit(1)})
    got = [tuple(r) for r in dedupe_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == plain_lines(rows)
    assert dedupe_lines(df.limit(0)).count() == 0


def test_filters_miss_no_repeat():
    """However tasks share the lines out, the merged second filter has every line that was seen twice, and few others."""
    rng = random.Random(2)
    lines = [f"line {rng.randint(0, 6000)}".encode() for _ in range(6000)]
    whole, bits = None, 1 << 16
    for part in range(5):
        own = Filters(bits)
        for batch in range(3):
            own.see(lines[part * 3 + batch :: 15])
        whole = (own.once, own.twice) if whole is None else merged(whole, (own.once, own.twice))
    count = defaultdict(int)
    for x in lines:
        count[x] += 1
    twice = [x for x in count if count[x] > 1]
    assert has(whole[1], places(twice, bits)).all()
    once = [x for x in count if count[x] == 1]
    assert has(whole[1], places(once, bits)).mean() < 0.25


# --- manifest


def plain_manifest(rows, fanout=3):
    """rows: (doc_id, source, lang, n_chars, text), each with doc_ids that differ within a source."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(map(field, r)))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = []
            for levels, at in ((trees[s], i), (top, k)):
                for nodes in levels[:-1]:
                    run = at - at % fanout
                    path.append((nodes[run:at], nodes[at + 1 : run + fanout]))
                    at //= fanout
            odd = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 or r[4] is None
            now = leaf(r if odd else (*r[:4], r[4].replace("\n", "")))
            for before, after in path:
                now = H("".join([*before, now, *after]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join(x for a, b in path for x in a + b)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height, sizes", [(1, [1, 2, 3, 4, 9, 10, 28, 29, 82, 100, 244]), (2, [1, 5, 9, 10, 81, 82, 83, 91, 250]), (0, [1, 2, 7, 30]), (6, [1, 40])])
def test_manifest(spark, height, sizes):
    """Trees of many sizes: alone at the end of a level, short last subtrees, several rounds; one source without a name."""
    rows = [(1000 * k + i, None if k == 1 else f"s{k}é", None if i % 5 == 0 else "en", None if i % 7 == 0 else i, None if i % 11 == 0 else "" if i % 13 == 0 else f"text {i}\nof {k}") for k, n in enumerate(sizes) for i in range(n)]
    rows += [(None, "s0é", "en", 1, "a\nb"), (None, "s0é", "en", 2, "c"), (None, None, None, None, None), (None, None, None, None, None), (7, "s0é", "x", 1, "again"), (8, "b", None, 3, "long\n" * 300_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"at": F.lit(1), "n": F.lit("x"), "place": F.lit(2), "leaf": F.lit("y"), "root": F.lit(0)})
    got = sorted((tuple(r) for r in manifest(df, height=height, tampered=without_line_ends()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == plain_manifest(rows)
    assert manifest(df.limit(0), height=height).count() == 0


def test_places_of_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 500 + [(None, None)] * 300 + [("b", i) for i in range(50)], "g string, v long").repartition(6)
    found = defaultdict(list)
    for r in numbered(rows, ["g"], ["v"], "at").collect():
        found[r["g"]].append((r["at"], r["v"]))
    assert {g: sorted(a for a, _ in own) == list(range(len(own))) for g, own in found.items()} == {"a": True, "b": True, None: True}
    assert sorted(found["b"]) == [(i, i) for i in range(50)]
