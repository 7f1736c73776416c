"""Personal data: patterns, and terms that give the protected entities away.

Patterns find e-mail and network addresses, card and telephone numbers. From the whole texts that hold
them the operator then learns what else reveals them: the pointwise mutual information of a term and an
entity, as a share of the entity's own information content, is the entity's disclosure by that term (1:
who sees the term knows the entity). Terms above the threshold, with at least two different texts to show
it, become spans of the kind `term` wherever they stand, in any text, with the entity or without it.

All of it is DataFrame functions: patterns with possessive loops, which neither recurse nor look back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecat.llm.common import cut

#: What each kind looks like, in its order of listing. A match begins where the last one
#: ended or where no character of its first run stands before it, which is where the leftmost match begins.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:[0-9]{2,}+|[0-9][\x20-][0-9]++)(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
#: So many terms, or hashes of texts, are sent to every task at most.
FEW = 1 << 18
KINDS = (*PATTERNS, "term")
#: Running sums are made in blocks of so many spans; a text's disclosing terms are dealt out to so many lists.
BLOCK, BUCKETS = 256, 64
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it, in its lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, first: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each value what `add` makes of all before it, beginning with first.

    An accumulator that grows by a cell for each value would copy all before it; here cells are made within
    blocks of BLOCK values, and one for each block."""

    def within(block: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(block, empty, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda block: F.aggregate(block, first, add))
        return F.flatten(F.zip_with(blocks, within(ends, first), within))

    last = lambda x: F.greatest(F.ceil(F.size(x) / BLOCK).cast("int") - 1, F.lit(0))
    return let(values, lambda x: let(F.transform(F.sequence(F.lit(0), last(x)), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))), joined))


def spans(found: Column, between: Column) -> Column:
    """Start and end in code points (end exclusive), and value, of what was found between the gaps, of which there is one more."""
    pairs = F.zip_with(between, found, lambda gap, v: F.struct(F.char_length(gap).alias("gap"), F.coalesce(v, F.lit("")).alias("value")))

    def placed(own: Column) -> Column:
        begin = running(F.transform(own, lambda p: p["gap"] + F.char_length(p["value"])), F.lit(0), lambda x, y: x + y)
        place = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + F.char_length(p["value"])).alias("end"), p["value"].alias("value"))
        return F.zip_with(own, begin, place)

    return F.slice(let(pairs, placed), F.lit(1), F.size(found)).cast(SPAN)


def matches(text: Column, pattern: str, needed: str | None = None) -> Column:
    """Leftmost matches that do not overlap: start and end in code points (end exclusive), and value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needed:
        found = F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast("array<string>"))
    return let(found, lambda f: F.when(F.size(f) > 0, spans(f, F.split(text, pattern, -1))).otherwise(F.array().cast(SPAN)))


def luhn(digits: Column) -> Column:
    from_right = F.split(F.reverse(digits), "(?<=.)(?=.)")
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, carried: list[str] = ()) -> DataFrame:
    """doc_id, text, carried columns, a key without nulls, and for each kind its spans in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in carried))
    rows = rows.withColumn("k1", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("k2", F.xxhash64("text", F.col("doc_id").isNull()))
    found = rows.select("*", *(matches(F.col("text"), p, NEEDED[k]).alias(k) for k, p in PATTERNS.items()))
    return found.withColumns({k: F.filter(k, (lambda kind: lambda s: holds(kind, s["value"]))(k)) for k in PATTERNS})


def masked(text: Column) -> Column:
    """The text, as long as it was, without letters inside spans: of all kinds only e-mail addresses have any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)), lambda v: F.regexp_replace(v, "[A-Za-z]", "0"))
    whole = F.array_join(F.zip_with(F.split(text, PATTERNS["email"], -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(text, F.lit(NEEDED["email"])), whole).otherwise(text)


def noted(found: DataFrame) -> DataFrame:
    """k1, k2, content, entities, terms of every row: a hash of the text, its distinct entities, and its distinct words that no span covers, between blanks."""
    entities = F.concat(*(F.transform(k, (lambda kind: lambda s: F.concat(F.lit(kind + ":"), F.lower(s["value"])))(k)) for k in PATTERNS))
    terms = F.transform(F.regexp_extract_all(masked(F.col("text")), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))
    return found.select("k1", "k2", F.xxhash64("text").alias("content"), F.array_distinct(entities).alias("entities"), F.array_join(F.array_distinct(terms), " ").alias("terms"))


def shown(rows: DataFrame, keys: list[str], name: str, support: int) -> DataFrame:
    """keys and the number of rows (sum of n) that have them, of those that at least `support` different texts show; rows: keys, n of each text."""
    return rows.groupBy(*keys).agg(F.sum("n").alias(name), F.count("*").alias("n_texts")).where(F.col("n_texts") >= support).drop("n_texts")


#: What tells the sets of texts apart that entities occur in: two hashes of all their members.
CLASS = ["c1", "c2", "n_entity"]


def disclosing(notes: DataFrame, threshold: float, support: int) -> DataFrame:
    """The terms of pairs of an entity and a term whose disclosure passes the threshold; all counts are of whole rows, over all rows.

    Entities that occur in the same texts stand in the same relation to every term, so pairs are counted for
    such classes of entities: a list of addresses that some texts share is one class, however long it is."""
    own = notes.select("content", F.explode("entities").alias("entity")).groupBy("entity", "content").agg(F.count("*").alias("n"))
    member = lambda seed: F.bit_xor(F.xxhash64("content", F.lit(seed)))
    entity = own.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts"), member(1).alias("c1"), member(2).alias("c2")).where(F.col("n_texts") >= support)  # an entity of fewer texts has no pair of enough
    held = cut(own.join(entity, "entity").select("content", *CLASS).distinct())
    texts = held.select("content").distinct()
    texts = F.broadcast(texts) if texts.count() <= FEW else texts  # few have an entity that others have, and only their words are shuffled
    words = notes.where("terms <> '' AND size(entities) > 0").join(texts, "content", "left_semi").groupBy("content").agg(F.first("terms").alias("terms"), F.count("*").alias("n"))
    pairs = words.join(held, "content").select(*CLASS, "n", F.explode(F.split("terms", " ")).alias("term"))
    both = shown(pairs, [*CLASS, "term"], "n_both", support)
    term = notes.where("terms <> ''").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = notes.select(F.count("*").cast("double").alias("n"))
    known = both.join(term, "term").crossJoin(F.broadcast(total))  # total is one row
    information = F.log2(F.col("n") / F.col("n_entity"))
    shared = F.log2(F.col("n") * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    return known.where((information > 0) & (shared >= threshold * information)).select("term")


def told_terms(notes: DataFrame, threshold: float, support: int) -> DataFrame:
    """k1, k2, told: the disclosing terms that a row has, whether or not it has an entity."""
    terms = notes.where("terms <> ''").select("k1", "k2", F.explode(F.split("terms", " ")).alias("term"))
    known = cut(disclosing(notes, threshold, support).distinct())
    few = known.count() <= FEW  # then the words of all texts need no shuffle
    return terms.join(F.broadcast(known) if few else known, "term").groupBy("k1", "k2").agg(F.collect_set("term").alias("told"))


def term_spans(text: Column, told: Column) -> Column:
    """The places of the words in told, in order. Told words are dealt out to BUCKETS lists, of which each word of the text looks in one."""
    free, bucket = masked(text), (lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.filter(told, lambda t: bucket(t) == k))

    def marked(lists: Column) -> Column:
        words = F.regexp_extract_all(free, F.lit(WORD), F.lit(0))
        all_ = F.transform(spans(words, F.split(free, WORD, -1)), lambda s: F.struct(s["start"], s["end"], F.lower(s["value"]).alias("value")))
        return F.filter(all_, lambda s: F.array_contains(F.get(lists, bucket(s["value"])), s["value"]))

    return F.when(told.isNotNull(), let(dealt, marked)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def with_terms(found: DataFrame, threshold: float, support: int) -> DataFrame:
    """found and the spans of disclosing terms."""
    told = told_terms(cut(noted(found)), threshold, support)
    return found.join(told, ["k1", "k2"], "left").withColumn("term", term_spans(F.col("text"), F.col("told"))).drop("told")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of every span, by kind and start, joined by commas."""
    return F.concat_ws(",", *(F.transform(k, (lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))(k)) for k in kinds))


def private_spans(docs: DataFrame, threshold: float = 0.9, support: int = 2) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs.

    A null text counts as empty and has no span. Rows with a null doc_id take part; repeated rows are
    kept, count as documents and have the same spans; an empty table gives an empty result; further
    columns are not read. Of terms with equal disclosure all are marked. Work grows with the texts: two passes
    for the patterns, one sum over all words, one over the words of texts with an entity that other texts have,
    for each class of entities with the same texts; joins on text and term, which Spark splits where one is hot.
    """
    rows = with_terms(base_spans(docs), threshold, support)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return rows.select("doc_id", *counts, F.sha2(listed(tuple(PATTERNS)), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def sanitised(docs: DataFrame, threshold: float = 0.9, support: int = 2, carried: list[str] = ()) -> DataFrame:
    """doc_id, text, carried columns of every row of docs; spans give way to their kind in brackets.

    Where spans overlap, the one that begins first names the whole; a null text becomes the empty one; repeated
    rows and rows without doc_id are kept; an empty table gives an empty result."""
    rows = with_terms(base_spans(docs, carried), threshold, support)
    all_ = F.sort_array(F.concat(*(F.transform(k, (lambda kind: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))(k)) for k in KINDS)))
    # four bytes for each code point, so that a piece is found without counting those before it
    piece = lambda wide, at, end: F.decode(F.substring(wide, 4 * at + 1, 4 * (end - at)), "UTF-32")

    def put(wide: Column) -> Column:
        def built(own: Column) -> Column:
            reached = running(F.transform(own, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
            new = F.filter(F.zip_with(own, reached, lambda s, at: F.struct(s["start"].alias("start"), s["put"].alias("put"), at.alias("at"))), lambda s: s["start"] >= s["at"])
            end = F.array_max(F.transform(own, lambda s: s["end"]))
            pieces = F.transform(new, lambda s: F.concat(piece(wide, s["at"], s["start"]), s["put"]))
            return F.concat(F.array_join(pieces, ""), piece(wide, end, F.char_length("text")))

        return let(all_, built)

    whole = F.when(F.size(all_) > 0, let(F.encode("text", "UTF-32"), put)).otherwise(F.col("text"))
    return rows.select("doc_id", whole.alias("text"), *carried)
