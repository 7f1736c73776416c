"""Shingle sets, which take more disk than the texts, are made only for pairs whose counts allow the share."""

from pyspark.sql import functions as F

from filecat.llm import similar_texts as st


def test_sets_are_made_only_for_pairs_that_their_counts_allow(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    one, near = " ".join(words), " ".join(words[:390] + [f"v{i}" for i in range(10)])
    other = " ".join(f"u{i}" for i in range(400))
    docs = spark.createDataFrame([(1, one), (2, near), (3, other), (3, other), (4, other + " end")], "doc_key long, text string")
    texts = docs.withColumn("cid", F.md5("text")).repartition(3)
    nodes = texts.groupBy("cid").agg(F.min("doc_key").alias("first_key"))
    cid = {r["text"]: r["cid"] for r in texts.collect()}
    pairs = spark.createDataFrame([tuple(sorted((cid[a], cid[b]))) for a, b in ((one, near), (one, other), (near, other))], "a string, b string")
    asked, made = [], st.sets_of
    monkeypatch.setattr(st, "sets_of", lambda ids, *rest: asked.extend(r["cid"] for r in ids.collect()) or made(ids, *rest))
    found = st.similar(pairs, texts, nodes, 5, 0.8).collect()
    assert [{r["a"], r["b"]} for r in found] == [{cid[one], cid[near]}]
    assert set(asked) == {cid[one], cid[near]}


def test_repeated_rows_give_one_set_and_one_row_of_counts(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (3, "x"), (5, "a b c d e f"), (-1, ""), (-1, "")], "doc_key long, text string")
    texts = docs.withColumn("cid", F.md5("text")).repartition(3)
    nodes = texts.groupBy("cid").agg(F.min("doc_key").alias("first_key"))
    ids = nodes.select("cid")
    counts, sets = st.cells_of(ids, texts, nodes, 5).collect(), st.sets_of(ids, texts, nodes, 5).collect()
    assert sorted(r["size"] for r in counts) == [1, 1, 2] and all(sum(r["cells"]) == r["size"] for r in counts)
    assert sorted(len(r["items"]) for r in sets) == [1, 1, 2]
