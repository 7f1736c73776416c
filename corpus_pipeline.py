"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a
DataFrame; all but the last return the columns of `documents`. No stage looks at part of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecat.llm.common import cut, ship, table
from filecat.llm.packing import pack
from filecat.llm.private_data import sanitised
from filecat.llm.quality_model import quality_scores
from filecat.llm.similar_texts import one_of_each
from filecat.llm.substring_dedup import remove_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _like_documents(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go. Null and empty texts are scored as empty; repeated rows and rows without doc_id are judged like others; without labels of both kinds all stay."""
    ship(spark)
    scored = quality_scores(docs.select(COLUMNS), table(spark, sf_dir, "labels"), sample=4000, carried=["text", "lang", "source", "n_chars"])
    return scored.where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of five-word shingles in common) stays: the one with the smallest doc_id, or one without doc_id where none has any. Rows of one doc_id but unlike texts all stay."""
    ship(spark)
    return one_of_each(docs.select(COLUMNS), shingle=5, share=0.8).select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere are taken out; a document that loses all its words stays, empty. A null text becomes the empty one; repeated rows are each other's copies; rows without doc_id take part."""
    ship(spark)
    return _like_documents(remove_duplicates(docs.select(COLUMNS), carried=["lang", "source"]), "kept_text")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced by their kind. A null text becomes the empty one; repeated rows and rows without doc_id are kept."""
    ship(spark)
    return _like_documents(sanitised(docs.select(COLUMNS), carried=["lang", "source"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in as few sequences of 2048 tokens as the plan finds. A null or empty text is its closing id alone; repeated rows and rows without doc_id are packed like others."""
    ship(spark)
    return pack(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"), room=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("private", private), ("packing", packing)]
#: A trained model, a similarity graph and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
