"""The registered queries of the text operators: each applies its operator, with the parameters it is meant for, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filecat.llm.bpe_codec import bpe_round_trip
from filecat.llm.common import ship, table
from filecat.llm.line_dedup import dedupe_lines
from filecat.llm.manifest import manifest, without_line_ends
from filecat.llm.oracles import ORACLES
from filecat.llm.packing import pack
from filecat.llm.private_data import private_spans
from filecat.llm.quality_model import quality_scores
from filecat.llm.quality_rules import repetition_rules
from filecat.llm.sharding import shards
from filecat.llm.simhash import near_duplicates
from filecat.llm.substring_dedup import remove_duplicates
from filecat.llm.token_count import token_counts
from filecat.llm.turn_repair import damaged, repair
from filecat.llm.vector_search import nearest


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42, radius=2)


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, sample=4096, depth=200)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), count=16)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), room=2048, remembered=400_000)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=4000)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"), threshold=0.9, support=2)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(table(spark, sf_dir, "documents"), least=20, documents=3).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), fanout=3, height=6, tampered=without_line_ends())


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
