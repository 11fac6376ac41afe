"""Registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm import language_id, packing, token_files, warc
from adtally.llm.hard_negatives import hard_negatives
from adtally.llm.jaccard_join import similar_sets
from adtally.llm.oracles import oracle_sql
from adtally.llm.phrases import collocations
from adtally.llm.quality_rules import quality_rules
from adtally.llm.sharding import sharded
from adtally.llm.shared import new_folder
from adtally.llm.simhash_dedup import near_duplicates
from adtally.llm.source_mixing import mixed
from adtally.llm.substring_dedup import substring_dedup
from adtally.llm.topk_search import top_k

__all__ = ["held_out", "oracle_sql", "queries", "table"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = substring_dedup(table(spark, root, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _packing(spark: SparkSession, root: str) -> DataFrame:
    found = packing.pack(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _token_files(spark: SparkSession, root: str) -> DataFrame:
    docs, folder = table(spark, root, "documents"), new_folder(spark, "token-files")
    token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.crc32(token_files.read(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


def _source_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixed(table(spark, root, "documents"), row=F.col("doc_id")).select("doc_id", "size", "source_size", "target", "taken")


def _warc(spark: SparkSession, root: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(table(spark, root, "pages"), folder)
    return warc.captures(spark, folder)


def _simhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))


def _quality_rules(spark: SparkSession, root: str) -> DataFrame:
    found = quality_rules(table(spark, root, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _topk_search(spark: SparkSession, root: str) -> DataFrame:
    return top_k(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = language_id.fit(language_id.sample(docs.where(~held_out(F.col("doc_id")))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _sharding(spark: SparkSession, root: str) -> DataFrame:
    return sharded(table(spark, root, "documents"))


def _hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, root, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def _jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return similar_sets(table(spark, root, "documents"))


def _phrase_mining(spark: SparkSession, root: str) -> DataFrame:
    return collocations(table(spark, root, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": _substring_dedup,
        "op2_best_fit_packing": _packing,
        "op3_token_files": _token_files,
        "op4_source_mixing": _source_mixing,
        "op5_warc": _warc,
        "op6_simhash_dedup": _simhash_dedup,
        "op7_quality_rules": _quality_rules,
        "op8_topk_search": _topk_search,
        "op9_language_id": _language_id,
        "op10_sharding": _sharding,
        "op11_hard_negatives": _hard_negatives,
        "op12_jaccard_join": _jaccard_join,
        "op13_phrase_mining": _phrase_mining,
    }
