"""The thin queries of the operators in this subpackage, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readloom.llm import cover_tree, jpeg_dc, lbl_lm, mixing, quality_crf, simhash, training_order, url_cascade
from readloom.llm.bpe_automaton import encode_decode
from readloom.llm.common import table
from readloom.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"), url_cascade.RULES)


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.scored(table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.ordered(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_dc.store_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_automaton, op3_quality_crf, op4_mixing, op5_simhash, op6_url_cascade, op7_cover_tree, op8_log_bilinear, op9_training_order, op10_jpeg_media)}
SQL = {"op4_mixing": mixing.SQL, "op6_url_cascade": url_cascade.SQL, "op7_cover_tree": cover_tree.SQL}
