"""The corpus pipeline: documents that a quality classifier keeps, one of each group of
near-duplicates, mixed to target weights and encoded. Each stage's rows are written as Parquet and
reread as the documents of the next one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readloom.llm.bpe_automaton import encode_decode
from readloom.llm.common import delete, shared_dir, small_batches, table
from readloom.llm.mixing import apply_mix
from readloom.llm.quality_crf import keep_good, train
from readloom.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents below the threshold go. Rows without an id are judged like others; a null or empty text is one empty line;
    repeated rows stay or go together; an empty table stays empty; further columns stay as they are."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the document of the smallest id of each group stays. Texts without words are one group; rows without an id stay;
    of repeated rows of one id one stays; an empty table stays empty; further columns stay as they are."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it. Null is a source of its own; rows of one id, or without one, are taken
    alike; a source without words is taken not at all; an empty table stays empty; further columns stay as they are."""
    return apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token counts and digests of the ids and of the decoded text, a row for each row. Null and empty texts have no
    tokens; repeated rows stay repeated; an empty table gives no rows; further columns don't matter."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [(f.__name__, small_batches(f)) for f in (quality, near_duplicates, mixing, encoding)]
#: Neither the classifier nor the encoding can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, whose folder stays for who reads them; a stage's folder goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    place = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            delete(spark, before)
        before = f"{place}/{name}"
    return docs
