"""A training corpus from raw documents, in stages; each one's result is written as Parquet and read again by the next.

Documents that the quality classifier rejects go; of lines that are nearly equal one stays; of each group of near-duplicate
documents one stays; byte strings that repeat are cut; what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyrill.llm import lines, packing, quality, simhash, suffixes
from tallyrill.llm._shared import shared_dir


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least_quality=0.5, most_toxic=0.5)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(docs, k=8, similarity=0.8)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs, width=5, similarity=0.8)


def _suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated(docs, length=100)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


#: Name and function of each stage, in order. A function takes (spark, docs, sf_dir).
STAGES = [("quality classifier", _quality), ("line dedup", _lines), ("simhash near-dedup", _near_duplicates), ("suffix-array dedup", _suffixes), ("best-fit packing", _pack)]

#: SQL can express neither MinHash, SimHash nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
