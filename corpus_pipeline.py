"""A corpus pipeline of five stages over documents; each stage reads what its predecessor wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever others docs has beside doc_id and text. None of them changes
documents that it has nothing against. What they share:

* null and empty texts are texts without words: no stage drops or changes them but as copies
  of each other, and the last packs their end token;
* very long texts are treated whole;
* a null doc_id is no label's, and its document is kept, cleaned and packed by its text;
* rows that repeat a doc_id are documents of their own, until near copies go;
* an empty table gives an empty table; empty labels and an empty benchmark reject nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievecraft.functions.storage import discard, materialize, release, written
from sievecraft.llm import decontamination, jaccard_join, line_dedup, packing, quality

#: Documents with a lower probability of good quality go.
LEAST_SCORE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels of both kinds all of them. Equal texts have equal fates."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have. Documents that lose lines and of which nothing but blanks is left go; texts that were null, empty or blank before stay."""
    return line_dedup.drop_frequent_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; of rows that are equal in id and text, one. Texts without words are copies of equal ones only."""
    return jaccard_join.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those with more than half of their words in such passages go. Items without id, text or words match nothing."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of sequences of 2048 tokens, with their ids; one row at least for each document, by rows where ids repeat."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokenizer; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and what it was made from goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark, before = written(), docs
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(mark, keep=docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
