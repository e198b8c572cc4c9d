"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its rows are written as Parquet and
read again as the next one's docs. All but the last return the columns of documents:
toxicity drops documents that are more likely toxic than not; simhash keeps one document of each group of near duplicates;
suffix_array cuts bytes of strings that repeat out of the texts; mixing takes documents, some twice, in target proportions;
sentencepiece returns doc_id, ids and n_tokens.
Nulls, empty texts, repeated rows, empty tables and extra columns are treated as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import mixing, sentencepiece_codec, simhash, suffix_array, toxicity
from lamella.tables import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sentencepiece_codec.encode(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.col("sp_ids").alias("ids"), F.size("sp_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the stages (trained model, components of links, encoding).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
