"""A corpus pipeline of five stages over ``documents``: each reads what the one before has written.

Fits and statistics of a stage (toxicity labels apart) are over that stage's own input. Every stage but the last
returns the columns of documents; nulls and empty texts go through all of them as their operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigrel.llm import decontaminate, line_dedup, toxicity
from sigrel.llm.common import Tables, held_out, n_words, prepare, sieve, sifted, table
from sigrel.llm.jaccard_join import jaccard_groups
from sigrel.llm.mixing import mix_sources


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out("doc_id"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred in an earlier document go; so does a document of which no word is left by that."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs)
    return out.where((F.col("removed_words") == 0) | (n_words(F.col("text")) > 0)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, the one with the smallest doc_id stays.

    Rows that repeat both doc_id and text stay once (any of them, if other columns differ); different texts under one
    doc_id are judged apart. Documents without words are in no group and stay, as do those without a doc_id.
    """
    groups = jaccard_groups(docs, n=5, percent=80).where("doc_id is not null")
    stays = F.bool_or((F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0))
    # what goes or is there twice; all other rows are let through without a shuffle of their texts
    odd = Tables(spark).put(groups.groupBy("doc_id", "text_key").agg(stays.alias("stays"), F.count("*").alias("times")).where("not stays or times > 1").select("doc_id", "text_key", "stays"))
    keyed = docs.select(F.struct("*").alias("it"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    keyed = sifted(keyed, F.xxhash64("doc_id", "text_key"), sieve(odd.select(F.xxhash64("doc_id", "text_key").alias("place")), "place"))
    maybe = keyed.where("_may").join(odd.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    once = maybe.where("stays").dropDuplicates(["doc_id", "text_key"])
    return keyed.where("not _may").select("it.*").unionByName(maybe.where("stays is null").select("it.*")).unionByName(once.select("it.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaked_items") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents of which it takes nothing go."""
    prepare(spark)
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet under the checkpoint folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    where = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
